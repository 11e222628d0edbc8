"""The stages of the pipeline against brute force, each on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import quality
from matchloom.session import materialize
from tests_llm_rows import low, shingles, split, targets_by_force

PLAIN = "time year people way day man thing woman life child world school state family student group country problem hand part place case week".split()
#: Names that the stages use inside themselves, or add.
AWKWARD = ("key", "row", "words", "measures", "quality", "gone", "id", "d", "h", "doc", "hash", "n", "taken_key", "alike", "rid", "cell", "rank", "lo", "into", "shard", "slot", "a.b", "__words")


def corpus():
    rng = random.Random(13)
    text = lambda n: " ".join(rng.choice(PLAIN) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "to"]) for _ in range(n))
    passage = text(12)
    out = [None, "", "too short", "# $ % & " * 40, "same line of the text\n" * 30, text(40)]
    for g in range(4):
        base = text(150).split(" ")
        for share in (0, 0.010, 0.019, 0.024, 0.05):
            w = list(base)
            for j in rng.sample(range(2, 20), round(share * 150)):
                w[j * 7] = f"{rng.choice(PLAIN)}{g}x{j}"
            out.append(" ".join(w))
    out += [text(30) + " " + passage + " " + text(25), text(60) + "\n" + passage.upper()]
    out += [text(rng.randint(12, 200)) for _ in range(60)] + [text(20_000)]
    rng.shuffle(out)
    data = [(i, t, rng.choice(["en", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(out)]
    return [*data, data[9], data[9], (None, text(50), None, "b", 7)], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    data, passage = corpus()
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    d.withColumns({c: F.lit(k) for k, c in enumerate(AWKWARD)}).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), passage


def good(t):
    """The quality rules by force."""
    w, t = split(t), t or ""
    win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c = Counter(win)
    cover = {k + j for k, x in enumerate(win) if c[x] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if split(x)]
    n = len(w)
    if n < 10 or 100 * len(cover) > 20 * n:
        return False
    stops = sum(x.lower() in quality.STOP_WORDS for x in w)
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    return 2 <= sum(map(len, w)) / n <= 14 and symbols / n <= 0.3 and (n < 20 or stops / n >= 0.05) and (len(lines) - len(set(lines))) / len(lines) <= 0.3


def survivors(rows):
    """doc_ids that name a component at a similarity of 0.8."""
    sets = [(i, shingles(t)) for i, t in {(r["doc_id"], r["text"]) for r in rows} if i is not None]
    up = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((up[i], up[j]))
                up = {key: a if v == b else v for key, v in up.items()}
    return {i for i, v in up.items() if i == v}


def test_stages_by_force(spark, folder):
    path, passage = folder
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    steps = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    bag = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)

    def after(name):
        nonlocal now
        before = now.collect()
        now = materialize(steps[name](spark, now, path), name)
        if name != "sharding":
            assert now.columns == columns
        return before, now.collect()

    before, got = after("quality_rules")
    assert bag(got) == bag(r for r in before if good(r["text"])) and 0 < len(got) < len(before)
    before, got = after("near_dedup")
    kept = survivors(before)
    assert bag(got) == bag(r for r in before if r["doc_id"] is None or r["doc_id"] in kept) and len(got) < len(before)
    before, got = after("decontamination")
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t)) if w]
    item = words(passage)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    clean = lambda t: not windows & {tuple(w[k : k + 10]) for w in [words(t)] for k in range(len(w) - 9)}
    assert bag(got) == bag(r for r in before if clean(r["text"])) and len(got) == len(before) - 2
    before, got = after("mixing")
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r["source"]] += len(split(r["text"]))
    for r in got:
        taken[r["source"]] += len(split(r["text"]))
    longest = max(len(split(r["text"])) for r in before)  # may be more than all others of its source together
    for s, target in targets_by_force(dict(size)).items():
        assert abs(taken[s] - target) <= max(0.02 * target, longest / 2)
    had = bag(before)
    assert all(n <= 2 * had[k] for k, n in bag(got).items())
    before, got = after("sharding")
    assert bag(got) == bag(before) and now.columns == [*(c for c in columns if c not in ("shard", "slot")), "shard", "slot"]
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_on_no_documents(spark, folder, tmp_path):
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{n}.parquet").where("false").write.parquet(str(tmp_path / f"{n}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_deals_crowds_of_rows_alike(spark, monkeypatch):
    """One row alike many times over: copies come near their share, no row is lost, none is taken more than twice."""
    from matchloom.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(7, "w " * 9, "a")] * 100 + [(i, "w " * (i % 5 + 1), "a") for i in range(100, 160)] + [(i, "w " * 400, "b") for i in range(200, 210)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.stage(spark, d, "").collect()
    had, n = Counter(r[0] for r in rows), Counter(r["doc_id"] for r in got)
    assert all(n[i] <= 2 * k for i, k in had.items())
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    for s, target in targets_by_force(dict(size)).items():
        assert taken[s] == pytest.approx(target, rel=0.05)
