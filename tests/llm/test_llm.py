"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_rows import SCHEMA, components_by_force, low, rows, shingles, spans_by_force, split, targets_by_force

from matchloom.llm import (
    chunk_dedup,
    decontamination,
    language_model,
    mixing,
    near_dedup,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)

@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    got = quality.judge_quality(docs).select("text", "quality.*").collect()
    for r in got:
        w = split(r["text"])
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(win)
        cover = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if split(x)]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(map(len, w))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert quality.judge_quality(none).count() == 0
    assert quality.judge_quality(docs.withColumn("n_words", F.lit(1))).columns[-2:] == ["n_words", "quality"]


def test_near_dedup(docs, none):
    want = components_by_force(sorted({(r[0], frozenset(shingles(r[1]))) for r in rows() if r[0] is not None}, key=lambda x: x[0]))
    for r in near_dedup.near_duplicates(docs).collect():
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_long_lists(spark):
    """A large group whose members are near its base and often not near each other, and a very common passage."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(base)]
    for k in range(60):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[j] = f"k{k}x{j}"
        texts.append(" ".join(w))
    for k in range(60):
        texts.append(" ".join([f"u{k}y{i}" for i in range(30)] + passage))
    order = list(range(len(texts)))
    rng.shuffle(order)
    items = [(i, texts[k]) for i, k in enumerate(order)]
    want = components_by_force([(i, shingles(t)) for i, t in items])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_pairs_below_the_threshold_are_not_made(spark):
    """Many texts near each other, but not near enough: the exact prefix filter makes all pairs that are, and few of the others."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for _ in range(60):
        w = list(base)
        for j in rng.sample(range(3, 147, 6), 4):
            w[j] = f"x{j}y{rng.randrange(2)}"
        texts.append(w)
    texts = sorted({" ".join(w) for w in texts})
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    members = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    got = {tuple(r) for r in near_dedup.prefix_pairs(docs, members, nodes, 80).collect()}
    sets = [shingles(t) for t in texts]
    share = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets[:i])}
    links = {p for p, s in share.items() if s >= 0.8}
    assert links and links <= got
    assert sum(s > 0.55 for s in share.values()) > 1_000 and len(got) < 2 * len(links) + 100


def test_near_dedup_stage(spark):
    """The stage links from a similarity of 0.8 on, in small sets and in those large enough for the estimate."""
    rng = random.Random(11)
    texts = []
    for g in range(24):
        n = (60, 100, 400, 800)[g % 4]
        base = [f"g{g}w{i}" for i in range(n)]
        for share in (0, 0.010, 0.019, 0.021, 0.03):
            w = list(base)
            for j in rng.sample(range(2, n // 7), round(share * n)):
                w[j * 7] = f"g{g}s{share}n{j}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    pairs = [(len(x & y) / len(x | y), i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i])]
    assert sum(0.8 <= p < 0.85 for p, _, _ in pairs) > 10
    for p, i, j in pairs:
        if p >= 0.8:
            a, b = sorted((up[i], up[j]))
            up = [a if x == b else x for x in up]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.stage(spark, d, "").collect()} == set(up)


def test_sharding(docs, none):
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("size", F.octet_length(text) + 1)
    got = sharding.shard_rows(keyed, ["doc_id", "text"], n_shards=4, vnodes=8, cell_bits=6).collect()
    assert len(got) == len(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(none, ["doc_id"]).count() == 0


def test_ring_by_force():
    """The replay on counts equals a walk of every single key."""
    rng = random.Random(2)
    for cells, shards, vnodes in ((64, 5, 4), (32, 3, 2), (16, 4, 1)):
        counts = Counter(rng.randrange(cells) if rng.random() < 0.6 else 3 for _ in range(203))
        nodes, room = sharding.ring(shards, vnodes, cells), sharding.capacities(203, shards)
        want = []
        for cell in sorted(counts):
            for rank in range(counts[cell]):
                k = next((k for k, (p, _) in enumerate(nodes) if p >= cell), 0)
                while not room[nodes[k % len(nodes)][1]]:
                    k += 1
                s = nodes[k % len(nodes)][1]
                room[s] -= 1
                want.append((cell, rank, s))
        got = [(c, r, s) for c, a, z, s, _ in sharding.place(dict(counts), shards, vnodes, cells) for r in range(a, z)]
        assert got == want


def test_mixing(docs, none):
    rows_, _ = mixing.mix(docs.select("doc_id", "text", "source"))
    got = rows_.collect()
    size = defaultdict(int)
    for r in rows():
        size[r[3]] += len(split(r[1]))
    want = targets_by_force(dict(size))
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        by[r["source"]].append(r["copies"] * r["size"])
    for s, taken in by.items():
        largest = max(len(split(r[1])) for r in rows() if r[3] == s)
        assert abs(sum(taken) - want[s]) <= largest
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.select("doc_id", "text", "source"))[0].collect()))
    assert mixing.mix(none.select("doc_id", "text", "source"))[0].count() == 0


def test_pivotal_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    ends = np.array([mixing.settle(size, p, rng.random(40)) for _ in range(4000)])
    assert ((ends > 0) & (ends < 1)).sum(axis=1).max() <= 1
    assert np.allclose(ends @ size, p @ size)
    assert np.abs(ends.mean(axis=0) - p).max() < 0.05


def test_decontamination(spark, docs, none):
    body = [r[1] for r in rows() if r[1] and len(r[1]) > 500][0]
    items = [(1, " ".join(split(body)[20:45])), (2, "B c D"), (10, None), (11, "..."), (12, " ".join(split(body)[20:45])), (3, "nowhere to be found at all in any of the documents")]
    b = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t)) if w]
    found = decontamination.with_contamination(docs.select("doc_id", "text"), b, [F.col("doc_id"), F.col("text")])
    n_hit = F.coalesce(decontamination.covered(F.col("spans")), F.lit(0))
    got = found.select("text", n_hit.alias("n"), F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("ids")).collect()
    assert len(got) == len(rows())
    for r in got:
        w, cover, ids = words(r["text"]), set(), set()
        for i, t in items:
            v = words(t)
            for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        cover |= set(range(k, k + len(win)))
                        ids.add(str(i))
        assert (r["n"], r["ids"]) == (len(cover), ",".join(sorted(ids)))
    assert decontamination.find_contamination(none, b).count() == 0
    assert decontamination.find_contamination(docs, b.where("false")).count() == 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "GROUP", hot)
    d = substring_dedup.keyed(docs)
    got = substring_dedup.remove_spans(d, substring_dedup.repeated_spans(d)).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(r[0], *s) for r, s in zip(rows(), spans_by_force([r[1] for r in rows()]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    e = substring_dedup.keyed(none)
    assert substring_dedup.remove_spans(e, substring_dedup.repeated_spans(e)).count() == 0


def test_chunk_dedup(docs, none):
    gear, m = [int(x) for x in chunk_dedup._GEAR], 2**64 - 1

    def chunks(b):
        h, at, out = 0, 0, []
        for i, x in enumerate(b):
            h, n = (h << 1) + gear[x] & m, i + 1 - at
            if (n >= chunk_dedup.LEAST and h >> 59 == 0) or n == chunk_dedup.MOST or i == len(b) - 1:
                out.append((at, b[at : i + 1]))
                at = i + 1
        return out

    got = chunk_dedup.chunk_duplicates(docs).collect()
    assert len(got) == len(rows())
    all_ = Counter(c for r in rows() for _, c in chunks((r[1] or "").encode()) if len(c) >= chunk_dedup.LEAST)
    assert sum(r["n_bytes"] for r in got) == sum(len((r[1] or "").encode()) for r in rows())
    assert sum(len(r["starts"]) for r in got) == sum(n - 1 for n in all_.values())
    assert chunk_dedup.chunk_duplicates(none).count() == 0
    b = np.frombuffer(bytes(random.Random(1).randbytes(20000)), "u1")
    moved = np.concatenate((b[:5000], np.frombuffer(b"inserted", "u1"), b[5000:]))
    digest = lambda x: {bytes(x[a:z]) for a, z in zip([0, *chunk_dedup.cut_points(x)], chunk_dedup.cut_points(x), strict=False)}
    assert len(digest(b) & digest(moved)) > 0.9 * len(digest(b))


def test_chunk_dedup_short_chunks(spark, docs, tmp_path):
    """The query also finds copies of texts and of endings that are shorter than a chunk."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = chunk_dedup.op7_chunk_dedup(spark, str(tmp_path)).collect()
    seen, want, copies = set(), [], set()
    for i, t in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        ends = chunk_dedup.cut_points(np.frombuffer(b, "u1"))
        names, gone = [], 0
        for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
            short = z - a < chunk_dedup.LEAST
            names.append((short, b[([0, *ends][k - 1] if short and k else a) : z]))
            gone += (z - a) * (names[-1] in seen or names[-1] in names[:-1])
        seen |= set(names)
        want.append((i, len(b), gone))
        assert b not in copies or gone == len(b)
        copies.add(b)
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got), key=key) == sorted(want, key=key)


def test_token_counts(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())
    rng = random.Random(3)
    c = token_counts.counter(token_counts.vocabulary_path())
    texts = ["", "don't we'll x'sam ''s", "<|endoftext|> a<|startoftext|>", "ΑΣ ﬁ İ 你好 😀", "ab" * 700, "é'é", "á ​ x"]
    texts += ["".join(rng.choice("abcdetshin '.!1é \n") for _ in range(rng.randint(0, 900))) for _ in range(150)]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert c.count(texts).tolist() == want
    keep, c.machine.states = c.machine.states, c.machine.states  # a reset changes nothing
    c.machine.reset()
    assert c.count(texts).tolist() == want and keep is not c.machine.states
    for r in token_counts.count_tokens(docs).join(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("frequent", [1 << 19, 20])
def test_language_model(docs, none, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(r[0], [*split(low(r[1])), None]) for r in rows()]
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    trained = language_model.train(docs.where(~language_model.held_out(F.col("doc_id"))))
    assert trained[1:3] == (n, v)
    got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in language_model.score_documents(docs, trained).collect())
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for _, t in toks)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)
    assert all(r["score"] < 0 for r in language_model.score_documents(docs, trained).collect())
    assert language_model.score_documents(none, language_model.train(none)).count() == 0


def test_language_model_large_filter(docs, none, monkeypatch):
    """A filter beyond the broadcast bound keeps its bits, and gives the same scores from its segments."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"], *r[1:])
    score = lambda: sorted(map(key, language_model.score_documents(docs, language_model.train(docs, bucket_bits=2)).collect()))
    want = score()
    monkeypatch.setattr(language_model, "MAX_FILTER_BYTES", 512)
    monkeypatch.setattr(language_model, "CHUNK", 500, raising=False)
    monkeypatch.setattr(language_model, "LOOKED_UP_BYTES", 100, raising=False)
    got = score()
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(got) == len(rows())
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-12, atol=1e-9)
    assert language_model.score_documents(none, language_model.train(docs)).count() == 0


def test_log_frequency_filter():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype="u8") * np.uint64(2))
    counts = np.arange(1, 5001)
    size = int(language_model.level(counts, 1).sum()) * language_model.BITS_PER_ENTRY // 8
    data = language_model.LogFrequencyFilter.segment(size, [(1, language_model.pack(keys >> np.uint64(1), counts))])
    f = language_model.LogFrequencyFilter(1, size, int(language_model.level(counts, 1).max()), np.frombuffer(data * 2, "u1"))
    levels = f.levels(keys >> np.uint64(1), 1)
    true = language_model.level(counts, 1)
    assert (levels >= true).all() and (levels == true).mean() > 0.9
    assert [a.tolist() for a in language_model.unpack(language_model.pack(keys, counts))] == [keys.tolist(), counts.tolist()]


def test_toxicity(spark, none):
    rng = random.Random(9)
    clean = [f"c{i}" for i in range(200)]
    bad = ["vile", "rotten", "filth"]
    data = []
    for i in range(600):
        s = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(6)]
        toxic = int(rng.random() < 0.3)
        at = rng.randrange(6)
        if toxic:
            s[at] += " " + rng.choice(bad)
        data.append((i, ". ".join(s) + ".", toxic, at))
    d = spark.createDataFrame([(i, t) for i, t, _, _ in data] + [(None, None), (None, "")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y, _ in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab.where(toxicity.learnable(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= 0.3) == bool(y) for i, _, y, _ in held]) > 0.95
    assert np.mean([got[i]["worst_sentence"] == at for i, _, y, at in held if y]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.train(d, lab.where("false"))
    assert {r["score"] for r in toxicity.score_toxicity(d, empty).collect()} == {0.0}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    sf = "/root/testdata/sf0.001"
    now = docs
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        now = step(spark, now, sf)
        if k < 4:
            assert now.columns == docs.columns
    out = now.collect()
    assert set(now.columns) == {*docs.columns, "shard", "slot"}
    kept = {r["doc_id"] for r in quality.judge_quality(docs).where("quality.kept").collect()}
    assert {r["doc_id"] for r in out} <= kept and out
    assert max(Counter((r["doc_id"], r["text"]) for r in out).values()) <= 2


assert sys.version_info >= (3, 11)
