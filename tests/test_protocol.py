import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import syntax, topology
from matchloom.operators import candidates, model, protocol, splits


def rows_of(spark):
    data = []
    for run, method, shift in (("1", "own_x", 0.0), ("1", "plain", 0.4), ("2", "late", 0.2)):
        for fold in range(3):
            for pair in ("p", "q"):
                for k in range(4):
                    label = int(k == fold % 2)
                    data.append((run, fold, method, pair, f"s{k}", "t", label, label * 0.5 + 0.1 * k - shift * (k % 2) * label))
    return spark.createDataFrame(data, "run_id string, fold_id int, method string, pair_id string, source_col_norm string, target_col_norm string, label int, score double")


def test_protocol(spark):
    df = rows_of(spark)
    pred = protocol.predictions(protocol.labelled_scores(df.drop("label"), df.where("method = 'plain'").select("fold_id", *protocol.KEYS, "label"))).toPandas()
    assert len(pred) == 72
    for (run, method, fold), g in pred.groupby(["run_id", "method", "fold_id"]):
        train = pred[(pred.run_id == run) & (pred.method == method) & (pred.fold_id != fold)]
        levels = sorted(set(train.score))
        best = (-1.0, 0.0)
        for low, high in zip(levels, levels[1:], strict=False):  # a point's metrics are those one step above its threshold
            hit = train.score >= high
            tp = (train.label[hit] == 1).sum()
            f1 = 2 * tp / (hit.sum() + train.label.sum())
            if round(f1, 12) > best[0]:
                best = round(f1, 12), low
        assert set(g.threshold) == {best[1]}
        assert (g.pred_opt_train == (g.score >= best[1])).all()
    for _, g in pred.groupby(["run_id", "method", "fold_id", "pair_id"]):
        assert g.pred_ground_size.sum() == g.label.sum()


def test_against_best_falls_back_on_means(spark):
    pairs = protocol.pair_metrics(protocol.predictions(rows_of(spark)))
    got = {r["method"]: r for r in protocol.against_best(pairs, "f1_ground_size", "own_").collect()}
    assert set(got) == {"plain", "late"} and {r["best"] for r in got.values()} == {"own_x"}
    assert got["plain"]["paired_on"] == "run_id+pair_id" and got["late"]["paired_on"] == "pair_id_mean_over_runs"
    assert got["late"]["n_pairs_runs"] == 2
    assert protocol.best_method(pairs, "f1_ground_size", "none").first()[0] is not None


def test_save_result(spark, tmp_path):
    df = rows_of(spark)
    folder = protocol.save_result(df, str(tmp_path / "out"), {"method": "m", "runtime_sec": 1.5, "metrics": {"f1": 0.5}})
    assert spark.read.parquet(f"{folder}/predictions.parquet").count() == 72
    assert '"runtime_sec": 1.5' in (tmp_path / "out" / "metrics.json").read_text()


def test_folds_of_forests(spark):
    rng = np.random.default_rng(1)
    data = [(f"p{i % 6}", int(x > 0.5), float(x), float(rng.random())) for i, x in enumerate(rng.random(120))]
    rows = spark.createDataFrame(data, "pair_id string, label int, x double, y double")
    pairs = rows.select("pair_id").distinct().withColumn("stratum", F.lit("s"))
    folds, made = model.evaluate_folds(rows, splits.repeated_splits(pairs, 2), {"both": ["x", "y"], "x": ["x"]}, (1, 2), trees=5, depth=4)
    got = folds.collect()
    assert len(got) == 8 and all(r["f1"] > 0.9 and r["fit_sec"] > 0 for r in got)
    assert model.summarize_folds(made, folds).count() == 2
    assert {r["n_runs"] for r in model.summarize_seeds(made).collect()} == {2}


def test_candidate_pairs_with_many_columns(spark):
    side = lambda n, k: spark.createDataFrame([(p, f"{k}{i}") for p in ("a", "b") for i in range(n)], "pair_id string, column string")
    got = candidates.candidate_pairs(side(5, "s"), side(3, "t"), part_columns=2)
    assert got.distinct().count() == got.count() == 30


def reduce_by_matrix(points, maxdim):
    """Bars from the whole boundary matrix."""
    from itertools import combinations

    d = topology.distances(points)
    cells = sorted((max((d[a, b] for a, b in combinations(s, 2)), default=0.0), len(s), s) for k in range(1, maxdim + 3) for s in combinations(range(len(points)), k))
    index, low, bars = {s: i for i, (_, _, s) in enumerate(cells)}, {}, [[] for _ in range(maxdim + 1)]
    for i, (death, size, s) in enumerate(cells):
        column = {index[f] for f in combinations(s, size - 1)} if size > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            birth, k, _ = cells[max(column)]
            if death > birth:
                bars[k - 1].append((birth, death))
        del i
    return bars


@pytest.mark.parametrize("n,dim,grid", [(9, 2, False), (10, 3, False), (9, 2, True)])
def test_homology_against_the_boundary_matrix(n, dim, grid):
    x = np.random.default_rng(n + dim).standard_normal((n, dim))
    x = np.round(x * 2) if grid else x
    want, got = reduce_by_matrix(x, 2), topology.diagram(x, 2)
    for k in range(3):
        bars = sorted(map(tuple, topology.finite(got[k])))
        assert len(bars) == len(want[k]) and np.allclose(np.array(bars).reshape(-1, 2), np.array(sorted(want[k])).reshape(-1, 2))


def jaro_by_definition(a, b):
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            left.append(c)
    right = [b[j] for j in sorted(used)]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0


def test_jaro_and_native_cosine(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcd "), rng.integers(1, 14))).strip() or "a" for _ in range(60)]
    for a, b in zip(words, reversed(words), strict=True):
        assert syntax.jaro(a, b) == pytest.approx(jaro_by_definition(a, b))
    df = spark.createDataFrame(list(zip(words, reversed(words), strict=True)), "x string, y string")
    made = syntax.cosine_arrays(syntax.ngram_array(F.col("x"), 2), syntax.ngram_array(F.col("y"), 2))
    for r in df.select("x", "y", made.alias("c")).collect():
        assert r["c"] == pytest.approx(syntax.features_of(r["x"], r["y"], ("syn_cosine_bigrams",))["syn_cosine_bigrams"])
