import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import candidates, evaluate, profile, splits, stats
from matchloom.sources import catalog, tables


def test_profile(spark):
    df = spark.createDataFrame([("x", None, " "), ("x", None, " "), ("y\nz", None, " ")], "A string, B string, c string")
    got = {r["column"]: (r["norm"], r["text"]) for r in profile.column_texts(df).collect()}
    assert got == {"A": ("a", "A || x | y z"), "B": ("b", "B"), "c": ("c", "c")}


def test_features_configurations():
    c = candidates.configurations()
    assert {k: len(v) for k, v in c.items()} == {"full60": 60, "syn": 22, "cls": 7, "tda": 31, "syn_cls": 29, "syn_tda": 53, "cls_tda": 38, "reduced": 10}
    assert len(candidates.ALL_FEATURES) == 79


def test_catalog(spark, tmp_path):
    folder = tmp_path / "OpenData" / "View -Unionable" / "p1"
    folder.mkdir(parents=True)
    (folder / "a_source.csv").write_text("X,Y\n1,2\n")
    (folder / "b_target.csv").write_text("x\n1\n")
    (folder / "p_mapping.json").write_text('{"matches": [{"source_column": " X ", "target_column": "x"}, {"source_column": "Y"}, 3]}')
    two = tmp_path / "OpenData" / "Joinable" / "p2"
    two.mkdir(parents=True)
    for n in ("a_source.csv", "b_source.csv", "c_target.csv", "p_mapping.json"):
        (two / n).write_text("{}")
    (row,) = catalog.discover_pairs(spark, str(tmp_path)).collect()
    assert (row["pair_id"], row["relation_type"]) == ("OpenData__View -Unionable__p1", "View-Unionable")
    assert (row["source_table_name"], row["target_table_name"], row["dataset"]) == ("a", "b", "OpenData")
    (m,) = catalog.load_mapping(spark, row["mapping_json"]).collect()
    assert tuple(m) == ("source", " X ", "target", "x")
    truth = catalog.ground_truth(catalog.load_mapping(spark, row["mapping_json"]), F.lit("p")).collect()
    assert [tuple(t) for t in truth] == [("p", "x", "x")]
    assert tables.scan_csv(spark, row["source_csv"], 1).columns == ["X", "Y"]


def test_external_scores(spark, tmp_path):
    test = spark.createDataFrame([("p", "a", "b"), ("p", "c", "d")], "pair_id string, source_col_norm string, target_col_norm string")
    scores = spark.createDataFrame([("p", " A ", "B", "0.5"), ("p", "a", "b", "bad")], "pair_id string, source_column string, target_column string, similarity string")
    path = str(tmp_path / "s.parquet")
    tables.write_table(scores, path)
    config = {"external": {"m": {"required_env": ["HOME_DIR"], "predictions": "{HOME_DIR}/s.parquet"}}}
    got, status = catalog.run_external(test, "m", config, {"HOME_DIR": str(tmp_path)})
    assert status == "ok" and sorted(r["score"] for r in got.collect()) == [0, 0.5]
    assert catalog.run_external(test, "m", config, {})[1] == "missing_env"
    assert catalog.run_external(test, "n", config, {})[1] == "missing_backend"
    assert catalog.run_external(test, "m", config, {"HOME_DIR": "/nowhere"})[1] == "missing_predictions"


def test_greedy(spark):
    df = spark.createDataFrame([("p", "a", "x", 0.9, 1), ("p", "a", "y", 0.8, 0), ("p", "b", "x", 0.7, 0), ("p", "b", "y", 0.1, 1)], "pair_id string, source_col_norm string, target_col_norm string, score double, label int")
    got = {(r["source_col_norm"], r["target_col_norm"]) for r in evaluate.greedy_one_to_one(df).where("pred = 1").collect()}
    assert got == {("a", "x"), ("b", "y")}


def test_threshold_strict(spark):
    df = spark.createDataFrame([("p", 1, 0.5), ("p", 0, 0.3), ("q", 0, 0.9)], "pair_id string, label int, score double")
    assert tuple(evaluate.best_threshold(df).first()) == (0.3, 1.0)
    one = df.where("label = 1")
    assert tuple(evaluate.best_threshold(one).first()) == (0.5, 0.0)


def test_splits(spark):
    pairs = spark.createDataFrame([(str(i), f"s{i % 3}") for i in range(60)], "pair_id string, stratum string")
    folds = splits.repeated_splits(pairs, 5).collect()
    assert {r["fold_id"] for r in folds} == set(range(5)) and len(folds) == 300
    seen, new = set(), 0
    for k in range(5):
        test = {r["pair_id"] for r in folds if r["fold_id"] == k and r["role"] == "test"}
        assert len(test) == 18
        new, seen = new + bool(test - seen), seen | test
    dealt = splits.stratified_folds(pairs, 5).groupBy("fold_id").count().collect()
    assert {r["count"] for r in dealt} == {12}


def test_statistics():
    assert stats.sign_test(0, 0) != stats.sign_test(0, 0)
    assert stats.sign_test(5, 5) == 1 and stats.sign_test(10, 0) == pytest.approx(2 / 1024)
    assert stats.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(0.0625)
    assert stats.wilcoxon(np.array([0.0])) != stats.wilcoxon(np.array([0.0]))


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_csv_types_and_missing_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d\n1,2.5,x,\nNA,n/a,"y\nz",NULL\n3,4,NaN,\n')
    plain = tables.scan_csv(spark, str(tmp_path / "t.csv"), None)
    assert [t for _, t in plain.dtypes] == ["string"] * 4
    got = tables.scan_csv(spark, str(tmp_path / "t.csv"), None, typed=True)
    assert [t for _, t in got.dtypes][:3] == ["bigint", "double", "string"]
    assert [tuple(r)[:3] for r in got.collect()] == [(1, 2.5, "x"), (None, None, "y\nz"), (3, 4.0, None)]
    assert tables.scan_csv(spark, str(tmp_path / "t.csv"), 1).count() == 1


def test_sql_functions(spark):
    from matchloom.functions import register

    assert len(register.register(spark)) == 27
    row = spark.sql("SELECT syn_jaro('martha', 'marhta') AS j, cls_euclidean(array(1, 2), array(4, 6)) AS e, cls_canberra(array(1, 2), array(4, 6)) AS c").first()
    assert row["j"] == pytest.approx(17 / 18) and row["e"] == 5 and row["c"] == pytest.approx(1.1)


def test_resolve():
    assert catalog.resolve("coma_pp", {"coma_instance": min}, {}) == "plugin:coma_instance"
    assert catalog.resolve("SMUTF", {}, {}) == "external" and catalog.resolve("nothing", {}, {}) == "unknown"
    assert catalog.resolve("own", {}, {"external": {"own": {}}}) == "external"


def test_means_are_added_in_order_and_rounded_as_in_sql(spark):
    """Sums of doubles hang on their order, and SQL rounds the product: neither may hang on partitions."""
    from matchloom.operators import report

    values = [0.1 * i for i in range(1, 40)] + [1e15, 0.3, -1e15]
    want = 0.0
    for v in values:
        want += v
    rows = [(i, "a", v) for i, v in enumerate(values)] + [(99, "b", None), (100, "c", 1.0), (101, "c", None)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "i int, k string, v double").repartition(parts)
        got = {r["k"]: r["mean"] for r in report.mean_in_order(df, ["k"], "v", ["i"]).collect()}
        assert got == {"a": want / len(values), "b": None, "c": 1.0}
    import duckdb

    xs = [3.4499999999999997, -3.4499999999999997, 0.049999999999999996, 0.25, -0.25, 1e300, 7.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(report.round_half_away(F.col("x"), 1)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 1)", [x]).fetchone()[0] for x in xs]
    assert got[0] == 3.5  # 3.4 by the printed decimal


def test_sign_test_of_many_decisions():
    """Thousands of decisions are one binomial and a short sum, not a sum of thousands of binomials."""
    import time
    from math import comb

    for n in range(1, 40):
        for k in range(n + 1):
            exact = min(1.0, 2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
            assert stats.sign_test(k, n - k) == pytest.approx(exact, rel=1e-13)
    start = time.perf_counter()
    assert stats.sign_test(4398, 4590) == pytest.approx(0.04393426001767131, rel=1e-12)  # from the exact sum of integers
    assert stats.sign_test(44700, 45300) < 0.05
    assert time.perf_counter() - start < 2


def test_forests_are_dealt_and_keep_node_ids(spark):
    """A table of one partition is fitted by many tasks, whole; kept node ids change no score."""
    from matchloom.operators import model

    df = spark.createDataFrame([(float(i % 17), float(i % 5), int(i % 17 > 8)) for i in range(300)], "x double, y double, label int").coalesce(1)
    rows = model.dealt(model.balanced(df), ["x", "y"])
    assert rows.rdd.getNumPartitions() == 16 and rows.count() == 300
    pipe = model.build_model("rf", ["x", "y"], trees=5, depth=6)
    assert pipe.getStages()[-1].getCacheNodeIds()
    kept = model.score(pipe.fit(rows), df).select("x", "y", "score").distinct().collect()
    pipe.getStages()[-1].setCacheNodeIds(False)
    assert set(kept) == set(model.score(pipe.fit(rows), df).select("x", "y", "score").distinct().collect())


def test_forest_grown_by_trees(spark):
    """One cut at a time against all cuts tried; a forest is the same from any partitions, and its scores those of its trees over rows."""
    from matchloom.operators import forest, model

    rng = np.random.default_rng(3)
    bins, rows = rng.integers(0, 6, (1, 40)).astype("u1"), rng.integers(0, 4, (2, 40))
    weight = np.array([[1.0], [2.5]])
    tree = forest.grow_tree(bins, rows, weight, 1, np.random.default_rng(5))
    n = np.random.default_rng(5).poisson(rows) * weight
    gini = lambda x: 1 - ((x / x.sum()) ** 2).sum() if x.sum() else 0.0
    cost = {int(b): sum(n[:, s].sum() * gini(n[:, s].sum(axis=1)) for s in (bins[0] <= b, bins[0] > b)) for b in set(bins[0].tolist())}
    assert cost[int(tree.bin[0])] == pytest.approx(min(cost.values())) and tree.feature.tolist() == [0, -1, -1]
    left = n[:, bins[0] <= tree.bin[0]].sum(axis=1)
    assert tree.p[1] == pytest.approx(left[1] / left.sum())
    deep = forest.Tree.unpack(forest.grow_tree(rng.integers(0, 32, (3, 500)).astype("u1"), np.eye(2, dtype=int)[rng.integers(0, 2, 500)].T, np.ones((2, 1)), 30, rng).pack())
    assert np.isin(deep.p[deep.feature < 0], (0.0, 1.0)).mean() > 0.9 and sorted(deep.left[deep.feature >= 0].tolist()) == list(range(1, len(deep.p), 2))
    data = [(i, None if i % 50 == 7 else float(i % 29), float(i % 7), int(i % 29 > 14 or i % 50 == 7)) for i in range(600)]
    df = spark.createDataFrame(data, "id long, x double, y double, label int")
    made = model.fit("rf", df, ["x", "y"], trees=9, depth=30, seed=4)
    assert isinstance(made, forest.Forest) and made.frame.count() == 9
    got = {r["id"]: r["score"] for r in model.score(made, df).collect()}
    again = model.score(model.fit("rf", df.repartition(5).orderBy("y"), ["x", "y"], trees=9, depth=30, seed=4), df.coalesce(1))
    assert got == {r["id"]: r["score"] for r in again.collect()} and len(got) == 600
    assert all((got[i] > 0.5) == bool(label) for i, _, _, label in data)
    assert model.fit("rf", df.na.drop().withColumn("label", F.col("label") * 2), ["y"], trees=2, depth=2).stages  # other labels: by levels
