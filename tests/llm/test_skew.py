"""Joins with hot keys against plain joins."""

from collections import Counter

import pytest

from matchloom import session
from matchloom.llm import components, near_dedup, skew


@pytest.fixture(params=[3, 1_000])
def least(request, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", request.param)
    return request.param


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def rows_of(spark):
    data = [(1, k) for k in range(50)] + [(2, k) for k in range(4)] + [(3, 1), (3, 1), (4, 9), (None, 5), (None, 6)]
    return data, spark.createDataFrame(data, "key long, id long")


def test_counts_and_hot_join(spark, least):
    data, rows = rows_of(spark)
    c = Counter(k for k, _ in data if k is not None)
    limit = skew.hot_limit(rows)
    got = skew.with_counts(rows, "key", limit)
    assert bag(got, "key", "id", "c") == Counter((k, i, c[k]) for k, i in data if k is not None and c[k] > 1)
    side = spark.createDataFrame([(1, 50, "x"), (3, 2, "y")], "key long, c long, v string")
    assert bag(skew.hot_join(got, side, "key", limit), "key", "id", "v") == Counter((k, i, {1: "x", 3: "y"}[k]) for k, i in data if k in (1, 3))
    assert bag(skew.hot_join(got, side, "key", limit, "left_semi"), "key", "id") == Counter((k, i) for k, i in data if k in (1, 3))
    assert skew.with_counts(rows.limit(0), "key", limit).count() == 0


def test_deal_join(spark, least):
    data, rows = rows_of(spark)
    side = spark.createDataFrame([(1, "x"), (2, "y"), (7, "z")], "key long, v string")
    assert bag(skew.deal_join(rows, side, "key", "id"), "key", "id", "v") == Counter((k, i, {1: "x", 2: "y"}[k]) for k, i in data if k in (1, 2))
    assert skew.deal_join(rows.limit(0), side, "key", "id").count() == 0


def test_near_dedup_alike_with_hot_keys(spark, monkeypatch):
    base = [f"b{i}" for i in range(100)]
    texts = [(k, " ".join([*base, f"own{k}"])) for k in range(30)] + [(50 + k, " ".join([*base[:40], *[f"u{k}y{i}" for i in range(20)]])) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = bag(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    monkeypatch.setattr(skew, "LEAST_HOT", 4)
    assert bag(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == want
    assert {r[2] for r in want if r[0] < 30} == {0}


def test_near_dedup_writes_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, a small table is a few files."""
    files = []

    def counted(df, name, *about):
        out = session.materialize(df, name, *about)
        files.append(len(out.inputFiles()))
        return out

    for module in (near_dedup, components, skew):
        monkeypatch.setattr(module, "materialize", counted)
    base = [f"b{i}" for i in range(100)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"own{k}"])) for k in range(60)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 20 and sum(files) < 3 * len(files)
