"""Folds over table pairs, and the leakage filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ranks import global_rank


def stratum(*columns: Column) -> Column:
    return F.concat_ws("::", *columns)


def shuffled(key: Column, seed: int) -> Column:
    """A seeded order that does not hang on partitioning."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string")))


def stratified_folds(pairs: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """``pairs`` (pair_id, stratum) with ``fold_id``: dealt within strata, or over all where a stratum is too small."""
    least = pairs.groupBy("stratum").count().agg(F.min("count")).first()[0] or 0
    order = [shuffled(F.col("pair_id"), seed), F.col("pair_id")]
    if least >= n_splits:
        ranked = pairs.withColumn("__rn", F.row_number().over(Window.partitionBy("stratum").orderBy(*order)))
    else:
        ranked = global_rank(pairs, "__rn", *order)
    return ranked.withColumn("fold_id", ((F.col("__rn") - 1) % n_splits).cast("int")).drop("__rn")


def one_split(pairs: DataFrame, seed: int, test_size: float = 0.3) -> DataFrame:
    """``pairs`` with ``role``: the first share of each stratum in seeded order is test."""
    w = Window.partitionBy("stratum").orderBy(shuffled(F.col("pair_id"), seed), "pair_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    return pairs.withColumn("role", F.when(F.row_number().over(w) <= F.round(n * test_size), "test").otherwise("train"))


def repeated_splits(pairs: DataFrame, n_splits: int = 5, seed: int = 42, test_size: float = 0.3, attempts: int = 500) -> DataFrame:
    """(fold_id, pair_id, role): seeded 70/30 splits, each of which tests a pair not tested before.

    A split without a new test pair is tried again with the next seed while pairs are
    left; folds still missing after ``attempts`` are filled from stratified folds.
    Each round adds one column to the covered pairs; the driver sees a count.
    """
    from matchloom.session import materialize

    pairs = materialize(pairs.select("pair_id", "stratum").distinct(), "pairs")
    left = pairs.select("pair_id")
    open_, folds, tries = left.count(), [], 0
    while len(folds) < n_splits and tries < attempts:
        split = one_split(pairs, seed + tries, test_size).select("pair_id", "role")
        tries += 1
        if open_:
            rest = materialize(left.join(split.where("role = 'test'"), "pair_id", "left_anti"), "uncovered")
            now = rest.count()
            if now == open_:
                continue
            left, open_ = rest, now
        folds.append(split.withColumn("fold_id", F.lit(len(folds))))
    if len(folds) < n_splits:
        dealt = stratified_folds(pairs, n_splits, seed)
        for k in range(n_splits - len(folds)):
            role = F.when(F.col("fold_id") == k, "test").otherwise("train")
            folds.append(dealt.select("pair_id", role.alias("role")).withColumn("fold_id", F.lit(len(folds))))
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    return out.select("fold_id", "pair_id", "role")


def complement(folds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Train rows of folds that name their test pairs only."""
    bare = folds.groupBy("fold_id").agg(F.max((F.col("role") == "train").cast("int")).alias("t")).where("t = 0").select("fold_id")
    every = pairs.select("pair_id").join(F.broadcast(bare))  # one row for each pair and such fold
    return folds.unionByName(
        every.join(folds, ["fold_id", "pair_id"], "left_anti").select("fold_id", "pair_id", F.lit("train").alias("role"))
    )


def filter_leakage(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """``train`` without positives whose key is positive in ``test``; negatives stay. Keys may include a fold."""
    seen = test.where("label = 1").select(*keys).distinct()
    return train.where("label = 1").join(seen, keys, "left_anti").select(train.columns).unionByName(train.where("label <> 1 or label is null"))


def materialize_folds(rows: DataFrame, folds: DataFrame, path: str, leakage_keys: list[str] | None = None) -> DataFrame:
    """Write the rows of every fold, partitioned by fold and role; returns one row of counts for each fold."""
    dealt = rows.join(folds, "pair_id")
    if leakage_keys:
        test = dealt.where("role = 'test'")
        dealt = filter_leakage(dealt.where("role = 'train'"), test, ["fold_id", *leakage_keys]).unionByName(test)
    dealt.write.mode("overwrite").partitionBy("fold_id", "role").parquet(path)
    n = lambda role, c: F.count(F.when(F.col("role") == role, c))
    return rows.sparkSession.read.parquet(path).groupBy("fold_id").agg(
        n("train", F.lit(1)).alias("n_train_rows"), n("test", F.lit(1)).alias("n_test_rows"),
        F.countDistinct(F.when(F.col("role") == "train", F.col("pair_id"))).alias("n_train_pairs"),
        F.countDistinct(F.when(F.col("role") == "test", F.col("pair_id"))).alias("n_test_pairs"),
    )
