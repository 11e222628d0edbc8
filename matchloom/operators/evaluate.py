"""Evaluation of scored candidates: (pair_id, label, score) and keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, keys: list[str], label: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 for each key (none: of all rows); 0 where undefined."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = df.groupBy(*keys).agg(
        n((label == 1) & (pred == 1)).alias("tp"), n((label == 0) & (pred == 1)).alias("fp"), n((label == 1) & (pred == 0)).alias("fn")
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(
        *keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def pair_metrics(df: DataFrame) -> DataFrame:
    return prf(df, ["pair_id"], F.col("label"), F.col("pred"))


def global_metrics(df: DataFrame) -> DataFrame:
    return prf(df, [], F.col("label"), F.col("pred"))


def threshold_sweep(df: DataFrame, steps: int = 1000) -> DataFrame:
    """(threshold, mean_f1): the mean F1 of the pairs with a positive, predicting score > threshold.

    A score counts for all grid points below it: rows are first reduced to one count
    for each pair and grid cell, so the grid is joined to at most ``steps`` cells a pair,
    and cumulative sums give every threshold's counts.
    """
    cell = F.least(F.greatest(F.ceil(F.round(F.col("score") * steps, 9)) - 1, F.lit(-1)), F.lit(steps))  # last grid point below the score
    cells = df.groupBy("pair_id", cell.cast("int").alias("k")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    pairs = df.groupBy("pair_id").agg(F.sum("label").alias("total")).where("total > 0")
    grid = df.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("k"))
    every = pairs.join(F.broadcast(grid))  # steps + 1 rows for each pair: the sweep itself
    w = Window.partitionBy("pair_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum(F.coalesce("pos", F.lit(0))).over(w), F.sum(F.coalesce("n", F.lit(0))).over(w)
    swept = every.join(cells, ["pair_id", "k"], "left").select("pair_id", "k", "total", tp.alias("tp"), n.alias("n"))
    # the cell at k holds scores above k's grid point, up to the next
    return swept.groupBy("k").agg(F.avg(2 * F.col("tp") / (F.col("n") + F.col("total"))).alias("mean_f1")).select(
        (F.col("k") / F.lit(float(steps))).alias("threshold"), "mean_f1"
    )


def best_threshold(df: DataFrame, steps: int = 1000) -> DataFrame:
    """One row: the smallest threshold of the best mean F1; (0.5, 0) without two classes."""
    swept = threshold_sweep(df, steps)
    best = swept.agg(F.max(F.struct(F.round("mean_f1", 12).alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    classes = df.agg(F.countDistinct("label").alias("c"))
    return best.join(F.broadcast(classes)).select(
        F.when(F.col("c") >= 2, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(F.col("c") >= 2, F.col("b.f")).otherwise(F.lit(0.0)).alias("mean_f1"),
    )


def pr_curve(df: DataFrame, keys: list[str], counted: bool = False) -> DataFrame:
    """(keys, threshold, precision, recall, rank) for each distinct score, predicting score >= threshold.

    ``df`` has rows (label, score), or, ``counted``, distinct scores with ``pos`` and ``n``.
    """
    by = df if counted else df.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    whole = Window.partitionBy(*keys)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return by.select(
        *keys, F.col("score").alias("threshold"), (F.sum("pos").over(up) / F.sum("n").over(up)).alias("precision"),
        ratio(F.sum("pos").over(up), F.sum("pos").over(whole)).alias("recall"), F.row_number().over(w).alias("rank"),
    )


def pr_threshold(df: DataFrame, keys: list[str], mode: str = "aligned", counted: bool = False) -> DataFrame:
    """The threshold of the best F1 for each key.

    ``aligned`` takes the score whose own precision and recall are best; ``faithful``
    pairs each point with the threshold one step below, as the published protocol did.
    """
    curve = pr_curve(df, keys, counted).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if mode == "faithful":
        lower = F.lead("threshold").over(Window.partitionBy(*keys).orderBy("rank"))
        curve = curve.withColumn("threshold", lower).where("threshold is not null")
    best = F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("threshold")).alias("t"))).alias("b")
    return curve.groupBy(*keys).agg(best).select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def ground_size(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``pred`` 1 for each key's k best scores, k its number of positives; ties by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *order))
    k = F.sum("label").over(Window.partitionBy(*keys))
    return df.withColumn("pred", (rank <= k).cast("int"))


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-sum AUC with mean ranks for ties; null with one class only."""
    by = df.groupBy(*keys, "score").agg(F.sum("label").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = by.withColumn("r", F.col("pos") * (below + (F.col("n") + 1) / 2)).groupBy(*keys).agg(
        F.sum("r").alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q")
    )
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), auc).alias("auc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    curve = pr_curve(df, keys)
    before = F.coalesce(F.lag("recall").over(Window.partitionBy(*keys).orderBy("rank")), F.lit(0.0))
    return curve.withColumn("step", (F.col("recall") - before) * F.col("precision")).groupBy(*keys).agg(F.sum("step").alias("average_precision"))


def greedy_one_to_one(df: DataFrame, source: str = "source_col_norm", target: str = "target_col_norm") -> DataFrame:
    """``pred`` 1 for the matches that best-first choice takes, each source and target once.

    Stateful within a pair, so one Arrow group for each; ties by source, then target.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", source, target], ascending=[False, True, True], kind="stable")
        used_s, used_t, pred = set(), set(), []
        for s, t in zip(pdf[source], pdf[target], strict=True):
            ok = s not in used_s and t not in used_t
            pred.append(int(ok))
            if ok:
                used_s.add(s)
                used_t.add(t)
        return pdf.assign(pred=pred)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", pred int"
    return df.groupBy("pair_id").applyInPandas(choose, schema)


def metrics_bundle(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: global metrics at score >= threshold and after one-to-one choice, AUC, average precision, sizes."""
    at = global_metrics(df.withColumn("pred", (F.col("score") >= threshold).cast("int"))).select("precision", "recall", "f1")
    one = greedy_one_to_one(df)
    one = global_metrics(one.withColumn("pred", ((F.col("pred") == 1) & (F.col("score") >= threshold)).cast("int"))).select(
        F.col("precision").alias("precision_1to1"), F.col("recall").alias("recall_1to1"), F.col("f1").alias("f1_1to1")
    )
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"))
    out = at
    for part in (one, roc_auc(df, []), average_precision(df, []), size):
        out = out.join(F.broadcast(part))  # one row each
    return out
