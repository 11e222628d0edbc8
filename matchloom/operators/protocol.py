"""The comparison of methods by their saved scores: folds, thresholds learned on the other folds, method against method."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.evaluate import ground_size, pr_threshold, ratio
from matchloom.operators.stats import sign_test_column, wilcoxon_column

KEYS = ["pair_id", "source_col_norm", "target_col_norm"]
RUN = ["run_id", "method"]
PREDICTIONS = ("opt_train", "ground_size")


def labelled_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``scores`` (run_id, fold_id, method, keys, score) with the label of the same fold and candidate; others go."""
    return scores.join(labels.select("fold_id", *KEYS, "label"), ["fold_id", *KEYS])


def train_thresholds(df: DataFrame) -> DataFrame:
    """(run_id, method, fold_id, threshold): the best one on the rows of all other folds, 0.5 if these have one class.

    Rows are reduced to counts of distinct scores before they meet the other folds, of
    which a run has a few.
    """
    cells = df.groupBy(*RUN, "fold_id", "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    folds = df.select(*RUN, F.col("fold_id").alias("held")).distinct()
    train = cells.join(folds, RUN).where("held <> fold_id").groupBy(*RUN, "held", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    best = pr_threshold(train, [*RUN, "held"], "faithful", counted=True)
    classes = train.groupBy(*RUN, "held").agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    two = classes.where("p > 0 and p < all").join(best, [*RUN, "held"]).select(*RUN, F.col("held").alias("fold_id"), "threshold")
    return folds.withColumnRenamed("held", "fold_id").join(two, [*RUN, "fold_id"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def predictions(df: DataFrame) -> DataFrame:
    """``df`` with threshold, pred_opt_train (score >= threshold) and pred_ground_size (as many as there are positives, by score)."""
    ranked = ground_size(df, [*RUN, "fold_id", "pair_id"], KEYS[1:]).withColumnRenamed("pred", "pred_ground_size")
    both = ranked.join(train_thresholds(df), [*RUN, "fold_id"])
    return both.withColumn("pred_opt_train", (F.col("score") >= F.col("threshold")).cast("int"))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of both predictions for each key, with rows, positives and pairs."""
    n = lambda c: F.sum(c.cast("long"))
    label, out = F.col("label"), [F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), F.countDistinct("pair_id").alias("n_pair_id")]
    for p in PREDICTIONS:
        pred = F.col(f"pred_{p}")
        out += [n((label == 1) & (pred == 1)).alias(f"tp_{p}"), n(pred == 1).alias(f"n_{p}")]
    counts = df.groupBy(*keys, "threshold").agg(*out)
    made = [c for p in PREDICTIONS for c in (
        ratio(F.col(f"tp_{p}"), F.col(f"n_{p}")).alias(f"precision_{p}"), ratio(F.col(f"tp_{p}"), F.col("n_positive")).alias(f"recall_{p}"),
        ratio(2 * F.col(f"tp_{p}"), F.col(f"n_{p}") + F.col("n_positive")).alias(f"f1_{p}"),
    )]
    return counts.select(*keys, "threshold", "n_rows", "n_positive", "n_pair_id", *made)


def fold_metrics(df: DataFrame) -> DataFrame:
    return metrics(df, [*RUN, "fold_id"])


def pair_metrics(df: DataFrame) -> DataFrame:
    return metrics(df, [*RUN, "fold_id", "pair_id"]).drop("n_pair_id")


def summarize_methods(pairs: DataFrame) -> DataFrame:
    """Means over pair rows, sample deviations of F1, distinct pairs and runs of each method."""
    out = [F.avg(f"{m}_{p}").alias(f"mean_{m}_{p}") for p in PREDICTIONS for m in ("f1", "precision", "recall")]
    out += [F.stddev_samp(f"f1_{p}").alias(f"std_f1_{p}") for p in PREDICTIONS]
    return pairs.groupBy("method").agg(*out, F.countDistinct("pair_id").alias("n_pair_id"), F.countDistinct("run_id").alias("n_runs"))


def best_method(pairs: DataFrame, metric: str, prefix: str) -> DataFrame:
    """(best): the method with the highest mean of those whose name starts with ``prefix``, of all if there is none."""
    mean = pairs.groupBy("method").agg(F.avg(metric).alias("m"))
    own = F.col("method").startswith(prefix).cast("int").alias("own")
    return mean.agg(F.max(F.struct(own, F.col("m"), F.col("method"))).alias("b")).select(F.col("b.method").alias("best"))


def against_best(pairs: DataFrame, metric: str, prefix: str) -> DataFrame:
    """The best method against every other: on shared (run, pair); where there are none, on the pairs' means over runs."""
    best = best_method(pairs, metric, prefix)
    rows = pairs.join(F.broadcast(best)).select("best", "method", "run_id", "pair_id", F.col(metric).alias("v"))  # one row
    top = rows.where("method = best").select("best", "run_id", "pair_id", F.col("v").alias("x"))
    other = rows.where("method <> best").select("method", "run_id", "pair_id", F.col("v").alias("y"))
    exact = top.join(other, ["run_id", "pair_id"]).select("best", "method", "pair_id", "x", "y", F.lit("run_id+pair_id").alias("paired_on"))
    mean = lambda df, keys, c: df.groupBy(*keys, "pair_id").agg(F.round(F.avg(c), 9).alias(c))  # noqa: E731  equal means are ties in any order of summation
    rest = other.join(exact.select("method").distinct(), "method", "left_anti")
    loose = mean(top, ["best"], "x").join(mean(rest, ["method"], "y"), "pair_id").select(
        "best", "method", "pair_id", "x", "y", F.lit("pair_id_mean_over_runs").alias("paired_on")
    )
    d = F.col("x") - F.col("y")
    n = lambda c: F.count(F.when(c, 1))
    out = exact.unionByName(loose).groupBy("best", "method", "paired_on").agg(
        F.count(F.lit(1)).alias("n_pairs_runs"), n(d > 0).alias("wins"), n(d == 0).alias("ties"), n(d < 0).alias("losses"),
        F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.collect_list(F.when(d != 0, d)).alias("deltas"),
    )
    return out.withColumns(
        {
            "winrate_half_ties": (F.col("wins") + 0.5 * F.col("ties")) / F.col("n_pairs_runs"),
            "sign_test_pvalue": sign_test_column(F.col("wins"), F.col("losses")),
            "wilcoxon_pvalue": wilcoxon_column(F.col("deltas")),
        }
    ).drop("deltas")


def ordered(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Rows of the listed values of ``column``, in the order of the list, then by ``then``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.where(F.col(column).isin(order)).orderBy(place, *then)


def save_result(predictions: DataFrame, folder: str, payload: dict) -> str:
    """``predictions.parquet`` and ``metrics.json`` (``payload``, which holds name, seconds and metrics) in ``folder``."""
    spark = predictions.sparkSession
    predictions.write.mode("overwrite").parquet(f"{folder}/predictions.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/metrics.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(payload, indent=2).encode()))
    finally:
        out.close()
    return folder


def first_of_each(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Of rows alike in ``keys`` the one with the best ``metric``."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
