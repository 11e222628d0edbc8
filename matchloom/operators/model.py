"""Classifiers over feature columns, and feature selection, on Spark ML."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import forest
from matchloom.operators.evaluate import best_threshold, global_metrics, pair_metrics
from matchloom.session import discard, materialize


def build_model(kind: str, features: list[str], trees: int = 350, depth: int = 30, seed: int = 42, scale: bool = True) -> Pipeline:
    """``rf`` or ``logreg`` over robustly scaled features (``scale``), rows weighted by ``weight``."""
    assembler = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep")
    scaler = [RobustScaler(inputCol="__raw", outputCol="__features", withCentering=True)] if scale else []
    column = "__features" if scale else "__raw"
    common = {"featuresCol": column, "labelCol": "label", "weightCol": "weight"}
    if kind == "rf":
        # node ids are kept beside the rows, so that a level is no walk of all rows from all roots; the forest is the same
        last = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, **common)
    elif kind == "logreg":
        last = LogisticRegression(maxIter=100, **common)
    else:
        raise ValueError(kind)
    return Pipeline(stages=[assembler, *scaler, last])


def balanced(df: DataFrame) -> DataFrame:
    """``df`` with ``weight``: classes weigh the same in sum."""
    n = df.groupBy("label").count()
    total = n.agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("classes"))
    weights = n.join(F.broadcast(total)).select("label", (F.col("all") / (F.col("classes") * F.col("count"))).alias("weight"))
    return df.join(F.broadcast(weights), "label")  # one row for each class


def dealt(df: DataFrame, features: list[str], tasks: int = 16, rows: int = 20_000) -> DataFrame:
    """``df`` over at least ``tasks`` partitions of about ``rows``: a small table is one file part, and a forest's work is trees times rows, not bytes."""
    return df.repartition(max(tasks, df.count() // rows + 1)).sortWithinPartitions(*features, "label")


def fit(kind: str, train: DataFrame, features: list[str], **how):
    """A forest is grown by trees (``forest.grow``; order is all that trees see, so they need no scaling), by levels where that makes none."""
    if kind == "rf":
        grown = forest.grow(train, features, **{k: v for k, v in how.items() if k != "scale"})
        if grown is not None:
            return grown
    rows = balanced(train)
    return build_model(kind, features, **how).fit(dealt(rows, features) if kind == "rf" else rows)


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with ``score``, the probability of class 1."""
    if isinstance(model, forest.Forest):
        return model.score(df)
    out = model.transform(df.withColumn("weight", F.lit(1.0)))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def train_and_predict(train: DataFrame, test: DataFrame, features: list[str], kind: str = "rf", **how) -> DataFrame:
    return score(fit(kind, train, features, **how), test)


def evaluate(train: DataFrame, test: DataFrame, features: list[str], kind: str = "rf", **how) -> tuple[DataFrame, DataFrame]:
    """(pair metrics of ``test``, the threshold chosen on ``train``)."""
    model = fit(kind, train, features, **how)
    chosen = best_threshold(score(model, train))
    scored = score(model, test).join(F.broadcast(chosen))  # one row
    return pair_metrics(scored.withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))), chosen


def evaluate_folds(
    rows: DataFrame, folds: DataFrame, configurations: dict[str, list[str]], seeds: tuple[int, ...] = (42,), **how
) -> tuple[DataFrame, DataFrame]:
    """(fold rows, pair rows) of every configuration, seed and fold.

    ``folds`` (fold_id, pair_id, role) deals ``rows`` (pair_id, label, features). A fold
    row has the threshold that is best on the fold's train rows, its mean F1 there, the
    seconds of fitting, of scoring both sides, and the metrics of the test rows; a pair
    row has the metrics of one test pair. The loop is over models; all rows stay in Spark.
    """
    spark = rows.sparkSession
    dealt = materialize(rows.join(folds, "pair_id"), "dealt-rows")
    numbers = [r[0] for r in folds.select("fold_id").distinct().orderBy("fold_id").collect()]  # a few
    made, pairs = [], None
    for run_id, seed in enumerate(seeds, 1):
        for name, features in configurations.items():
            for k in numbers:
                train, test = (dealt.where((F.col("fold_id") == k) & (F.col("role") == role)) for role in ("train", "test"))
                start = time.perf_counter()
                model = fit("rf", train, features, seed=seed + k, scale=False, **how)
                fitted = time.perf_counter()
                known = materialize(score(model, train).select("pair_id", "label", "score"), "train-scores")
                scored = time.perf_counter()
                found = materialize(score(model, test).select("pair_id", "label", "score"), "test-scores")
                done = time.perf_counter()
                threshold, best = best_threshold(known).first()
                pred = found.withColumn("pred", (F.col("score") > threshold).cast("int"))
                metrics = global_metrics(pred).first()
                made.append((run_id, seed, name, k, len(features), threshold, best, fitted - start, scored - fitted, done - scored, metrics["precision"], metrics["recall"], metrics["f1"], " | ".join(features)))
                one = pair_metrics(pred).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("config"), F.lit(k).alias("fold_id"), "*", F.lit(len(features)).alias("n_features"))
                pairs = one if pairs is None else pairs.unionByName(one)
                discard(known, *([model.frame] if isinstance(model, forest.Forest) else []))
    fold_rows = spark.createDataFrame(
        made,
        "run_id int, seed int, config string, fold_id int, n_features int, threshold_opt_train double, train_mean_f1_pair_at_threshold double, "
        "fit_sec double, train_score_sec double, predict_sec double, precision double, recall double, f1 double, features string",
    )
    return fold_rows, materialize(pairs, "pair-rows")


def summarize_folds(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Of each configuration: mean and sample deviation of the pair metrics, pairs, features, mean seconds of a fold."""
    out = [f(m).alias(f"{k}_{m}") for m in ("f1", "precision", "recall") for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    of_pairs = pairs.groupBy("config").agg(*out, F.countDistinct("pair_id").alias("n_pair_id"), F.first("n_features").alias("n_features"))
    seconds = [F.avg(c).alias(f"mean_{c}") for c in ("fit_sec", "train_score_sec", "predict_sec")]
    return of_pairs.join(folds.groupBy("config").agg(*seconds), "config")


def summarize_seeds(pairs: DataFrame) -> DataFrame:
    """Repeated seeds: the mean F1 of each run first, then mean, sample deviation and number of the runs."""
    by_run = pairs.groupBy("config", "run_id").agg(*[F.avg(m).alias(m) for m in ("f1", "precision", "recall")])
    out = [f(m).alias(f"{k}_{m}") for m in ("f1", "precision", "recall") for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return by_run.groupBy("config").agg(*out, F.count(F.lit(1)).alias("n_runs"))


def mutual_information(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, mi) of equal-width bins with the label, in nats; all features in one pass."""
    ends = df.agg(*[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    cell = lambda i, c: F.when(
        F.lit(ends[f"hi_{i}"] > ends[f"lo_{i}"]),
        F.least(F.lit(bins - 1), F.floor((F.col(c) - ends[f"lo_{i}"]) / (ends[f"hi_{i}"] - ends[f"lo_{i}"] or 1) * bins)),
    ).otherwise(0)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), cell(i, c).cast("int").alias("bin")) for i, c in enumerate(features)])
    counts = df.select("label", F.explode(entries).alias("x")).groupBy("x.feature", "x.bin", "label").count()
    n = counts.groupBy("feature").agg(F.sum("count").alias("n"))
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("count").alias("nb"))
    by_label = counts.groupBy("feature", "label").agg(F.sum("count").alias("nl"))
    j = counts.join(n, "feature").join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "label"])
    return j.groupBy("feature").agg(
        F.sum(F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("nb") * F.col("nl")))).alias("mi")
    )


def correlations(df: DataFrame, features: list[str]) -> dict[tuple[str, str], float]:
    """Pearson's r of every two features; the matrix has one row for each feature."""
    vec = VectorAssembler(inputCols=features, outputCol="__v").transform(df.select(*features))
    m = Correlation.corr(vec, "__v").first()[0].toArray()
    return {(a, b): float(m[i, j]) for i, a in enumerate(features) for j, b in enumerate(features) if i < j}


def select_features(df: DataFrame, features: list[str], limit: float = 0.85, k: int = 10, trees: int = 50, seed: int = 42) -> list[str]:
    """Of correlated features the one that tells more about the label, then the ``k`` most important to a forest."""
    mi = {r["feature"]: r["mi"] for r in mutual_information(df, features).collect()}
    r = correlations(df, features)
    kept: list[str] = []
    for f in sorted(features, key=lambda f: (-(mi.get(f) or 0.0), f)):
        if all(abs(r.get((f, g), r.get((g, f), 0.0))) <= limit for g in kept):
            kept.append(f)
    model = build_model("rf", kept, trees=trees, depth=10, seed=seed, scale=False).fit(balanced(df))
    importance = model.stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip((-importance).tolist(), kept, strict=True))][:k]
