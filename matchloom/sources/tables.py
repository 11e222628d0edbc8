"""Readers and writers: tables by suffix, JSON, JSON lines, capped CSV scans, run-time logs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.sources.catalog import normalize_name

SUFFIXES = (".parquet", ".csv.gz", ".csv")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, plain or gzipped, by the path's suffix. Works on any Hadoop path."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_stem(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """The first of stem.parquet, stem.csv.gz, stem.csv that is there."""
    for suffix in SUFFIXES:
        if exists(spark, path := f"{folder}/{stem}{suffix}"):
            return read_table(spark, path)
    raise FileNotFoundError(f"{folder}/{stem}{{{','.join(SUFFIXES)}}}")


def write_table(df: DataFrame, path: str) -> str:
    """By suffix; returns the path."""
    if path.endswith((".csv", ".csv.gz")):
        df.write.mode("overwrite").option("compression", "gzip" if path.endswith("gz") else "none").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_runtime(df: DataFrame, path: str) -> str | None:
    """A run-time log; nothing for no rows."""
    return None if df.isEmpty() else write_table(df, path)


#: Spellings of a missing value in CSV files; fixed values.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def scan_csv(spark: SparkSession, path: str, rows: int | None = 5000, typed: bool = False, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """A CSV with a header, its first ``rows`` lines (None, 0 or less: all), which is a feature of profiling.

    Values spelled as in ``missing`` are null. Columns are strings; ``typed`` infers
    their types from all values that are left, as long, double, boolean or string.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.limit(rows) if rows and rows > 0 else df
    df = df.select(*[F.when(~F.coalesce(F.col(f"`{c}`"), F.lit("")).isin(*missing), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if not typed or not df.columns:
        return df
    fits = lambda c, kind: F.coalesce(F.min(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(kind).isNotNull()), F.lit(False))
    kinds = ("bigint", "double", "boolean")
    found = df.agg(*[fits(c, k).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds]).first()  # one row
    kind = {c: next((k for k in kinds if found[f"{i}_{k}"]), "string") for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").cast(kind[c]).alias(c) for c in df.columns])


def read_json(path: str):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(value, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str), encoding="utf-8")
    return path


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


# Score files


def adapt_scores(df: DataFrame) -> DataFrame:
    """pair_id, source_col_norm, target_col_norm, score from the known spellings of those columns.

    Names are trimmed and in lower case, scores that are no numbers are 0.
    """
    names = {"source_col_norm": ("source_col_norm", "source_column"), "target_col_norm": ("target_col_norm", "target_column"), "score": ("score", "similarity")}
    found = {k: next((c for c in options if c in df.columns), None) for k, options in names.items()}
    missing = [k for k, c in found.items() if c is None] + ["pair_id"] * ("pair_id" not in df.columns)
    if missing:
        raise ValueError(f"no columns for {', '.join(missing)}")
    norm = lambda c: normalize_name(F.col(c))
    return df.select(
        F.col("pair_id").cast("string").alias("pair_id"),
        norm(found["source_col_norm"]).alias("source_col_norm"),
        norm(found["target_col_norm"]).alias("target_col_norm"),
        number_or_zero(F.col(found["score"])).alias("score"),
    )


def number_or_zero(c: Column) -> Column:
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def normalise_scores(df: DataFrame, source_file: str) -> DataFrame:
    """Method scores with their run, fold and method, and the file they come from."""
    norm = lambda c: normalize_name(F.col(c)).alias(c)
    return df.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("fold_id").cast("int").alias("fold_id"), F.col("method").cast("string").alias("method"),
        F.col("pair_id").cast("string").alias("pair_id"), norm("source_col_norm"), norm("target_col_norm"),
        number_or_zero(F.col("score")).alias("score"), F.lit(source_file).alias("score_source_file"),
    )


def union_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All of the files that are there; missing ones are skipped."""
    frames = [read_table(spark, p) for p in paths if exists(spark, p)]
    if not frames:
        raise FileNotFoundError("none of the files is there")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def left_join_scores(test: DataFrame, scores: DataFrame) -> DataFrame:
    """Every test row with its score; 0 where there is none, the best where there are several."""
    keys = ["pair_id", "source_col_norm", "target_col_norm"]
    one = scores.groupBy(*keys).agg(F.max("score").alias("score"))
    return test.drop("score").join(one, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
