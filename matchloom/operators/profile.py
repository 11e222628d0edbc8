"""Column profiles: every column of a table as one text of its name and frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.catalog import normalize_name

MAX_VALUES, MAX_VALUE_CHARS, MAX_CHARS = 20, 80, 2000


def value_strings(df: DataFrame) -> list:
    """Doubles with four decimals (engines print them differently), all else as Spark casts it."""
    kinds = dict(df.dtypes)
    return [
        (F.col(f"`{c}`").cast("decimal(38,4)") if kinds[c] in ("double", "float") else F.col(f"`{c}`")).cast("string") for c in df.columns
    ]


def column_texts(
    df: DataFrame, max_values: int = MAX_VALUES, max_value_chars: int = MAX_VALUE_CHARS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """(column, norm, text): name, then the values by frequency (ties in code-point order).

    One pass: values are unpivoted and counted with partial aggregation. Nulls and
    blank values don't count; a column without values has its name as text.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in zip(df.columns, value_strings(df), strict=True)])
    values = df.select(F.explode(entries).alias("x")).select("x.column", F.btrim(F.col("x.value"), F.lit(" \t\n\x0b\x0c\r")).alias("value")).where("value <> ''")
    counts = values.groupBy("column", "value").count()
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))).where(F.col("rn") <= max_values)
    short = F.substring(F.regexp_replace("value", "[\n\r]", " "), 1, max_value_chars)
    joined = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rn", short.alias("v")))).alias("x"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")  # one row for each column
    text = F.when(F.col("x").isNull(), F.col("column")).otherwise(
        F.substring(F.concat(F.col("column"), F.lit(" || "), F.array_join(F.col("x.v"), " | ")), 1, max_chars)
    )
    return names.join(joined, "column", "left").select("column", normalize_name(F.col("column")).alias("norm"), text.alias("text"))
