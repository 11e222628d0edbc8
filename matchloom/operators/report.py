"""Summaries, representatives, run-time allocation and extrapolation, table formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ranks import global_rank


def summarize(df: DataFrame, keys: list[str], metrics: list[str], unit: str = "pair_id") -> DataFrame:
    """Mean, sample standard deviation and median of each metric, rows and distinct units for each key."""
    out = [F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias(f"n_{unit}")]
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.median(m).alias(f"{m}_median")]
    return df.groupBy(*keys).agg(*out)


def summarize_units(df: DataFrame, keys: list[str], metrics: list[str], unit: str = "pair_id") -> DataFrame:
    """The same over the means of units, where a unit is tested more than once."""
    return summarize(df.groupBy(*keys, unit).agg(*[F.avg(m).alias(m) for m in metrics]), keys, metrics, unit)


def breakdown(df: DataFrame, groups: list[str], method: str, metric: str) -> DataFrame:
    """One pass over several groupings: (grouping, group, method, mean, std, median, n)."""
    entries = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group")) for g in groups])
    flat = df.select(F.explode(entries).alias("g"), method, metric).select("g.*", method, metric)
    return flat.groupBy("grouping", "group", method).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.median(metric).alias("median"), F.count(F.lit(1)).alias("n")
    )


def mean_std(mean: Column, std: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, std)


def round_half_away(x: Column, digits: int) -> Column:
    """``x`` as a double times a power of ten, rounded half away from zero, and back: SQL's round of a double (Spark's rounds the printed decimal)."""
    y = F.abs(x * 10.0**digits)
    whole = F.floor(y).cast("double")
    rounded = F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(y < 2.0**52, rounded).otherwise(x)


def mean_in_order(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, mean) of ``value``, added up in ``order``: sums of doubles that do not hang on partitions. Sorted rows spill; a group is not held."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.select(*keys, F.sum(value).over(w).alias("s"), F.count(value).over(w).alias("n"), F.row_number().over(w).alias("at"))
    last = run.groupBy(*keys).agg(F.max_by(F.struct("s", "n"), "at").alias("x"))
    return last.select(*keys, (F.col("x.s") / F.nullif("x.n", F.lit(0))).alias("mean"))


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def hours(seconds: Column) -> Column:
    return seconds / 3600.0


def representatives(sizes: DataFrame, n_bins: int, extra_largest: int, max_pairs: int) -> DataFrame:
    """``sizes`` (pair_id, candidate_pairs) with size_bin and is_timed_representative.

    Ranks (ties by pair_id) are cut into bins; taken are each bin's row nearest its
    median, the smallest row and the largest ones, which stay if ``max_pairs`` is less.
    One row for each table pair.
    """
    ends = sizes.agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(max(1, n_bins)), F.countDistinct("candidate_pairs")).alias("q"))
    ranked = global_rank(sizes, "rn", F.col("candidate_pairs"), F.col("pair_id")).join(F.broadcast(ends))  # one row
    binned = ranked.withColumn(
        "size_bin", F.greatest(F.lit(0), F.ceil((F.col("rn") - 1) * F.col("q") / F.greatest(F.col("n") - 1, F.lit(1))) - 1).cast("int")
    )
    median = binned.groupBy("size_bin").agg(F.median("candidate_pairs").alias("m"))
    off = F.abs(F.col("candidate_pairs") - F.col("m"))
    with_median = binned.join(F.broadcast(median), "size_bin")  # one row for each bin
    near = with_median.groupBy("size_bin").agg(F.min(F.struct(off.alias("off"), "rn"))["rn"].alias("near"))
    edge = (F.col("rn") == 1) | (F.col("rn") > F.col("n") - extra_largest)
    marked = binned.join(F.broadcast(near), "size_bin").withColumn("edge", edge).withColumn("take", (F.col("rn") == F.col("near")) | edge)
    out = [*sizes.columns, "size_bin"]
    keep = F.row_number().over(Window.orderBy(F.desc("edge"), "size_bin", "candidate_pairs", "rn"))  # of n_bins + extra_largest + 1 rows
    taken = marked.where("take").select(*out, (keep <= max_pairs).alias("is_timed_representative"))
    return taken.unionByName(marked.where("not take").select(*out, F.lit(False).alias("is_timed_representative")))


def nearest(df: DataFrame, reps: DataFrame, value: str, log: bool = True) -> DataFrame:
    """Each row of ``df`` with the representative nearest in ``value`` (first in pair_id order on ties).

    ``reps`` is a bounded list (``representatives`` takes ``max_pairs`` at most): it is
    held as one array and looked through for each row, no join.
    """
    f = (lambda c: F.log1p(c)) if log else (lambda c: c)
    listed = reps.agg(F.sort_array(F.collect_list(F.struct(F.col("pair_id").alias("p"), F.col(value).alias("v")))).alias("__reps"))
    best = F.array_min(F.transform("__reps", lambda r: F.struct(F.round(F.abs(f(r["v"]) - f(F.col(value))), 12).alias("d"), r["p"].alias("p"), r["v"].alias("v"))))
    return df.join(F.broadcast(listed)).withColumn("__b", best).select(
        *df.columns, F.col("__b.p").alias("representative"), F.col("__b.v").alias("representative_value")
    )


def extrapolate(nearby: DataFrame, times: DataFrame, value: str) -> DataFrame:
    """Seconds of every pair: its representative's, by size; ``times`` (pair_id, seconds), repeats averaged."""
    one = times.groupBy(F.col("pair_id").alias("representative")).agg(F.avg("seconds").alias("seconds"))
    scale = F.col(value) / F.greatest(F.col("representative_value"), F.lit(1))
    return nearby.join(one, "representative", "left").withColumn("seconds", F.col("seconds") * scale)


def allocate(df: DataFrame, keys: list[str], total_seconds: float) -> DataFrame:
    """``total_seconds`` dealt to keys by their share of rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    all_ = n.agg(F.sum("rows").alias("all_rows"))
    return n.join(F.broadcast(all_)).withColumn("seconds", F.lit(total_seconds) * F.col("rows") / F.col("all_rows")).drop("all_rows")


def efficiency(df: DataFrame, rules: DataFrame, n_pairs: int) -> DataFrame:
    """(method, seconds) and fixed costs: application is the mean pair time by ``n_pairs`` unless a rule gives it."""
    mean = df.groupBy("method").agg(F.avg("seconds").alias("m"), F.countDistinct("pair_id").alias("n_runtime_pairs"))
    both = mean.join(rules, "method", "full")
    app = F.coalesce(F.col("application_sec"), F.col("m") * n_pairs)
    total = F.coalesce("preliminary_sec", F.lit(0.0)) + F.coalesce(app, F.lit(0.0))
    return both.select(
        "method", F.col("preliminary_sec"), app.alias("application_sec"), total.alias("total_sec"), hours(total).alias("total_hours"),
        F.coalesce("n_runtime_pairs", F.lit(0)).alias("n_runtime_pairs"),
    )
