"""Joins in which a hot key, with up to all rows, is met by many tasks.

A key is hot if it has more rows than ``hot_limit``: a hundred thousandth of all, and
at least ``LEAST_HOT``. So fewer than ``PARTS`` keys of a table are hot whatever its
size, and a side cut down to them can always be broadcast; no other key has more
than a hundred thousandth of the rows. Counts have partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import FILE_ROWS, materialize

PARTS, LEAST_HOT = 100_000, 1_000


def hot_limit(rows: DataFrame | int) -> int:
    """Rows of one key beyond which it is hot (``rows``: their number, or a written table: the count reads no column)."""
    return max(LEAST_HOT, (rows if isinstance(rows, int) else rows.count()) // PARTS)


def hot_join(rows: DataFrame, side: DataFrame, key: str, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` (key, c, ...) joined with ``side`` (key, c, ...; a row a key); c: the key's rows."""
    hot, rest = F.col("c") > limit, F.col("c") <= limit
    return (
        rows.where(hot).join(F.broadcast(side.where(hot).drop("c")), key, how)
        .unionByName(rows.where(rest).join(side.where(rest).drop("c"), key, how))
    )


def with_counts(rows: DataFrame, key: str, limit: int, n: int | None = None) -> DataFrame:
    """Each row whose key has a second one, with c, the rows of its key (nulls: none). ``n``: the number of ``rows``, if it is known."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(f"c > 1 and {key} is not null")
    counts = materialize(counts, "counts", n, 8 * FILE_ROWS)
    hot = counts.where(F.col("c") > limit)
    if hot.isEmpty():
        return rows.join(counts, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counts.where(F.col("c") <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def split_join(rows: DataFrame, side: DataFrame, key: str | list[str], count: str, limit: int) -> DataFrame:
    """``rows`` joined with ``side`` (a row a key; ``count``: the key's rows), both cheap to make again or written; hot keys are broadcast."""
    hot = side.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(side, key)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(side.where(F.col(count) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def deal_join(pairs: DataFrame, side: DataFrame, key: str, other: str, counted: DataFrame | None = None) -> DataFrame:
    """``pairs`` joined with ``side`` (a row a key); the rows of a hot key are dealt to parts by ``other``.

    ``side`` is repeated once for each part of its key. ``counted`` is a written table
    with the keys of ``pairs``, if ``pairs`` themselves are not.
    """
    counted = pairs if counted is None else counted
    limit = hot_limit(counted)
    count = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > limit)
    hot = materialize(count.select(key, F.ceil(F.col("__c") / limit).cast("int").alias("__parts")), "hot")
    if hot.isEmpty():
        return pairs.join(side, key)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = pairs.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(other), parts).cast("int"))
    many = side.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(many.drop("__parts"), [key, "__part"]).drop("__part")
