"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** cell_bits`` points. Each shard owns ``vnodes`` of them; a row's
key hashes to a point and belongs to the first virtual node clockwise. A shard
takes no more than its capacity: the rows, taken in ring order, that find it full
go on clockwise to the next shard with room. Capacities are the mean, rounded up
for the first shards and down for the others, so that the law ``rows`` holds: any
two shards differ by one row at most.

Only the number of rows at each ring point reaches the driver (at most
``2 ** cell_bits`` pairs, whatever the input). There the walk along the ring is
replayed on those counts, which says for each point which ranks go to which shard.
Rows then need no more than their rank among the rows of their own point: one
shuffle, by point, in pieces of rows / 2 ** cell_bits. ``cell_bits`` is chosen by
the caller for the size of the corpus (14 serves about 10 ** 10 rows).

Defined results: a null key of any type is a key like any other (rows are told apart by
the other key columns), a null or empty text has size 1 and very long ones their whole
size, rows of one hash (ties) are ordered by their key columns, repeated rows each get a
slot of their own (rows alike in all key columns share a point), other columns are kept
whatever their names, but those called like the two new ones are replaced by these; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.columns import free_name, own, wrapped

N_SHARDS, VNODES, CELL_BITS = 16, 64, 14


def ring(n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest())
    return sorted((at(s, v) % cells, s) for s in range(n_shards) for v in range(vnodes))


def capacities(n: int, n_shards: int) -> list[int]:
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def place(counts: dict[int, int], n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each point go where: (point, from rank, to rank, shard, first slot).

    ``counts`` holds the number of rows of each point. At most one entry for each
    point and one for each time a shard fills up.
    """
    nodes = ring(n_shards, vnodes, cells)
    points = [p for p, _ in nodes]
    room, used = capacities(sum(counts.values()), n_shards), [0] * n_shards
    onward = list(range(len(nodes)))  # from a node whose shard is full to a later one

    def with_room(k: int) -> int:
        path = []
        while room[nodes[k][1]] == 0:
            path.append(k)
            k = onward[k] if onward[k] != k else (k + 1) % len(nodes)
        for x in path:
            onward[x] = k
        return k

    out = []
    for cell in sorted(counts):
        rank, left, k = 0, counts[cell], bisect_left(points, cell) % len(nodes)
        while left:
            k = with_room(k)
            shard = nodes[k][1]
            take = min(left, room[shard])
            out.append((cell, rank, rank + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            rank += take
            left -= take
    return out


def shard_rows(
    df: DataFrame,
    key: list[str],
    n_shards: int = N_SHARDS,
    vnodes: int = VNODES,
    cell_bits: int = CELL_BITS,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """``df`` and each row's ``shard`` and its ``slot`` in it, gapless from 0.

    ``key`` columns decide the place on the ring; rows of one point follow each other
    by the whole hash and the key columns. Reruns on the same rows agree.
    """
    spark, cells = df.sparkSession, 1 << cell_bits
    hash_ = F.xxhash64(*[F.col(f"`{k}`") for k in key])
    rows = wrapped(df, hash=hash_).withColumn("cell", F.shiftrightunsigned("hash", 64 - cell_bits).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}
    plan = spark.createDataFrame(place(counts, n_shards, vnodes, cells) or [(0, 0, 0, 0, 0)], "cell int, lo long, hi long, into int, at long")
    order = Window.partitionBy("cell").orderBy("hash", *[F.col(f"row.`{k}`") for k in key])
    ranked = rows.withColumn("rank", F.row_number().over(order) - F.lit(1))
    # The plan has one row for each point and for each time a shard fills up, so its size is bounded.
    found = ranked.join(F.broadcast(plan), "cell").where("rank >= lo and rank < hi")
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    return found.select(*kept, F.col("into").alias(shard), (F.col("at") + F.col("rank") - F.col("lo")).alias(slot))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = shard_rows(docs, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    name = free_name(docs, "key")
    return shard_rows(docs.withColumn(name, F.xxhash64(*own(docs))), [name]).drop(name)
