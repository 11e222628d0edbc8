r"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source size`` times on the
average. The whole part is certain. What is left is a probability, and pivotal
rounding settles those jointly: two undecided units exchange probability in such
amounts that the words they stand for stay the same in sum, in one of two directions
with chances that keep each one's expectation, until one of the two is at 0 or 1.

It runs as a reduction tree. Leaves are buckets of about ``bucket_rows`` documents of
one source (a source with a third of all rows has that many more buckets). In a leaf
all probabilities are equal, so the longest document is paired with all shorter ones as
one unit, then the next longest with the rest, and so on: each settles while there are
enough words in the others to make up for it, and the one left open is the shortest.
(Paired one by one the longest would stay open to the end, and miss the target by its
words.) What leaves leave meets in buckets of the next level, in pairs, until one
document is left for each source and is drawn. Where a source's lengths differ by orders
of magnitude that one may still be long: the root of the tree is settled ``TRIES`` times
from different hashes, and the outcome nearest to the target is taken (each try keeps
every chance; the choice among them favours none but by the words it misses). A level shuffles (source, row, size),
never texts, and is written to the shared folder. Chances come from hashes of the key:
reruns over the same files agree, also after lost executors.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share ``share`` of all words; a target stops at ``cap`` times the source's words and
the excess is shared again by weight. The table of sources has one row for each; it is
numbered in one task.

Defined results: a null, empty or blank text has size 0 and is taken 0 times; very long
texts are counted whole; a null source is a source; null doc_ids of any type, ties in
size and repeated rows are rounded each alone (rows alike beyond ``bucket_rows`` are
dealt to buckets by their place in the files); other columns are kept by ``stage``,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.columns import own, wrapped
from matchloom.llm.spans import sized
from matchloom.session import materialize

WEIGHTS, SHARE, CAP, BUCKET_ROWS, TRIES = (5, 2, 1), 1.5, 2.0, 4096, 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, sid, rows, source_size, target) of ``sized`` (source, size)."""
    table = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row for each source
    table = table.withColumn("sid", sid).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)
    )
    table = materialize(table, "sources")
    limit = F.col("source_size") * cap
    mass, weight, fixed = None, None, -1
    while True:
        above = F.lit(False) if mass is None else F.lit(mass) * F.col("weight") / F.lit(weight) > limit
        free, left, total, n = table.agg(
            F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, limit)), F.sum("source_size"), F.count(F.when(above, 1))
        ).first()
        if n == fixed or not free or not total:
            break
        mass, weight, fixed = share * total - (left or 0.0), float(free), n
    if mass is None:
        return table.withColumn("target", F.lit(0.0))
    return table.withColumn("target", F.least(F.lit(mass) * F.col("weight") / F.lit(weight), limit))


def _pairs(size: np.ndarray, p: np.ndarray, u: np.ndarray, open_: list[int]) -> int:
    """Pivotal rounding of ``p`` in place, one by one in the order of ``open_``; the one that stays undecided, or -1."""
    held = -1
    for i in open_:
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - p[a]), size[b] * p[b])
        down = min(size[a] * p[a], size[b] * (1 - p[b]))
        move = up if u[i] * (up + down) < down else -down
        full_a = (move > 0 and up == size[a] * (1 - p[a])) or (move <= 0 and down == size[a] * p[a])
        full_b = (move > 0 and up == size[b] * p[b]) or (move <= 0 and down == size[b] * (1 - p[b]))
        p[a], p[b] = p[a] + move / size[a], p[b] - move / size[b]
        if full_a:
            p[a] = float(move > 0)
        if full_b:
            p[b] = float(move <= 0)
        held = b if full_a and not full_b else a if full_b and not full_a else -1
    return held


def _pools(size: np.ndarray, p: np.ndarray, u: np.ndarray, open_: list[int]) -> int:
    """Pivotal rounding in place where all of ``open_`` have one probability: each with all that follow as one unit."""
    q = float(p[open_[0]])
    after = np.cumsum(size[open_][::-1])[::-1].tolist()
    for k, a in enumerate(open_[:-1]):
        s, rest = float(size[a]), after[k + 1]
        up, down = min(s * (1 - q), rest * q), min(s * q, rest * (1 - q))
        move = up if u[a] * (up + down) < down else -down
        left = q - move / rest
        if (up == s * (1 - q)) if move > 0 else (down == s * q):
            p[a] = float(move > 0)
            if 0.0 < left < 1.0:
                q = left
                continue
            p[open_[k + 1 :]] = float(left >= 1.0)
            return -1
        p[open_[k + 1 :]] = float(move <= 0)
        p[a] = q + move / s
        return a
    p[open_[-1]] = q
    return open_[-1]


def settle(size: np.ndarray, p: np.ndarray, u: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Pivotal rounding of one bucket, in the order given; at most one stays undecided, none if ``last`` has its draw."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0.0) & (p < 1.0)).tolist()
    if not open_:
        return p
    rule = _pools if (p[open_] == p[open_[0]]).all() else _pairs
    held = rule(size, p, u, open_)
    if last is not None and held >= 0:
        p[held] = float(last[held] < p[held])
    return p


def _uniform(k: np.ndarray) -> np.ndarray:
    """Splitmix64 of each, between 0 and 1."""
    with np.errstate(over="ignore"):
        k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        k = k ^ (k >> np.uint64(31))
    return (k >> np.uint64(11)) / float(1 << 53)


def _bucket(seed: int, level: int, last: bool):
    """One leaf or node of the reduction tree: long documents come first, ties in the order of a hash of the key."""

    def reduce_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "rid"], ascending=[False, True, True]).reset_index(drop=True)
        size = pdf["size"].to_numpy().astype(float)
        p = np.where(size > 0, pdf["p"].to_numpy(), 0.0)
        best, missed = p, np.inf
        for attempt in range(TRIES if last else 1):
            with np.errstate(over="ignore"):
                k = pdf["key"].to_numpy().astype("u8") + np.uint64((seed * 1_000_003 + level * 7919 + attempt * 104_729) % 2**64)
                u, draw = _uniform(k), _uniform(k ^ np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort((u, -size))
            out = np.empty(len(p))
            out[order] = settle(size[order], p[order], u[order], draw[order] if last else None)
            error = abs(float(((out - p) * size).sum()))
            if error < missed:
                best, missed = out, error
        return pdf.assign(p=best)

    return reduce_bucket


def pivotal_copies(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, seed: int = 0) -> DataFrame:
    """``rows`` (sid, n_rows, rid, key, alike, size, expected) with ``copies`` for ``expected``.

    ``rid`` names a row; ``key`` is a long that settles its chances, the same for ``alike`` rows.
    """
    base = F.floor("expected").cast("int")
    dealt = F.when(F.col("alike") > bucket_rows, F.xxhash64("key", "rid")).otherwise(F.xxhash64("key", F.lit(seed)))
    open_ = rows.select(
        "sid",
        "rid",
        "key",
        "size",
        base.alias("base"),
        (F.col("expected") - base).alias("p"),
        F.pmod(dealt, F.ceil(F.col("n_rows") / bucket_rows)).alias("bucket"),
    )
    most = rows.agg(F.max("n_rows")).first()[0] or 0
    buckets, level, done = ceil(most / bucket_rows), 0, []
    schema = "sid int, rid long, key long, size long, base int, p double, bucket long"
    while True:
        last = buckets <= 1
        settled = materialize(open_.groupBy("sid", "bucket").applyInPandas(_bucket(seed, level, last), schema), f"level{level}")
        if last:
            done.append(settled)
            break
        done.append(settled.where("p <= 0 or p >= 1"))
        open_ = settled.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / bucket_rows))
        buckets, level = ceil(buckets / bucket_rows), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("rid", F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("int")).otherwise(0).alias("copies"))


def mix(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, source): rows (rid, key, doc_id, source, size, source_size, target, copies), and the sources."""
    counted = docs.select(
        F.xxhash64(*own(docs)).alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("rid")
    )
    counted = materialize(counted, "sized")
    sources = source_targets(counted, **how)
    side = sources.select(F.col("source").alias("s"), "sid", F.col("rows").alias("n_rows"), "source_size", "target")
    placed = counted.join(sized(side), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Rows alike in such numbers are few keys.
    crowds = counted.groupBy("key").agg(F.count(F.lit(1)).alias("alike")).where(F.col("alike") > BUCKET_ROWS)
    placed = placed.join(sized(materialize(crowds, "crowds")), "key", "left").withColumn("alike", F.coalesce("alike", F.lit(1)))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chosen = pivotal_copies(placed.select("sid", "n_rows", "rid", "key", "alike", "size", expected.alias("expected")))
    return placed.join(chosen, "rid").drop("alike"), sources


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, _ = mix(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, _ = mix(docs.select(*own(docs)))
    taken = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("alike")).where("n > 0")
    taken = materialize(taken.withColumnRenamed("key", "taken_key"), "taken")
    keyed = wrapped(docs, key=F.xxhash64(*own(docs)))
    pick = lambda t: keyed.join(sized(t), F.col("key") == F.col("taken_key")).drop("taken_key")
    copies = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    joined = pick(taken.where("alike = 1")).select("row", copies(F.col("n")))
    if not taken.where("alike > 1").isEmpty():
        # Rows alike: each as often as all can be, and what is left over from one of them, dealt in parts.
        each = pick(taken.where("alike > 1 and n >= alike")).select("row", copies(F.floor(F.col("n") / F.col("alike"))))
        over = pick(taken.where("alike > 1 and n % alike > 0")).dropDuplicates(["key"]).withColumn("n", F.col("n") % F.col("alike"))
        parts = over.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET_ROWS))).alias("part"))
        parts = parts.repartition(F.xxhash64("part"))
        rest = parts.select("row", copies(F.least(F.lit(BUCKET_ROWS), F.col("n") - F.col("part") * BUCKET_ROWS)))
        joined = joined.unionByName(each).unionByName(rest)
    return joined.select("row.*")
