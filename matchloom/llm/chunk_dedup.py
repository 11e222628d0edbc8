r"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash shifts left by one bit and adds a random number for each byte, so its
value hangs on the last 64 bytes. A chunk ends where the hash's five highest bits are
zero, no sooner than ``LEAST`` bytes and no later than ``MOST`` bytes after its start.
Ends follow content and not offsets: after an insertion the chunking falls in step
again, and a passage that documents share has the same chunks in all of them.

Chunks are named by 128-bit digests. For each digest the first occurrence stays (the
smallest doc_id, null last, then the earliest row and place), all others are removed.
A last chunk of less than ``LEAST`` bytes would equal others by chance: it is named
together with the chunk before it, and a text that is one short chunk by itself. (Without
``whole`` these short chunks are not compared; the query compares them.) Digests are
counted with partial aggregation; those that occur once, most of them, go no further.
Occurrences of a hot digest, which may be a third of all, are met by many tasks
(``skew.py``).

Defined results: a null or empty text has no chunks; very long texts are chunked whole,
their hashes in blocks; repeated rows lose all but one copy; of ties (equal doc_ids, of
any type) the earlier row of the files stays, null doc_ids come last; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import text as tx
from matchloom.llm.skew import hot_limit, split_join
from matchloom.session import materialize

LEAST, MOST, BITS = 64, 1024, 5
#: Bytes of a text whose hashes are held at once.
BLOCK = 1 << 20
_GEAR = tx.mix(tx._CODE + np.uint64(7))


def gear(b: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum over j < 64 of GEAR[b[i - j]] << j, by doubling."""
    h = _GEAR[b]
    for shift in (1, 2, 4, 8, 16, 32):
        longer = h.copy()
        longer[shift:] += h[:-shift] << np.uint64(shift)
        h = longer
    return h


def candidates(b: np.ndarray) -> list[int]:
    """Where a chunk may end (one past its last byte)."""
    out = []
    for at in range(0, len(b), BLOCK):
        lead = min(at, 63)
        h = gear(b[at - lead : at + BLOCK])[lead:]
        out.append(np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + at + 1)
    return np.concatenate(out).tolist() if out else []


def cut_points(b: np.ndarray) -> list[int]:
    """Ends of the chunks of ``b``, the last at its end."""
    ends, all_, at, k = [], candidates(b), 0, 0
    while at < len(b):
        k = bisect_left(all_, at + LEAST, k)
        at = min(all_[k] if k < len(all_) else len(b), at + MOST, len(b))
        ends.append(at)
    return ends


def _digest(data: bytes, before: int, begin: int, end: int, whole: bool) -> bytes | None:
    """The name of the chunk from ``begin`` to ``end``; the one before starts at ``before``."""
    if end - begin >= LEAST:
        return hashlib.blake2b(data[begin:end], digest_size=16).digest()
    if whole and end > begin:
        return hashlib.blake2b(data[before:end], digest_size=16, person=b"short end").digest()
    return None


def _chunks(batches: Iterator[pa.RecordBatch], short: bool) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for i, j, data, at in tx.pieces(batch.column(1)):
            rows, n, starts, sizes, digests = [], [], [], [], []
            whole = data.tobytes()
            for r in range(j - i):
                base = int(at[r])
                ends = cut_points(data[base : at[r + 1]]) or [0]
                before = begin = 0
                for e in ends:
                    starts.append(begin)
                    sizes.append(e - begin)
                    digests.append(_digest(whole, base + before, base + begin, base + e, short))
                    before, begin = begin, e
                rows.append(row)
                n.append(len(ends))
                row += 1
            ids = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(rows, "i8"), n)), ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                names=["row", "doc_id", "start", "size", "digest"],
            )
    tx.release()


def chunk_duplicates(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): row, doc_id, n_bytes, n_chunks, and starts and ends of removed chunks.

    With ``whole`` chunks of less than ``LEAST`` bytes are compared too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = docs.select("doc_id", "text").mapInArrow(lambda b: _chunks(b, whole), f"row long, doc_id {kind}, start long, size long, digest binary")
    chunks = materialize(chunks, "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), "row", "start")
    named = chunks.where("digest is not null")
    shared = named.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep")).where("n > 1")
    shared = materialize(shared.select("digest", "n", F.col("keep.row").alias("keep_row"), F.col("keep.start").alias("keep_start")), "shared-digests")
    met = split_join(named.select("digest", "row", "start", "size"), shared, "digest", "n", hot_limit(chunks))
    gone = met.where("row <> keep_row or start <> keep_start").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("x")
    )
    rows = chunks.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("size").alias("n_bytes"), F.count(F.when(F.col("size") > 0, 1)).alias("n_chunks")
    )
    empty = F.array().cast("array<long>")
    return rows.join(gone, "row", "left").select(
        "row", "doc_id", "n_bytes", "n_chunks", F.coalesce(F.col("x.start"), empty).alias("starts"), F.coalesce(F.col("x.end"), empty).alias("ends")
    )


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=True)
    size = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_bytes", "n_chunks", F.size("starts").cast("long").alias("n_removed_chunks"), size.alias("n_removed"), (size > 0).alias("removed")
    )
