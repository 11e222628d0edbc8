"""Byte spans of texts: union, removal, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import text as tx

#: A side of more bytes than this is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 32 << 20
_WIDTH = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4}


def sized(side: DataFrame, weight: str | None = None, width: int = 16) -> DataFrame:
    """``side`` (written, so it can be measured) with a broadcast hint if it is small enough.

    Its bytes are its rows times their fixed width, and what strings, binaries and arrays hold:
    the sum of ``weight`` elements of ``width`` bytes each, or of the lengths of strings and binaries.
    """
    fixed = sum(_WIDTH.get(f.dataType.typeName(), 8) for f in side.schema.fields) + 16
    if weight is not None:
        held = F.coalesce(F.sum(F.col(weight).cast("long") * width), F.lit(0))
    else:
        long_ = [F.coalesce(F.octet_length(f"`{f.name}`").cast("long"), F.lit(0)) for f in side.schema.fields if f.dataType.typeName() in ("string", "binary")]
        held = F.coalesce(F.sum(sum(long_, F.lit(0))), F.lit(0))
    n, more = side.agg(F.count(F.lit(1)), held).first()
    return F.broadcast(side) if n * fixed + more <= BROADCAST_BYTES else side


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return s[new], e[last]


def _cut(keep_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: id, text, starts, ends."""
        for batch in batches:
            rows = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                s, e = (np.array(x.as_py() or [], "i8") for x in (s, e))
                s, e = union(s, e)
                kept, at = [], 0
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                rows.append((len(data), int((e - s).sum()), len(s), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )
        tx.release()

    return cut


def remove_spans(docs: DataFrame, spans: DataFrame, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, key) without the bytes of ``spans`` (key, starts, ends).

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, if ``keep_text``).
    Texts are shuffled only where the spans are too many to broadcast.
    """
    kind = dict(docs.dtypes)["doc_id"]
    joined = docs.join(sized(spans.withColumn("__n", F.size("starts")), "__n").drop("__n"), "key", "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(
        _cut(keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
