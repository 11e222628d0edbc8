r"""Language-model scores from a log-frequency Bloom filter.

Training counts every word and every pair of neighbouring words of the training
documents (each document ends with one end token, which is also the context of its
first word). Tasks count their own rows, and send the counts as sorted, packed
runs to buckets by hash; a bucket adds them up. So what is shuffled follows the
corpus, and no key is hot.

Counts are quantised to levels, ``1 + floor(log2(count / least count))``, and an
n-gram is put into the filter once for each of its levels. A query probes level 1,
2, ... up to the highest one trained, until one is missing; the last one found gives the
count. Words are stored from count 1, pairs from count 2 on (a pair seen once tells less
than its words). Every bucket fills its own segment of the filter; the number of buckets
follows the bytes of the corpus alone (``BUCKET_BYTES`` for each), and the filter has
``BITS_PER_ENTRY`` bits for each entry, however many there are. So the bits, and with
them the scores, hang on the corpus and on no setting of the session. Up to ``MAX_FILTER_BYTES`` it is collected
and broadcast. A larger one stays in its segments in the shared folder: chunks of
documents send their distinct n-grams to the buckets, and the levels come back to the
chunks. Both ways read the same bits and give the same scores.

A word's probability is the pair's count smoothed by the word's: (c2 + MU * p1) /
(c1 + MU) with p1 = (c + 0.1) / (N + 0.1 (V + 1)), counts as the filter gives them.

The exact base score needs exact counts of all words. Those of the most frequent
ones (at most ``FREQUENT`` of them) are broadcast as a table; a document's other
words are joined to the counts by a shuffle. Both paths are exact, together they
cover every word.

Defined results: a null or empty text is one end token; a null doc_id (of any type)
counts as held out; very long texts are whole; n-grams with equal counts (ties) have
equal levels; repeated rows are scored alike; other columns are not read, whatever their
names; an empty table gives no rows, and a model of no documents knows no token.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchloom.llm import text as tx
from matchloom.session import materialize

ADD, MU = 0.1, 8.0
FREQUENT = 1 << 19
BITS_PER_ENTRY, PROBES, MAX_FILTER_BYTES = 10, 4, 64 << 20
LEAST_COUNT = {1: 1, 2: 2}
#: Bytes of text whose n-grams one bucket takes, and the bits of a bucket's number at most (the pairs' keys have 24 to spare).
BUCKET_BYTES, MOST_BUCKET_BITS, MOST_PARTITIONS = 8 << 20, 22, 1 << 15
FLUSH = 1 << 21
#: Tokens of the documents that are scored together, and bytes of n-grams in one task, where the filter is stored.
CHUNK, LOOKED_UP_BYTES = 1 << 20, 64 << 20
END = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' words, each row's followed by the end token; offsets of the rows)."""
    start, length, first = tx.words(data, at)
    h = tx.word_hashes(data, start, length)
    ends = first[1:] + np.arange(len(first) - 1)
    out = np.full(len(h) + len(ends), END, "u8")
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = h
    return out, np.concatenate(([0], ends + 1))


def pairs(t: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a row's first follows an end token."""
    before = np.concatenate(([END], t[:-1]))
    return tx.mix(t * np.uint64(0x9E3779B97F4A7C15) + tx.mix(before + np.uint64(1)))


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, laid out by byte so that compression takes the zeros."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return b"".join(x.view("u1").reshape(-1, 8).T.tobytes() for x in (step, counts.astype("<u8")))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, "u1").reshape(2, 8, -1)
    step, counts = (np.ascontiguousarray(x[k].T).view("<u8").ravel() for k in (0, 1))
    return np.cumsum(step, dtype="u8"), counts


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


def _count(bucket_bits: int):
    """(kind, bucket, blob) of the n-grams of a task's rows."""

    def flush(kind: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = add_up(np.concatenate(parts))
        if kind == 2:  # 40 bits beside the bucket's are enough for a filter
            keys = keys & ~np.uint64((1 << (24 - bucket_bits)) - 1)
            keys, counts = add_up(keys, counts)
        cut = np.searchsorted(keys, np.arange(1 << bucket_bits, dtype="u8") << np.uint64(64 - bucket_bits))
        cut = np.append(cut, len(keys))
        there = np.flatnonzero(np.diff(cut))
        low = np.uint64(24 - bucket_bits if kind == 2 else 0)
        top = np.uint64((1 << (64 - bucket_bits)) - 1)
        blobs = [pack((keys[cut[b] : cut[b + 1]] & top) >> low, counts[cut[b] : cut[b + 1]]) for b in there]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(there), kind, "i4")), pa.array(there.astype("i4")), pa.array(blobs, pa.binary())],
            names=["kind", "bucket", "blob"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        n = 0
        for batch in batches:
            for _, _, data, at in tx.pieces(batch.column(0)):
                t, _ = tokens(data, at)
                held[1].append(t)
                held[2].append(pairs(t))
                n += len(t)
                if n >= FLUSH:
                    for kind in (1, 2):
                        yield flush(kind, held[kind])
                        held[kind].clear()
                    n = 0
        if n:
            for kind in (1, 2):
                yield flush(kind, held[kind])
        tx.release()

    return count


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket's totals; of pairs those that are frequent enough."""
    kind = key[0].as_py()
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    keys, counts = add_up(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    enough = counts >= LEAST_COUNT[kind]
    keys, counts = keys[enough], counts[enough]
    levels = level(counts, kind)
    return pa.table(
        {
            "kind": pa.array([kind], pa.int32()),
            "bucket": pa.array([key[1].as_py()], pa.int32()),
            "entries": pa.array([int(levels.sum())], pa.int64()),
            "top": pa.array([int(levels.max(initial=0))], pa.int32()),
            "blob": pa.array([pack(keys, counts)], pa.binary()),
        }
    )


def level(counts: np.ndarray, kind: int) -> np.ndarray:
    return np.where(counts >= LEAST_COUNT[kind], 1 + np.floor(np.log2(np.maximum(counts / LEAST_COUNT[kind], 1) + 1e-9)), 0).astype("i8")


def value(levels: np.ndarray, kind: int) -> np.ndarray:
    """The middle of the counts of a level."""
    two = 2.0 ** (levels - 1)
    return np.where(levels > 0, LEAST_COUNT[kind] * (two + 2 * two - 1) / 2, 0.0)


def _probe_bits(keys: np.ndarray, j: int, kind: int, bits: int) -> Iterator[np.ndarray]:
    h = tx.mix(keys * np.uint64(2) + np.uint64((kind - 1 + j * 0xD6E8FEB86659FD93) % 2**64))
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


class LogFrequencyFilter:
    """Segments of equal size, one for each bucket of each kind's keys, from bucket ``first`` on; ``top``: the highest level in it."""

    def __init__(self, bucket_bits: int, segment_bytes: int, top: int, data: np.ndarray, first: int = 0) -> None:
        self.bucket_bits, self.segment_bytes, self.top, self.data, self.first = bucket_bits, segment_bytes, top, data, first

    @staticmethod
    def segment(segment_bytes: int, parts: list[tuple[int, bytes]]) -> bytes:
        bits = np.zeros(segment_bytes * 8, bool)
        for kind, blob in parts:
            keys, counts = unpack(blob)
            levels = level(counts, kind)
            for j in range(1, int(levels.max(initial=0)) + 1):
                for at in _probe_bits(keys[levels >= j], j, kind, len(bits)):
                    bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The last level that is there for each key."""
        bucket = ((keys >> np.uint64(64 - self.bucket_bits)).astype("i8") - self.first) * self.segment_bytes
        own = keys & np.uint64((1 << (64 - self.bucket_bits)) - 1)
        if kind == 2:
            own = own >> np.uint64(24 - self.bucket_bits)
        out, active, j = np.zeros(len(keys), "i8"), np.arange(len(keys)), 1
        while len(active) and j <= self.top:
            there = np.ones(len(active), bool)
            for at in _probe_bits(own[active], j, kind, self.segment_bytes * 8):
                byte = self.data[bucket[active] + (at >> np.uint64(3)).astype("i8")]
                there &= (byte >> (at & np.uint64(7)).astype("u1")) & 1 > 0
            active = active[there]
            out[active] = j
            j += 1
        return out


class StoredFilter(NamedTuple):
    """A filter too large to broadcast: ``frame`` holds its segments (bucket, bits) in the shared folder."""

    bucket_bits: int
    segment_bytes: int
    top: int
    frame: DataFrame


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def train(docs: DataFrame, text: str = "text", bucket_bits: int | None = None):
    """(filter, N, V, counts of words as DataFrame (key, c), frequent keys, their counts) of all of ``docs``."""
    spark = docs.sparkSession
    if bucket_bits is None:
        size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        bucket_bits = max(6, min(MOST_BUCKET_BITS, (size // BUCKET_BYTES).bit_length()))
    sent = docs.select(text).mapInArrow(_count(bucket_bits), "kind int, bucket int, blob binary")
    # As many partitions as buckets: what one task reads doesn't follow the corpus.
    dealt = sent.repartition(min(1 << bucket_bits, MOST_PARTITIONS), "kind", "bucket")
    merged = materialize(
        dealt.groupBy("kind", "bucket").applyInArrow(_merge, "kind int, bucket int, entries long, top int, blob binary"), "ngrams"
    )
    entries, top_level = (x or 0 for x in merged.agg(F.sum("entries"), F.max("top")).first())
    segment_bytes = max(64, entries * BITS_PER_ENTRY // 8 >> bucket_bits)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        parts = list(zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([LogFrequencyFilter.segment(segment_bytes, parts)], pa.binary())})

    segments = merged.select("kind", "bucket", "blob").groupBy("bucket").applyInArrow(fill, "bucket int, bits binary")
    if segment_bytes << bucket_bits > MAX_FILTER_BYTES:
        model = StoredFilter(bucket_bits, segment_bytes, top_level, materialize(segments, "filter"))
    else:
        data = np.zeros(segment_bytes << bucket_bits, "u1")
        for r in segments.toLocalIterator():
            data[r[0] * segment_bytes : (r[0] + 1) * segment_bytes] = np.frombuffer(r[1], "u1")
        model = LogFrequencyFilter(bucket_bits, segment_bytes, top_level, data)

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unpack(blob)
                keys = keys | (np.uint64(b) << np.uint64(64 - bucket_bits))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(counts.astype("i8"))], names=["key", "c"])

    counts = materialize(merged.where("kind = 1").select("bucket", "blob").mapInArrow(unroll, "key long, c long"), "words")
    by_level = counts.groupBy(F.floor(F.log2("c")).alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    n, v = sum(r["n"] for r in by_level), sum(r["v"] for r in by_level)
    least, taken = 64, 0
    for r in sorted(by_level, key=lambda r: -r["l"]):
        if taken + r["v"] > FREQUENT:
            break
        least, taken = r["l"], taken + r["v"]
    top = counts.where(F.floor(F.log2("c")) >= int(least)).toPandas()  # FREQUENT rows at most
    keys = top["key"].to_numpy("i8").view("u8")
    order = np.argsort(keys)
    return model, n, v, counts, keys[order], top["c"].to_numpy("i8")[order]


def _rows(ids: np.ndarray, doc_ids: pa.Array, n_tokens: np.ndarray, word: np.ndarray, back: np.ndarray, c1: np.ndarray, c2: np.ndarray, top, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and of their words that the table of frequent ones lacks (kind 1).

    ``c1`` has the filter's count of each distinct word, ``c2`` that of the pair at each token.
    """
    total = n + ADD * (v + 1)
    keys, key_counts = top
    m = len(ids)
    doc = np.repeat(np.arange(m), n_tokens)
    k = np.searchsorted(keys, word)
    k[k == len(keys)] = 0
    known = keys[k] == word if len(keys) else np.zeros(len(word), bool)
    exact = np.where(known, key_counts[k] if len(keys) else 0, 0)
    base = np.where(known, np.log10((exact + ADD) / total), 0.0)[back]
    p1 = ((c1 + ADD) / total)[back]
    end = np.searchsorted(word, END)
    ctx = np.concatenate((c1[back[:1]] * 0 + c1[end], c1[back][:-1]))
    p = (np.minimum(c2, ctx) + MU * p1) / (ctx + MU)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids), pa.array(np.zeros(m, "i4")), doc_ids,
            pa.array(n_tokens), pa.array(np.bincount(doc, known[back], m).astype("i8")),
            pa.array(np.bincount(doc, base, m)), pa.array(np.bincount(doc, np.log10(p), m)),
            pa.array(tx.mix(ids.view("u8")).view("i8")), pa.array(np.zeros(m, "i8")),
        ],
        names=_ROW,
    )
    rare = np.flatnonzero(~known[back])
    if len(rare):
        d, w = doc[rare], back[rare]
        code, times = np.unique(d * len(word) + w, return_counts=True)
        z = np.zeros(len(code))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[code // len(word)]), pa.array(np.ones(len(code), "i4")), pa.nulls(len(code), doc_ids.type),
                pa.array(z.astype("i8")), pa.array(z.astype("i8")), pa.array(z), pa.array(z),
                pa.array(word[code % len(word)].view("i8")), pa.array(times.astype("i8")),
            ],
            names=_ROW,
        )


def _score(shared, n: int, v: int):
    """Rows of documents and of their rare words, by the filter that was broadcast."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_bits, segment_bytes, top_level, bits, *top = shared.value
        model = LogFrequencyFilter(bucket_bits, segment_bytes, top_level, bits)
        row = np.int64(TaskContext.get().partitionId()) << np.int64(36)
        for batch in batches:
            for i, j, data, at in tx.pieces(batch.column(1)):
                t, first = tokens(data, at)
                word, back = np.unique(t, return_inverse=True)
                pair, pair_back = np.unique(pairs(t), return_inverse=True)
                c1, c2 = value(model.levels(word, 1), 1), value(model.levels(pair, 2), 2)[pair_back]
                ids = row + np.arange(j - i)
                row += j - i
                yield from _rows(ids, batch.column(0).slice(i, j - i), np.diff(first), word, back, c1, c2, top, n, v)
        tx.release()

    return score


def _probes(bucket_bits: int):
    """(chunk, kind, bucket, blob): a chunk's documents (kind 0), and by bucket its distinct words and pairs.

    A chunk is named by the row of its first document.
    """

    def flush(chunk: int, ids: list[pa.Array], sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        t, doc_ids = np.concatenate(parts), pa.concat_arrays(ids)
        word, back = np.unique(t, return_inverse=True)
        held = [np.array([len(doc_ids), len(word)]), np.concatenate(sizes), word.view("i8"), back.astype("i4")]
        names = pa.RecordBatch.from_arrays([doc_ids], names=["doc_id"]).serialize().to_pybytes()
        rows = [(0, 0, b"".join([*(x.tobytes() for x in held), names]))]
        for kind, keys in ((1, word), (2, np.unique(pairs(t)))):
            cut = np.searchsorted(keys, np.arange(1 << bucket_bits, dtype="u8") << np.uint64(64 - bucket_bits))
            cut = np.append(cut, len(keys))
            rows += [(kind, b, keys[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut)).tolist()]
        kind, bucket, blob = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), chunk, "i8")), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())],
            names=["chunk", "kind", "bucket", "blob"],
        )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = row = TaskContext.get().partitionId() << 36
        held: tuple[list, list, list] = [], [], []
        n = 0
        for batch in batches:
            for i, j, data, at in tx.pieces(batch.column(1)):
                t, first = tokens(data, at)
                for part, x in zip(held, (batch.column(0).slice(i, j - i), np.diff(first), t), strict=True):
                    part.append(x)
                row += j - i
                n += len(t)
                if n >= CHUNK:
                    yield flush(chunk, *held)
                    held, chunk, n = ([], [], []), row, 0
        if n:
            yield flush(chunk, *held)
        tx.release()

    return probe


def _look_up(bucket_bits: int, segment_bytes: int, top: int):
    """The levels, a byte each, of the n-grams sent to one bucket."""

    def look(key: tuple, probes: pa.Table, segment: pa.Table) -> pa.Table:
        bits = segment.column("bits")[0].as_buffer() if segment.num_rows else bytes(segment_bytes)
        model = LogFrequencyFilter(bucket_bits, segment_bytes, top, np.frombuffer(bits, "u1"), key[0].as_py())
        found = [
            model.levels(np.frombuffer(b.as_buffer(), "u8"), k.as_py()).astype("u1").tobytes()
            for k, b in zip(probes.column("kind"), probes.column("blob"), strict=True)
        ]
        return pa.table([*(probes.column(c) for c in ("chunk", "kind", "bucket")), pa.array(found, pa.binary())], names=["chunk", "kind", "bucket", "blob"])

    return look


def _score_chunk(shared, kind: pa.DataType, n: int, v: int):
    """Rows of one chunk's documents and of their rare words, from the levels that came back."""

    def score(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        blobs: dict[int, list] = {0: [], 1: [], 2: []}
        for k, b in zip(table.column("kind"), table.column("blob"), strict=True):
            blobs[k.as_py()].append(b.as_buffer())
        m, w = np.frombuffer(blobs[0][0], "i8", 2).tolist()
        numbers = np.frombuffer(blobs[0][0], "i8", m + w, 16)
        n_tokens, word = numbers[:m], numbers[m:].view("u8")
        at = 16 + 8 * len(numbers)
        back = np.frombuffer(blobs[0][0], "i4", int(n_tokens.sum()), at).astype("i8")
        doc_ids = pa.ipc.read_record_batch(pa.py_buffer(bytes(blobs[0][0][at + 4 * len(back) :])), pa.schema([("doc_id", kind)])).column(0)
        one, two = (np.frombuffer(b"".join(blobs[k]), "u1").astype("i8") for k in (1, 2))
        pair_back = np.unique(pairs(word[back]), return_inverse=True)[1]
        ids = key[0].as_py() + np.arange(m)
        made = _rows(ids, doc_ids, n_tokens, word, back, value(one, 1), value(two, 2)[pair_back], shared.value, n, v)
        return pa.Table.from_batches(list(made))

    return score


def _by_segments(docs: DataFrame, model: StoredFilter, shared, n: int, v: int) -> DataFrame:
    """The rows of ``_score`` where n-grams go to the segments of a stored filter."""
    schema = "chunk long, kind int, bucket int, blob binary"
    sent = materialize(docs.mapInArrow(_probes(model.bucket_bits), schema), "probes")
    asked = sent.where("kind > 0")
    size = asked.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    # A bucket's n-grams are dealt to so many tasks, each with the bucket's segment.
    parts = 1 + size // (LOOKED_UP_BYTES << model.bucket_bits)
    segments = model.frame.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    found = dealt.groupBy("bucket", "part").cogroup(segments.groupBy("bucket", "part")).applyInArrow(
        _look_up(model.bucket_bits, model.segment_bytes, model.top), schema
    )
    return sent.where("kind = 0").unionByName(found).groupBy("chunk").applyInArrow(
        _score_chunk(shared, to_arrow_type(docs.schema["doc_id"].dataType), n, v), _row_schema(docs)
    )


_ROW = ["row", "kind", "doc_id", "n_tokens", "n_known", "base", "score", "key", "times"]


def _row_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"row long, kind int, doc_id {kind}, n_tokens long, n_known long, base double, score double, key long, times long"


def score_documents(docs: DataFrame, trained) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` (doc_id, text)."""
    model, n, v, counts, top, top_counts = trained
    context = docs.sparkSession.sparkContext
    if isinstance(model, StoredFilter):
        rows = _by_segments(docs.select("doc_id", "text"), model, context.broadcast((top, top_counts)), n, v)
    else:
        shared = context.broadcast((model.bucket_bits, model.segment_bytes, model.top, model.data, top, top_counts))
        rows = docs.select("doc_id", "text").mapInArrow(_score(shared, n, v), _row_schema(docs))
    joined = rows.join(counts, "key", "left")
    c = F.coalesce("c", F.lit(0))
    rare = F.col("kind") == 1
    base = F.when(rare, F.col("times") * F.log10((c + ADD) / F.lit(float(n + ADD * (v + 1))))).otherwise(F.col("base"))
    known = F.when(rare, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known"))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(known).alias("n_known"),
        F.sum(base).alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trained = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score_documents(docs, trained)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trained[1]).cast("long").alias("train_tokens"), "base_score", "score"
    )
