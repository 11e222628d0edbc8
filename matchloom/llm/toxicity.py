r"""Toxicity by multiple-instance learning: sentences as instances, noisy-or over them.

Labels mark documents, not sentences. A sentence's chance to be toxic is a logistic
function of its words and of the four-byte sequences within them (hashed); a document
is toxic unless all of its sentences are harmless: 1 - prod(1 - p_s). Training raises
the likelihood of the documents' labels through that product, so weight goes to the
features of sentences that explain them; the trained scores then locate the offending
sentences.

Two passes learn. The first counts, over all labelled rows that may be learned from,
the documents with each feature by label (at most 2 ** FEATURE_BITS rows reach the
driver); the ``SELECTED`` features that tell the labels apart best are kept. The
second fits the weights on the driver on a bounded sample: of the labelled rows whose
documents exist at most ``MAX_TRAIN``, those with the smallest hashes of their ids, and
of these the first with no more than ``MAX_FEATURES`` selected features together. Both
bounds hold before anything is sent, and what is sent hangs on no order of tasks. The model is one table of
2 ** FEATURE_BITS numbers and is broadcast. Scoring is one pass over whole texts
without a shuffle. Labels, language, source and id are no inputs of a score.

Defined results: a null, empty or blank text is one sentence without words, whose
score is the bias's; very long texts are scored whole, a sentence of any length is one;
rows with a null label or doc_id (of any type) are not learned from; repeated rows of
documents or labels are learned from as often as they occur, those of one id alike in
hash (ties) in the order of label and size, and scored alike; sentences alike in score
(ties): the first is the worst; other columns are not read, whatever their names;
without labels every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import text as tx
from matchloom.llm.spans import sized
from matchloom.session import discard, materialize

FEATURE_BITS, SELECTED, MAX_TRAIN, MAX_FEATURES = 18, 2048, 10_000, 4_000_000
STEPS, RATE, L1, LEAST_DOCS = 300, 0.15, 1e-4, 5
THRESHOLD = 0.3
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, its sentence), in order of sentences; (row, first byte) of each sentence.

    A sentence ends with . ! ? or a line feed and has a word at least.
    """
    start, length, first = tx.words(data, at, tx.PUNCTUATION)
    if not len(start):
        return np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    word = (tx.word_hashes(data, start, length) >> np.uint64(64 - FEATURE_BITS)).astype("i4")
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    stops = np.cumsum(_STOP[data], dtype="i8")[start]
    new = np.concatenate(([True], (np.diff(stops) > 0) | (np.diff(row) > 0)))
    sentence = np.cumsum(new) - 1
    low = tx._LOWER[data].astype("u4")
    inside = np.maximum(length - 3, 0)
    begin = np.concatenate(([0], np.cumsum(inside)[:-1]))
    i = np.arange(inside.sum()) - np.repeat(begin, inside) + np.repeat(start, inside)
    four = low[i] | low[i + 1] << np.uint32(8) | low[i + 2] << np.uint32(16) | low[i + 3] << np.uint32(24)
    gram = (tx.mix(four.astype("u8") + np.uint64(1 << 40)) >> np.uint64(64 - FEATURE_BITS)).astype("i4")
    feature = np.concatenate((word, gram))
    of = np.concatenate((sentence, np.repeat(sentence, inside)))
    return feature, of, row[new], start[new]


def _per_row(column: pa.Array, chosen: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, feature, sentence within the row), each pair once, of each row."""
    for i, j, data, at in tx.pieces(column):
        feature, sentence, row, _ = sentences(data, at)
        if chosen is not None:
            there = chosen[feature]
            feature, sentence = feature[there], sentence[there]
        code = np.unique(sentence << FEATURE_BITS | feature)
        feature, sentence = code & ((1 << FEATURE_BITS) - 1), code >> FEATURE_BITS
        cut = np.searchsorted(row[sentence], np.arange(j - i + 1)) if len(row) else np.zeros(j - i + 1, int)
        start = np.searchsorted(row, np.arange(j - i))
        for r in range(j - i):
            k = slice(cut[r], cut[r + 1])
            yield i + r, feature[k], sentence[k] - start[r]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents with it, other documents with it) of a task's rows; feature -1: all."""
    n = np.zeros((2, 1 << FEATURE_BITS), "i8")
    rows = np.zeros(2, "i8")
    for batch in batches:
        toxic = np.minimum(np.asarray(batch.column(0).to_pylist(), int), 1)
        for r, feature, _ in _per_row(batch.column(1), None):
            n[toxic[r], np.unique(feature)] += 1
            rows[toxic[r]] += 1
    there = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(-1, there).astype("i4")), pa.array(np.append(rows[1], n[1][there])), pa.array(np.append(rows[0], n[0][there]))],
        names=["feature", "pos", "neg"],
    )


def _chosen_features(chosen):
    """(order, toxic, n, f, s): of each row the selected features and their sentences, and how many."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, s, n = [], [], []
            for _, feature, sentence in _per_row(batch.column(1), chosen):
                f.append(feature.astype("<i4").tobytes())
                s.append(sentence.astype("<i4").tobytes())
                n.append(len(feature))
            kept = [batch.column(2), batch.column(0), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(f, pa.binary()), pa.array(s, pa.binary())], names=["order", "toxic", "n", "f", "s"])
        tx.release()

    return features


def choose(feature: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Which features tell toxic documents from others: the largest standardised differences."""
    chosen = np.zeros(1 << FEATURE_BITS, bool)
    whole = feature == -1
    n_pos, n_neg = pos[whole].sum(), neg[whole].sum()
    if not n_pos or not n_neg:
        return chosen
    often = ~whole & (pos + neg >= LEAST_DOCS)
    p, q = pos[often] / n_pos, neg[often] / n_neg
    both = (pos[often] + neg[often]) / (n_pos + n_neg)
    z = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-12)
    chosen[feature[often][np.argsort(-z, kind="stable")[:SELECTED]]] = True
    return chosen


def gradient(x: np.ndarray, toxic: np.ndarray, col: np.ndarray, sent: np.ndarray, doc_of: np.ndarray, m: int) -> np.ndarray:
    """Of the mean negative log-likelihood of ``toxic`` under noisy-or, by the weights and the bias (last) in ``x``.

    ``col``, ``sent``: feature and sentence of each occurrence; ``doc_of``: the document of each of ``m`` sentences.
    """
    n = len(toxic)
    z = np.bincount(sent, x[col], m) + x[-1]
    harm = np.bincount(doc_of, np.logaddexp(0, z), n)
    da = np.where(toxic == 1, -1 / np.expm1(np.clip(harm, 1e-9, 500)), 1.0) / n
    dz = da[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
    return np.append(np.bincount(col, dz[sent], len(x) - 1), dz.sum())


def fit(toxic: np.ndarray, features: list[np.ndarray], sentence: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(weights, bias): gradient steps on the noisy-or likelihood with an L1 penalty."""
    w = np.zeros(1 << FEATURE_BITS, "f4")
    if not len(toxic):
        return w, -np.inf
    n_sent = np.array([x[-1] + 1 if len(x) else 1 for x in sentence])
    base = np.concatenate(([0], np.cumsum(n_sent)))
    ids, col = np.unique(np.concatenate(features), return_inverse=True)
    sent = np.concatenate([x + b for x, b in zip(sentence, base[:-1], strict=True)]).astype("i8")
    doc_of = np.repeat(np.arange(len(toxic)), n_sent)
    x, v1, v2 = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    x[-1] = -4.0
    for t in range(1, STEPS + 1):
        g = gradient(x, toxic, col, sent, doc_of, int(base[-1]))
        v1, v2 = 0.9 * v1 + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        rate = RATE / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
        x = x - rate * v1 / (1 - 0.9**t)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - np.minimum(rate[:-1] * L1, 1e3), 0)
    w[ids] = x[:-1]
    return w, float(x[-1])


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows of both that may be learned from."""
    known = materialize(labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic"), "labels")
    texts = docs.where("text is not null and doc_id is not null")
    # Labels are broadcast up to a measured number of rows; beyond it the texts are shuffled once.
    counted = texts.join(sized(known), "doc_id").select("toxic", "text").mapInArrow(_document_counts, "feature int, pos long, neg long")
    table = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    chosen = choose(*(table[c].to_numpy() for c in ("feature", "pos", "neg")))
    # Of the labelled ids with a text, the MAX_TRAIN with the smallest hashes.
    order = F.xxhash64("doc_id").alias("order")
    present = texts.select("doc_id").join(sized(known), "doc_id").distinct()
    taken = present.select("doc_id", "toxic", order).orderBy("order", "doc_id", "toxic").limit(MAX_TRAIN)
    rows = texts.join(F.broadcast(taken), "doc_id").select("toxic", "text", "order")
    rows = materialize(rows.mapInArrow(_chosen_features(chosen), "order long, toxic int, n long, f binary, s binary"), "features")
    ranked = rows.orderBy("order", "toxic", "n", "f", "s")
    sizes = np.cumsum([r[0] for r in ranked.limit(MAX_TRAIN).select("n").collect()])
    sent = ranked.limit(int(np.searchsorted(sizes, MAX_FEATURES, "right"))).collect()
    discard(rows)
    toxic = np.array([r["toxic"] for r in sent])
    return fit(toxic, [np.frombuffer(r["f"], "<i4") for r in sent], [np.frombuffer(r["s"], "<i4").astype("i8") for r in sent])


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for i, j, data, at in tx.pieces(batch.column(1)):
                feature, sentence, row, first = sentences(data, at)
                m = len(row)
                counts = w[feature] != 0  # the others add nothing
                once = np.unique(sentence[counts] << FEATURE_BITS | feature[counts])
                z = np.bincount(once >> FEATURE_BITS, w[once & ((1 << FEATURE_BITS) - 1)], m) + bias
                harm = np.logaddexp(0, z)
                total = np.bincount(row, harm, j - i)
                bare = np.bincount(row, minlength=j - i) == 0
                total[bare] = np.logaddexp(0, bias)
                order = np.lexsort((-z, row))
                worst = order[np.searchsorted(row[order], np.arange(j - i)) % max(m, 1)] if m else np.zeros(j - i, int)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                p = -np.expm1(-harm)
                bad = np.flatnonzero(p >= THRESHOLD)
                lists = np.searchsorted(row[bad], np.arange(j - i + 1)) if m else np.zeros(j - i + 1, int)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(-np.expm1(-total)),
                        pa.array(np.diff(cut).astype("i4")),
                        pa.array(np.where(bare, 0, worst - cut[:-1]).astype("i4")),
                        pa.ListArray.from_arrays(pa.array(lists.astype("i4")), pa.array((bad - cut[row[bad]]).astype("i4"))),
                        pa.ListArray.from_arrays(pa.array(lists.astype("i4")), pa.array(first[bad] - at[row[bad]])),
                    ],
                    names=["doc_id", "score", "n_sentences", "worst_sentence", "offending", "offending_starts"],
                )
        tx.release()

    return score


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, n_sentences, worst_sentence, offending, offending_starts) of each row.

    Sentences are numbered from 0; ``offending`` are those whose own score reaches the
    threshold, ``offending_starts`` the byte at which the first word of each stands.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _scorer(shared),
        f"doc_id {kind}, score double, n_sentences int, worst_sentence int, offending array<int>, offending_starts array<long>",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = train(docs, labels.where(learnable(F.col("doc_id"))))
    return score_toxicity(docs, model).select(
        "doc_id",
        (~learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_sentences",
        "worst_sentence",
    )
