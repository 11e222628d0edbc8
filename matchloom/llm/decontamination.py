r"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Items are cut into windows of ``n`` consecutive words (an item of fewer words is one
window). Within a window the words are ordered by rarity in the corpus, rarest first. A
document that holds a window holds all its words, so the necessary prefix of that order
is one word, the window's rarest: the inverted list is keyed by it. A document word that
equals a key gives a candidate, which the position and length bounds (the window has to
fit between the text's ends) thin out, and an exact comparison of the ``n`` words
decides.

The frequencies of the items' words come from one scan with partial aggregation. If the
window table is small (``BROADCAST_WINDOWS`` rows and ``BROADCAST_BYTES``, both
measured) it is broadcast: words are made, generated, looked up and compared in one
stage, and only true occurrences are shuffled. A larger one is met in three steps. The
words of documents, each with its place but without its text, go through a table of the
keys' hash buckets (``BUCKETS`` numbers at most, so it can always be broadcast); those
left are shuffled to the keys by word, hot words apart; the texts of documents with
candidates are then read once more, whole, and compared.

Defined results: null, empty or wordless texts have no words, no hits and are not
contaminated; very long texts are compared whole; null or wordless items are no items;
repeated items count once for each item_id; equally rare words (ties) are ordered by
length and code points; documents that are alike in id (of any type) and text get the
same answer, in one row each; other columns are kept by ``stage``, whatever their
names; empty tables give empty or clean results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.columns import wrapped
from matchloom.llm.skew import hot_limit
from matchloom.llm.spans import BROADCAST_BYTES, sized
from matchloom.session import materialize

N = 10
BROADCAST_WINDOWS = 200_000
#: Hash buckets of the keys.
BUCKETS = 1 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in lower-case ASCII letters, digits and whatever is beyond ASCII; null: none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def item_windows(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, window, anchor, at, c): every window with its rarest word, where that stands and its occurrences in ``docs`` (words).

    Of equally rare words the longest, then the first in code-point order.
    """
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    words = materialize(words.where(F.size("words") > 0), "item-words")
    known = materialize(words.select(F.explode("words").alias("known")).distinct(), "vocabulary")
    word = docs.select(F.explode("words").alias("word"))
    counted = lambda rows: rows.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    known_bytes = known.agg(F.sum(F.octet_length("known").cast("long") + 32)).first()[0] or 0
    if known_bytes <= BROADCAST_BYTES:
        count = counted(word.join(F.broadcast(known), F.col("word") == F.col("known"), "left_semi"))
    else:  # counted before the shuffle, so no word is hot
        count = counted(word).join(known, F.col("word") == F.col("known"), "left_semi")
    count = materialize(count, "word-counts")
    windows = words.select(
        "item_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: F.slice("words", i + 1, n)
            )
        ).alias("window"),
    ).distinct()
    each = windows.select("item_id", "window", F.posexplode("window").alias("at", "word")).join(sized(count), "word", "left")
    rare = F.struct(F.coalesce("c", F.lit(0)).alias("c"), (-F.length("word")).alias("l"), F.col("word").alias("anchor"), "at")
    found = each.groupBy("item_id", "window").agg(F.min(rare).alias("r")).where("r.c > 0")  # the corpus has no such word: no occurrence
    return materialize(found.select("item_id", "window", "r.anchor", "r.at", "r.c"), "windows")


def occurrences(docs: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(key, item_id, start, length) of each occurrence of a window in ``docs`` (key, words)."""
    n, size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("window", " ")).cast("long") + 400)).first()
    same = F.slice("words", F.greatest("start", F.lit(0)) + 1, F.size("window")) == F.col("window")
    found = [*key, "item_id", "start", F.size("window").alias("length")]
    word = F.posexplode("words").alias("pos", "word")
    start = (F.col("pos") - F.col("at")).alias("start")
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n_words"))
    if n <= BROADCAST_WINDOWS and (size or 0) <= BROADCAST_BYTES:
        met = docs.select(*key, "words", F.size("words").alias("n_words"), word).join(F.broadcast(windows.drop("c")), F.col("word") == F.col("anchor"))
        return met.select(*key, "words", "n_words", "item_id", "window", start).where(fits & same).select(*found)
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))
    there = windows.select(bucket("anchor").alias("b")).distinct()  # BUCKETS rows at most
    rows = docs.select(*key, F.size("words").alias("n_words"), word).join(F.broadcast(there), bucket("word") == F.col("b"), "left_semi")
    rows = materialize(rows, "key-words")
    # Hot words, keys or others that share a bucket with one, are few; all their windows go to every row.
    often = rows.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > hot_limit(rows)).select(F.col("word").alias("hot"))
    often = materialize(often, "hot-words")
    hot = windows.join(F.broadcast(often), F.col("anchor") == F.col("hot"), "left_semi").withColumn("bytes", F.octet_length(F.array_join("window", " ")))
    keyed = F.col("word") == F.col("anchor")
    met = rows.join(F.broadcast(often), F.col("word") == F.col("hot"), "left_anti").join(windows, keyed)
    met = met.drop("c").unionByName(rows.join(sized(materialize(hot, "hot-windows"), "bytes", 1), keyed).drop("c", "bytes"))
    candidates = materialize(met.select(*key, "n_words", "item_id", "window", start).where(fits).distinct(), "candidates")
    names = {k: f"{k}_" for k in key}
    near = candidates.withColumnsRenamed(names)
    at = (F.col(key[1]) == F.col(f"{key[1]}_")) & F.col(key[0]).eqNullSafe(F.col(f"{key[0]}_"))
    holders = materialize(candidates.select(*key).distinct().withColumnsRenamed(names), "holders")
    texts = docs.join(sized(holders), at, "left_semi").dropDuplicates(key)
    return texts.join(near, at).where(same).select(*found)


def covered(spans: Column) -> Column:
    """Length of the union of sorted (start, length) structs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], F.least(s["start"], end))).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def find_contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """Of ``docs`` (doc_id, text) with hits: (doc_id, text_hash, spans, item_ids).

    One row for each distinct (doc_id, text). ``spans`` are (start, length) in words,
    ``item_ids`` strings in code-point order.
    """
    words = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    hits = occurrences(words, item_windows(words, items, n), ["doc_id", "text_hash"])
    return hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
    )


def with_contamination(docs: DataFrame, items: DataFrame, kept: list[Column], n: int = N) -> DataFrame:
    """``kept`` columns of every row of ``docs`` (doc_id, text), and spans and item_ids (null: clean)."""
    found = find_contamination(docs, items, n).withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"))
    return rows.join(found, (F.col("hash") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d")), "left").select("row.*", "spans", "item_ids")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_words = F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    found = with_contamination(docs, items, [F.col("doc_id"), n_words])
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    rows = wrapped(docs, doc=F.col("doc_id"), hash=F.xxhash64("text"))
    at = (F.col("hash") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d"))
    return rows.join(sized(materialize(found, "contaminated")), at, "left_anti").select("row.*")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '{BREAK}'), lambda x: x <> '') AS words
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '{BREAK}'), lambda x: x <> '') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, words[i : i + 9] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), pos AS (
  SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d
), hit AS (
  SELECT r, i, len(win) AS n, item_id FROM pos JOIN win ON words[i : i + 9] = win WHERE len(win) = 10
  UNION ALL
  SELECT r, i, len(win) AS n, item_id FROM pos JOIN (SELECT * FROM win WHERE len(win) < 10)
    ON words[i] = win[1] AND words[i : i + len(win) - 1] = win
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
