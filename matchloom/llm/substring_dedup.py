r"""Repeated 400-byte substrings by prefix-free parsing.

Parsing. A rolling hash over ``GRAM`` bytes gives every window of ``LENGTH`` bytes one
trigger: the gram in it with the smallest hash, the first of equal ones. It hangs on the
window's bytes alone. Texts are cut at their triggers; the phrase of a trigger is the
run of windows that have it, with the bytes they cover (on the average half of
``LENGTH``). So equal windows lie in phrases with equal triggers, at the same distance
from it, wherever they stand. Neighbouring equal phrases (periodic text) are one row.

Dictionary and parse. Phrases are equal if trigger and whole bytes are (128 bits of
hashes); the dictionary holds each distinct one with the number of its occurrences in
the parse. A phrase that occurs twice is repeated as a whole. A trigger that one phrase
alone has repeats nothing else. Only triggers with several distinct phrases are left,
about a twentieth of all phrases: their bytes are fetched once for each distinct phrase.

Corpus order. A window at distance d before its trigger is a suffix of d bytes of what
precedes the trigger in the dictionary, and the first ``LENGTH - d`` bytes of the parse
from the trigger on. Both are put in order, trigger by trigger: the dictionary's left
sides as reversed suffixes, the parse's right sides as suffixes to the depth of a
window, with the bytes that neighbours have in common (LCP). For each d the order falls
into classes of equal left sides and of equal right sides; two phrases in the same pair
of classes have that window in common. Groups are settled together, ``BATCH`` phrases
at a time. A trigger with more than ``GROUP`` distinct phrases (a common passage in ever
different surroundings) is not put into one task: its classes are refined as tables, to
cells of neighbouring windows and, at the borders of what is repeated, to windows,
named by 128-bit hashes of those bytes and counted with partial aggregation.

Phrases of other triggers are never compared, no pairs are made, and rows of a hot
trigger or phrase are met by many tasks (``skew.py``). Texts are scanned twice and
shuffled only where the dictionary's places or the spans are too many to broadcast
(measured: ``spans.sized``).

Defined results: null is empty; texts shorter than ``LENGTH`` bytes have no windows;
very long texts are parsed in blocks and whole; windows don't cross documents; repeated
rows are repetitions of each other, with or without a doc_id of any type, and so are
ties: every one of several equal windows goes; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import text as tx
from matchloom.llm.skew import hot_limit, split_join, with_counts
from matchloom.llm.spans import remove_spans, sized, union
from matchloom.session import discard, materialize

LENGTH, GRAM = 400, 128
#: Windows of a text that are parsed at once.
BLOCK = 1 << 18
GROUP, BATCH, CELL = 1024, 1 << 14, 16
_B = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)
#: A phrase's shape in one number: first window (31 bits), windows (9), trigger's distance from the first (9), times (14).
MOST_TIMES = (1 << 14) - 1


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2 ** 64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for base in (_B, pow(_B, -1, 2**64)):
                x = np.full(n, base, "u8")
                x[0] = 1
                out.append(np.cumprod(x))
            self.up, self.down = out
        return self.up, self.down


def parse(b: np.ndarray, powers: _Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, windows, distance of the trigger, times, trigger, hash of the whole) of each phrase of ``b``."""
    n = len(b)
    if n < length:
        return (*(np.zeros(0, "i8") for _ in range(4)), *(np.zeros(0, "u8") for _ in range(2)))
    up, down = powers.to(n + 1)
    prefix = np.zeros(n + 1, "u8")
    np.cumsum(tx._CODE[b] * up[:n], out=prefix[1:])
    h = tx.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    span, have = length - gram + 1, 1
    m = (h & ~_PLACE) | np.arange(len(h), dtype="u8")
    while 2 * have <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if span > have:
        m = np.minimum(m[: len(m) - (span - have)], m[span - have :])
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    stop = np.append(first[1:], len(m))
    run, place = stop - first, (m[first] & _PLACE).astype("i8")
    trigger = h[place]
    whole = tx.mix((prefix[stop - 1 + length] - prefix[first]) * down[first] + run.astype("u8"))
    alike = (trigger[1:] == trigger[:-1]) & (whole[1:] == whole[:-1])
    new = np.flatnonzero(np.concatenate(([True], ~alike)))
    times = np.diff(np.append(new, len(first)))
    if times.max() > MOST_TIMES:
        new = np.unique(np.concatenate([new, *(np.arange(a, a + t, MOST_TIMES) for a, t in zip(new, times, strict=True) if t > MOST_TIMES)]))
        times = np.diff(np.append(new, len(first)))
    return first[new], run[new], place[new] - first[new], times, trigger[new], whole[new]


def _field(name: str, at: int, bits: int):
    return F.shiftright("shape", at).bitwiseAND(F.lit((1 << bits) - 1)).alias(name)


#: The parts of ``shape``.
FIRST, RUN, AT, TIMES = _FIELDS = ("first", 0, 31), ("run", 31, 9), ("at", 40, 9), ("times", 49, 14)


def _blocks(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces of a text that together hold each window once."""
    for at in range(0, max(1, len(b) - LENGTH + 1), BLOCK):
        yield at, b[at : at + BLOCK + LENGTH - 1]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for i, j, data, at in tx.pieces(batch.column(1)):
            parts = []
            for r in range(j - i):
                for offset, b in _blocks(data[at[r] : at[r + 1]]):
                    first, run, place, times, trigger, whole = parse(b, powers)
                    if len(first):
                        shape = (first + offset) | run << 31 | place << 40 | times << 49
                        parts.append((np.full(len(first), keys[i + r], "i8"), shape, trigger.view("i8"), whole.view("i8")))
            if parts:
                columns = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "shape", "trigger", "whole"])
    tx.release()


_DATA = "trigger long, whole long, c long, twice boolean, at int, run int, bytes binary"


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the dictionary's phrases, from the text that holds them."""
    for batch in batches:
        for k in range(batch.num_rows):
            data = batch.column(0)[k].as_py().encode()
            p = batch.column(1)[k].as_py()
            column = lambda name, kind: pa.array([x[name] for x in p], kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(n, pa.int64()) for n in ("trigger", "whole", "c")),
                    column("twice", pa.bool_()),
                    *(column(n, pa.int32()) for n in ("at", "run")),
                    pa.array([data[x["first"] : x["first"] + x["run"] - 1 + LENGTH] for x in p], pa.binary()),
                ],
                names=["trigger", "whole", "c", "twice", "at", "run", "bytes"],
            )
    tx.release()


def suffix_order(group: np.ndarray, sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``sides`` by group and bytes; bytes that each has in common with the one before, -1 across groups)."""
    order = np.array(sorted(range(len(sides)), key=lambda k: (group[k], sides[k])), int)
    width = max(map(len, sides)) + 1
    m = np.frombuffer(b"".join(sides[k].ljust(width, b"\0") for k in order.tolist()), "u1").reshape(-1, width)
    size = np.array([len(sides[k]) for k in order.tolist()])
    differ = m[1:] != m[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    return order, np.concatenate(([-1], np.where(group[order][1:] == group[order][:-1], common, -1)))


def repeated_windows(group: np.ndarray, at: np.ndarray, run: np.ndarray, phrases: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each phrase which windows equal a window of another phrase of its group (the groups are triggers).

    ``at``: distance of the trigger from a phrase's start; ``run``: windows of the phrase.
    """
    n = len(phrases)
    right, lcp = suffix_order(group, [p[a:] for p, a in zip(phrases, at.tolist(), strict=True)])
    left, lcs = suffix_order(group, [p[:a][::-1] for p, a in zip(phrases, at.tolist(), strict=True)])
    flags = np.zeros((n, int(run.max())), bool)
    sides = np.zeros((2, n), "i8")
    for d in range(int((at - run).min()) + 1, int(at.max()) + 1):
        there = np.flatnonzero((at - run < d) & (d <= at))
        if len(there) < 2:
            continue
        sides[0, right] = np.cumsum(lcp < length - d)
        sides[1, left] = np.cumsum(lcs < d)
        code = sides[0, there] * (n + 1) + sides[1, there]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twice = there[order[np.append(same, False) | np.append(False, same)]]
        flags[twice, at[twice] - d] = True
    return [flags[k, :r] for k, r in enumerate(run.tolist())]


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype("i1"), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by trigger; (trigger, whole, lo, hi): ranges of repeated windows of phrases that don't occur twice."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        trigger, whole, twice, at, run, data = zip(*rows, strict=True)
        flags = repeated_windows(np.array(trigger, "i8"), np.array(at), np.array(run), list(data))
        found = [(t, w, *_ranges(f)) for t, w, x, f in zip(trigger, whole, twice, flags, strict=True) if not x and f.any()]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["trigger", "whole", "lo", "hi"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if rows and row[:2] == rows[-1][:2]:  # rows of the documents' table that are alike
                continue
            if len(rows) >= BATCH and row[0] != rows[-1][0]:
                yield settle(rows)
                rows = []
            rows.append(row)
    if rows:
        yield settle(rows)
    tx.release()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases with a hot trigger, cut into cells of up to ``CELL`` neighbouring windows.

    Cells are cut by the windows' distance from the trigger, which equal windows share.
    (trigger, whole, lo: first window; w1, w2: hashes of the windows; c1, c2: of the
    bytes that all windows of such a cell have in common; f1, f2: of all bytes of this one.)
    """
    powers = _Powers()
    codes = (tx._CODE, tx.mix(tx._CODE))
    for batch in batches:
        for t, w, x, first, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            b = np.frombuffer(data, "u1")
            up, down = powers.to(len(b) + 1)
            sums = [np.concatenate((np.zeros(1, "u8"), np.cumsum(code[b] * up[: len(b)], dtype="u8"))) for code in codes]
            of = lambda p, x, y: (p[y] - p[x]) * down[x]  # noqa: E731, B023  hash of bytes x to y
            i = np.arange(len(b) - LENGTH + 1)
            code = (first - i) // CELL
            lo = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            hi = np.append(lo[1:], len(i)) - 1
            core = first - (first - lo) // CELL * CELL
            windows = [tx.mix(of(p, i, i + LENGTH)).view("i8") for p in sums]
            common = [tx.mix(of(p, core, core + LENGTH - CELL + 1) + np.uint64(1)).view("i8") for p in sums]
            extent = ((first - lo) * LENGTH + hi - lo).astype("u8")
            whole = [tx.mix(of(p, lo, hi + LENGTH) + tx.mix(extent)).view("i8") for p in sums]
            cut = pa.array(np.append(lo, len(i)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in windows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lo), t, "i8")), pa.array(np.full(len(lo), w, "i8")), pa.array(np.full(len(lo), x, bool)), pa.array(lo, pa.int32()), *lists, *map(pa.array, (*common, *whole))],
                names=["trigger", "whole", "twice", "lo", "w1", "w2", "c1", "c2", "f1", "f2"],
            )
    tx.release()


def _hot_ranges(data: DataFrame) -> DataFrame:
    """(trigger, whole, lo, hi) of phrases (trigger, whole, twice, at, bytes) whose triggers are in very many phrases.

    Cells that occur as a whole elsewhere are repeated; cells whose common bytes occur
    nowhere else are not; the windows of the others, at the borders of what is
    repeated, are rows. Counts have partial aggregation, and rows of a hot cell or
    window are met by many tasks.
    """
    cells = data.mapInArrow(
        _cells,
        "trigger long, whole long, twice boolean, lo int, w1 array<long>, w2 array<long>, c1 long, c2 long, f1 long, f2 long",
    )
    cells = materialize(cells, "cells")
    limit, place = hot_limit(cells), ["trigger", "whole", "lo"]
    count = F.count(F.lit(1)).alias("c")
    exact = materialize(cells.groupBy("f1", "f2").agg(count, F.min(F.struct(*place)).alias("p")), "exact-cells")
    common = materialize(cells.groupBy("c1", "c2").agg(count).where("c > 1"), "common-bytes")
    full = split_join(cells, exact.where("c > 1").drop("p"), ["f1", "f2"], "c", limit)
    alone = materialize(cells.join(exact.where("c = 1").select("p.*"), place, "left_semi"), "cells-alone")
    border = materialize(split_join(alone, common, ["c1", "c2"], "c", limit), "border-cells")
    # a window of a border cell can equal one of a cell that is repeated as a whole: those windows count once for each kind of cell
    kinds = materialize(cells.join(exact.where("c > 1").select("p.*"), place, "left_semi"), "kinds-of-cells")
    open_ = materialize(border.select("c1", "c2", "c").distinct(), "open-cells")
    rows = lambda df: df.select("trigger", "whole", "twice", "lo", F.posexplode(F.arrays_zip("w1", "w2")).alias("k", "w")).select(
        "trigger", "whole", "twice", (F.col("lo") + F.col("k")).alias("i"), "w.w1", "w.w2"
    )
    windows = materialize(rows(border), "border-windows")
    others = rows(split_join(kinds, open_, ["c1", "c2"], "c", limit)).select("w1", "w2")
    again = windows.select("w1", "w2").unionByName(others).groupBy("w1", "w2").agg(count).where("c > 1")
    found = split_join(windows.where("not twice"), materialize(again, "equal-windows"), ["w1", "w2"], "c", limit)
    found = found.select("trigger", "whole", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))
    whole = full.where("not twice").select("trigger", "whole", "lo", (F.col("lo") + F.size("w1")).alias("hi"))
    both = found.unionByName(whole).groupBy("trigger", "whole").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("x"))
    return both.select("trigger", "whole", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching intervals of a row become one."""
    for batch in batches:
        starts, ends = [], []
        for s, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            a, z = union(np.array(s, "i8"), np.array(e, "i8"))
            starts.append(a.tolist())
            ends.append(z.tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, kind), pa.array(ends, kind)], names=["key", "starts", "ends"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, starts, ends): byte intervals of ``docs`` (key, text) that repeated windows cover."""
    one = docs.where(F.octet_length("text") >= LENGTH).select("key", "text")
    phrases = materialize(one.mapInArrow(_phrases, "key long, shape long, trigger long, whole long"), "phrases")
    limit = hot_limit(phrases)
    often = phrases.groupBy("trigger").agg(F.sum(_field(*TIMES)).alias("times"), F.count(F.lit(1)).alias("c")).where("times > 1")
    parse_ = split_join(phrases, materialize(often.select("trigger", "c"), "triggers"), "trigger", "c", limit).drop("c")
    parse_ = materialize(parse_, "parse")
    words = parse_.groupBy("trigger", "whole").agg(
        F.sum(_field(*TIMES)).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("key", "shape")).alias("at")
    )
    dictionary = materialize(words.select("trigger", "whole", "n", "rows", "at.*"), "dictionary")

    # Phrases of a trigger with several, with c, their number; their places in texts.
    several = with_counts(dictionary, "trigger", hot_limit(dictionary))
    places = several.select("key", F.struct("trigger", "whole", "c", (F.col("n") > 1).alias("twice"), *[_field(*x) for x in (AT, RUN, FIRST)]).alias("p"))
    places = materialize(places.groupBy("key").agg(F.collect_list("p").alias("places"), F.count(F.lit(1)).alias("many")), "places")
    held = one.join(sized(places, "many", 64).drop("many"), "key").select("text", "places")
    data = materialize(held.mapInArrow(_bytes_of, _DATA), "phrase-bytes")

    columns = ("trigger", "whole", "twice", "at", "run", "bytes")
    small = data.where(F.col("c") <= GROUP).select(*columns).repartition("trigger").sortWithinPartitions("trigger", "whole")
    ranges = small.mapInArrow(_ordered, "trigger long, whole long, lo array<int>, hi array<int>")
    large = data.where(F.col("c") > GROUP)
    if not large.isEmpty():
        large = large.dropDuplicates(["trigger", "whole"]).select("trigger", "whole", "twice", "at", "bytes")
        ranges = ranges.unionByName(_hot_ranges(large))
    found = materialize(ranges.where(F.size("lo") > 0), "ranges")

    twice = dictionary.where("n > 1")
    full = twice.select("trigger", "whole", "rows", F.lit(None).cast("array<int>").alias("lo"), F.lit(None).cast("array<int>").alias("hi"))
    part = found.select("trigger", "whole", F.lit(1).cast("long").alias("rows"), "lo", "hi")
    side = materialize(full.unionByName(part), "repeated")
    marked = split_join(parse_, side, ["trigger", "whole"], "rows", limit)
    marked = marked.select("key", *[_field(*x) for x in _FIELDS], "lo", "hi")
    whole_run = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("run") * F.col("times")).alias("hi")))
    some = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct(x["lo"].cast("long").alias("lo"), x["hi"].cast("long").alias("hi")))
    spans = marked.select("key", "first", F.explode(F.when(F.col("lo").isNull(), whole_run).otherwise(some)).alias("r")).select(
        "key", (F.col("first") + F.col("r.lo")).alias("s"), (F.col("first") + F.col("r.hi") - 1 + LENGTH).alias("e")
    )
    by_key = spans.groupBy("key").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    out = materialize(by_key.mapInArrow(_merged, "key long, starts array<long>, ends array<long>"), "spans")
    discard(phrases, parse_, dictionary, places, data, found, side)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a key that rows alike in both share."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return remove_spans(docs, repeated_spans(docs)).drop("kept")


#: A row for each window: for small tables. Bytes are pairs of hexadecimal digits.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 - {LENGTH - 1} AS BIGINT))) AS i FROM d WHERE length(h) >= {2 * LENGTH})
), f AS (
  SELECT r, i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)
), m AS (
  SELECT r, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM f)
), s AS (
  SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS z FROM m GROUP BY r, k
), t AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed FROM s GROUP BY r
), kept AS (
  SELECT r, a, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0))) AS part
  FROM (SELECT r, a, z FROM s UNION ALL SELECT r, CAST(length(h) / 2 AS BIGINT), NULL FROM d) JOIN d USING (r)
), whole AS (
  SELECT r, string_agg(part, '' ORDER BY a) AS h FROM kept GROUP BY r
)
SELECT doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(whole.h)) AS kept_sha256
FROM d JOIN whole USING (r) LEFT JOIN t USING (r)
"""
