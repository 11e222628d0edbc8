"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles. One hash of the shingles gives
everything: its ``K`` smallest values are retained (all of a smaller set).

1. Documents with equal sets are one node (128-bit digest of the sorted set).
2. Inverted lists of retained values. Two sets that are similar enough share at least
   ``least_overlap`` of their retained values, so, with the values in order of rarity,
   a document's first ``K - least_overlap + 1`` suffice to meet every partner (sets of
   at most ``K`` shingles: exactly; larger ones but for a chance of 5e-6 for a pair at
   the threshold). Values that a document alone has use up this prefix, so a passage
   that many documents share is no list of those whose other text is their own.
3. A short list gives all its pairs. A long list has ``HUBS`` hubs: members whose values
   are most often retained by others, as those of the text are that the others were
   copied from; half of them the very first, half any of nearly that weight. A document
   is paired with the first hubs of its long lists, so a group of thousands of copies
   costs its size, not its square.
4. The ``K`` smallest values of a pair's union, found from the two sketches, estimate
   its similarity: their share that both have. Pairs far below the threshold go.
5. The others are compared exactly, on their full sets of shingles from the texts.
6. Where a long list is left with more than one component, its members are joined
   again by an exact prefix filter: a document's shingles in order of rarity among
   these documents, with a bound on the overlap by position and one by bits: a set's
   shingles each set one of ``BITS`` bits, and two sets differ in at least as many
   shingles as in bits. Both bounds are exact. Pairs of one component are not tried again.
7. Components of the links; the smallest doc_id names a component.

Sketches (about 520 bytes a document) and texts of candidates are shuffled; nothing
is collected but counts. Rows of a hot key (a value, a shingle, a hub or a set that may
have a third of all rows) never meet in one task: ``matchloom/llm/skew.py``.

Defined results: null and wordless texts have an empty set and stand alone; very long
texts are read whole; a null doc_id stands alone, with a null component, and is kept;
rows that share a doc_id (of any type) are one document, linked through each of its
texts, so repeated rows change nothing; of ties the smallest doc_id stays; other
columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import text as tx
from matchloom.llm.components import components
from matchloom.llm.skew import deal_join, hot_join, hot_limit, split_join, with_counts
from matchloom.llm.spans import sized
from matchloom.session import FILE_ROWS, discard, materialize

SHINGLE, PERCENT = 5, 85
#: The stage of the pipeline links from this similarity on; ``PERCENT`` is the contract of the query.
STAGE_PERCENT = 80
K, SHORT_LIST, HUBS = 64, 8, 6
#: Bits in which the members of long lists are compared before their pairs are made.
BITS = 1024
#: Rows of a file for which texts are met.
TEXTS = 512
#: So many standard deviations fewer than at the threshold may be shared of ``K`` values.
DEVIATIONS = 5
_NONE = np.int64(2**63 - 1)


def least_overlap(percent: int) -> int:
    """Of the ``K`` smallest values of a union of large sets, those that a pair at the threshold shares at least (40 at 85, 35 at 80)."""
    p = percent / 100
    return int(p * K - DEVIATIONS * (p * (1 - p) * K) ** 0.5)


def prefix_length(n: Column, percent: int) -> Column:
    """How many of its retained values, rarest first, a set of ``n`` shingles has to be listed under."""
    most = F.floor(100 * n / percent)  # shingles of a partner, of which it retains K
    shared = F.ceil(percent * n / 100) - F.greatest(most - K, F.lit(0))
    return F.when(n <= K, n - shared + 1).otherwise(K - least_overlap(percent) + 1).cast("int")


def set_digest(u: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    if not len(u):
        return b""
    a = tx.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype="u8")
    b = tx.mix(u + np.uint64(0x14057B7EF767814F)).sum(dtype="u8")
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in tx.pieces(batch.column(1)):
            start, length, first = tx.words(data, at)
            h = tx.word_hashes(data, start, length)
            n, digest, sketch = [], [], []
            for r in range(j - i):
                s = np.sort(tx.shingle_hashes(h[first[r] : first[r + 1]], SHINGLE) >> np.uint64(1))
                u = s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
                n.append(len(u))
                digest.append(set_digest(u))
                sketch.append(u[:K].view("i8"))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(b) for b in sketch]))), pa.int32()), pa.array(np.concatenate(sketch), pa.int64())
            )
            own = [batch.column(k).slice(i, j - i) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"]
            )
    tx.release()


def shingle_set(text: str) -> set[bytes]:
    """The exact set: shingles as byte strings."""
    w = tx.lower_words(text)
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)))


def _verified(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, set] = (-1, set())
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                if last[0] != (hub := b[k].as_py()):
                    last = hub, shingle_set(tb[k].as_py() or "")
                x, y = shingle_set(ta[k].as_py() or ""), last[1]
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tx.release()

    return verify


def union_estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that both have, values) among the ``K`` smallest of each union of two sketches.

    Rows of ``x`` and ``y`` are sketches, filled up with ``_NONE``.
    """
    both = np.sort(np.concatenate((x, y), axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~again, axis=1)
    there = (both != _NONE) & (rank <= K)
    return (again & there).sum(axis=1), (~again & there).sum(axis=1)


def _filled(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of ``K``."""
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), K), _NONE)
    out[np.arange(K) < size[:, None]] = column.flatten().to_numpy()
    return out


def _estimate(percent: int):
    """Of pairs (a, b, na, nb, sketches) those that can be similar enough by the estimate on their union."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shared, total = union_estimate(_filled(batch.column(4)), _filled(batch.column(5)))
            small = np.maximum(batch.column(2).to_numpy(), batch.column(3).to_numpy()) <= K  # known exactly
            near = np.where(small, 100 * shared >= percent * total, shared >= least_overlap(percent))
            yield batch.select([0, 1]).filter(pa.array(near))
        tx.release()

    return estimate


def node_texts(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(id, text) of the nodes in ``wanted`` (id; about ``n`` rows), from the row that stands for each."""
    place = materialize(nodes.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), "wanted", n)
    # Texts are picked where they are read, if the ids are few enough to broadcast.
    rows = docs.select("doc_id", "text").join(sized(place), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h")))
    return rows.groupBy("id").agg(F.min("text").alias("text"))


def exact_links(pairs: DataFrame, sketches: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """Of candidate ``pairs`` (a, b; written) those whose full sets are similar enough, written under ``name``."""
    by = lambda k: sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    known = deal_join(deal_join(pairs, by("a"), "a", "b"), by("b"), "b", "a", counted=pairs)
    n = pairs.count() + sketches.count()
    known = known.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    likely = materialize(
        known.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimate(percent), "a long, b long"), "likely", n, FILE_ROWS // 2
    )
    n = likely.count()
    ends = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = materialize(node_texts(docs, ends, nodes, 2 * n), "candidate-texts", 2 * n, TEXTS)
    of = lambda k: text.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    both = deal_join(deal_join(likely, of("a"), "a", "b"), of("b"), "b", "a", counted=likely)
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_verified(percent), "a long, b long"), name, n, TEXTS)


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, es, bits): each text's shingle hashes, and ``BITS`` bits of which each hash sets one."""
    for batch in batches:
        for i, j, data, at in tx.pieces(batch.column(1)):
            start, length, first = tx.words(data, at)
            h = tx.word_hashes(data, start, length)
            sets = [np.unique(tx.shingle_hashes(h[first[r] : first[r + 1]], SHINGLE)) for r in range(j - i)]
            n = np.array([len(x) for x in sets])
            mask = np.zeros((j - i, BITS), bool)
            every = np.concatenate(sets)
            mask[np.repeat(np.arange(j - i), n), (every % np.uint64(BITS)).astype("i8")] = True
            es = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(every.view("i8")))
            words = BITS // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * words, pa.int32()), pa.array(np.packbits(mask, axis=1).view("i8").ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), es, bits], names=["id", "n", "es", "bits"])
    tx.release()


def unlike(x: str, y: str) -> Column:
    """Bits that one of two sets has alone: each stems from a shingle that one of them has alone, so those are as many at least."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)


def prefix_pairs(docs: DataFrame, members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, component) of different components that can be similar enough."""
    m = members.count()
    sets = node_texts(docs, members.select("id"), nodes, m).mapInArrow(_member_sets, "id long, n long, es array<long>, bits array<long>")
    sets = materialize(sets, "member-sets", m, TEXTS)
    rows = sets.select("id", "n", F.explode("es").alias("e"))  # made again where it is read
    n = rows.count()
    limit = hot_limit(n)
    known = with_counts(rows, "e", limit, n)
    order = Window.partitionBy("id").orderBy("c", "e")
    ranked = known.select(
        "id", "n", "e", "c", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("shared")
    )
    at = ranked.select("id", "n", "e", "c", (F.col("n") - F.col("shared") + F.col("k")).alias("at"))
    prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    short = materialize(at.where(F.col("at") <= prefix).join(members, "id"), "prefixes", n * (100 - percent) // 100 + m)
    n = short.count()
    mixed = short.groupBy("e", "c").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("e", "c")
    rest = hot_join(short, materialize(mixed, "mixed-shingles", n), "e", limit, "left_semi")
    rest = materialize(rest.join(sets.select("id", "bits"), "id"), "mixed-prefixes", n, FILE_ROWS // 2)
    names = {"id": "", "n": "n", "at": "p", "component": "c", "bits": "b"}
    side = lambda k: rest.select("e", *[F.col(c).alias(f"{short_}{k}") for c, short_ in names.items()])
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    possible = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    apart = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb"))
    # Of n shingles each, a pair has na + nb - 2 * (those in both) that one has alone.
    pairs = side("a").join(side("b"), "e").where(apart & (possible >= least) & (unlike("ba", "bb") <= F.col("na") + F.col("nb") - 2 * least))
    return materialize(pairs.select("a", "b").distinct(), "pairs", n, TEXTS)


def candidate_lists(sketches: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(key, id, w, c) of every node under the retained values of its prefix that c >= 2 nodes have there; rows beyond which a key is hot.

    ``w``: how often its retained values are retained by any node.
    """
    values = sketches.select("id", "n", F.explode("sketch").alias("e"))  # made again where it is read: the sketches are an eighth of its size
    n = values.count()
    shared = with_counts(values, "e", hot_limit(n), n)
    own = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("x"))  # K values at most
    rare = F.greatest(prefix_length(F.col("n"), percent) - (F.least(F.col("n"), F.lit(K)) - F.size("x")), F.lit(0)).cast("int")
    weight = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v["c"]).alias("w")
    lists = own.select("id", weight, F.explode(F.slice("x", F.lit(1), rare)).alias("v")).select("id", "w", F.col("v.e").alias("key"))
    lists = materialize(lists, "lists", n, 8 * FILE_ROWS)
    n = lists.count()
    limit = hot_limit(n)
    out = materialize(with_counts(lists, "key", limit, n), "shared-lists", n)
    discard(lists)
    return out, limit


def node_groups(docs: DataFrame, nodes: DataFrame, sketches: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, component) of linked nodes, and links (a, b) between those, if there are more, that connect all that are similar enough."""
    shared, limit = candidate_lists(sketches, percent)
    n, m = sketches.count(), shared.count()
    small = shared.where(F.col("c") <= SHORT_LIST).select("key", "id")
    pairs = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").where("a > b")
    long_ = shared.where(F.col("c") > SHORT_LIST)
    near = F.floor(F.log(F.col("w")) * 20)  # classes of 5 %
    heads = [
        F.min(F.struct((-(F.col("w") if j < HUBS // 2 else near)).alias("w"), F.xxhash64("id", F.lit(j)).alias("r"), F.col("id").alias("hub"))).alias(f"h{j}")
        for j in range(HUBS)
    ]
    hubs = materialize(long_.groupBy("key", "c").agg(*heads), "hubs", m // SHORT_LIST)
    met = hot_join(long_.select("key", "id", "c"), hubs, "key", limit)
    first = met.groupBy("id").agg(F.array(*[F.min(f"h{j}")["hub"] for j in range(HUBS)]).alias("hubs"))
    stars = first.select("id", F.explode(F.array_distinct("hubs")).alias("hub")).where("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"))
    first = materialize(pairs.select("a", "b").unionByName(stars).distinct(), "candidates", n + m)
    links = exact_links(first, sketches, nodes, docs, percent, "links")
    k = links.count()
    found = materialize(components(links, "first", k), "components", 2 * k)

    # Long lists whose members are not all of one component: the pairs across components.
    labelled = long_.join(found.withColumnRenamed("id", "n_id"), F.col("id") == F.col("n_id"), "left").select(
        "key", "c", "id", F.coalesce("component", "id").alias("component")
    )
    labelled = materialize(labelled, "labelled", m)
    mixed = labelled.groupBy("key", "c").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "c")
    both = hot_join(labelled, materialize(mixed, "mixed-lists", m // SHORT_LIST), "key", limit, "left_semi")
    rest = materialize(both.select("id", "component").distinct(), "rest", n)
    more = None
    if not rest.isEmpty():
        tried = prefix_pairs(docs, rest, nodes, percent)
        tried = materialize(tried.join(first, ["a", "b"], "left_anti"), "more-candidates", tried.count())
        if not tried.isEmpty():
            more = exact_links(tried, sketches, nodes, docs, percent, "more-links")
    discard(shared, hubs, first, links, labelled)
    return found, more


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sig = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signatures, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, sketch array<long>"
    )
    sig = materialize(sig, "signatures")
    n = sig.count()
    known = sig.where("n_shingles > 0 and doc_id is not null")
    sets = known.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.count(F.lit(1)).alias("c"))
    nodes = materialize(sets.select("digest", "c", "r.*", F.monotonically_increasing_id().alias("id")), "nodes", n)
    place = nodes.select("id", "digest", "doc_id", "text_hash")
    sketches = known.join(place, ["digest", "doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("n"), "sketch")
    sketches = materialize(sketches, "sketches", n, FILE_ROWS // 2)
    found, more = node_groups(docs, nodes, sketches, percent)

    several = known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    several = materialize(several, "several-texts", n)
    if not several.isEmpty():  # a document with several texts links them
        own = known.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
        own = own.withColumnRenamed("doc_id", "d").join(nodes.select("digest", "id"), "digest")
        same = own.join(own.groupBy("d").agg(F.min("id").alias("b")), "d").where("id <> b").select(F.col("id").alias("a"), "b")
        more = same if more is None else more.unionByName(same)
    if more is not None:
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = materialize(components(stars.unionByName(more), "all", n), "all-components", n)

    labelled = nodes.join(found, "id", "left").select("digest", "c", "doc_id", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled, "labels", n)
    names = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k"))
    side = materialize(split_join(labelled, materialize(names, "names", n), "component", "k", hot_limit(labelled)).select("digest", "c", "component_id"), "side", n)
    rows = known.select("doc_id", "n_shingles", "digest")
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = split_join(rows, side, "digest", "c", hot_limit(sig)).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(alone)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose doc_id names the component."""
    found = near_duplicates(docs.select("doc_id", "text"), STAGE_PERCENT)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(sized(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")


#: Every pair of documents that share a shingle, and the closure of the links: for small tables.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)
), r AS (
  SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, y FROM r JOIN l ON x = seen
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id, n
"""
