"""The registered queries of the engine over the driver's tables, each with its SQL where SQL can state it.

Inputs are whole tables. String pairs are the two text columns of each part, of each
line of two conversation turns or of two document attributes; vector pairs are
neighbouring ids of the embeddings; point clouds are the embeddings of a label; scored
candidates are the labelled documents, with the source as the pair.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import encoder, matrices, register, syntax, topology, vectors
from matchloom.operators import candidates, evaluate, model, profile, protocol, report, splits, stats
from matchloom.session import materialize
from matchloom.sources import catalog, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.col:
    return F.round(c, 6)


# Profiles and candidates

_TEXT_SQL = """
  SELECT col, col || ' || ' || left(string_agg(left(v, 80), ' | ' ORDER BY rn), 100000) AS text FROM (
    SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn
    FROM (SELECT col, trim(v) AS v, count(*) AS n FROM {flat} WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY ALL)
  ) WHERE rn <= 20 GROUP BY col
"""


def _flat(table: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS col, CAST({e} AS VARCHAR) AS v FROM {table}" for c, e in columns.items()]
    return "(" + " UNION ALL ".join(parts) + ")"


_CUSTOMER = {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "c_nationkey", "c_acctbal": "CAST(c_acctbal AS DECIMAL(38,4))", "c_mktsegment": "c_mktsegment"}
_SUPPLIER = {"s_suppkey": "s_suppkey", "s_name": "s_name", "s_nationkey": "s_nationkey", "s_acctbal": "CAST(s_acctbal AS DECIMAL(38,4))"}
_CUSTOMER_SQL = _TEXT_SQL.format(flat=_flat("customer", _CUSTOMER))
_SUPPLIER_SQL = _TEXT_SQL.format(flat=_flat("supplier", _SUPPLIER))


@query("profile_column_text", f'SELECT col AS "column", lower(col) AS norm, left(text, 2000) AS text FROM ({_CUSTOMER_SQL})')
def profile_column_text(spark, sf_dir):
    return profile.column_texts(t(spark, sf_dir, "customer"))


def customer_supplier(spark, sf_dir) -> DataFrame:
    side = lambda n: profile.column_texts(t(spark, sf_dir, n)).withColumn("pair_id", F.lit("customer__supplier"))
    return candidates.candidate_pairs(side("customer"), side("supplier"))


def suffix_truth(pairs: DataFrame) -> DataFrame:
    """Columns match if their names are the same behind the table's prefix."""
    tail = lambda c: F.regexp_replace(c, "^[a-z]_", "")
    return pairs.where(tail("source_norm") == tail("target_norm")).select(
        "pair_id", F.col("source_norm").alias("source_col_norm"), F.col("target_norm").alias("target_col_norm")
    )


_PAIRS_SQL = f"""
  SELECT 'customer__supplier' AS pair_id, c.col AS source_column, s.col AS target_column,
         left(c.text, 2000) AS source_text, left(s.text, 2000) AS target_text
  FROM ({_CUSTOMER_SQL}) c CROSS JOIN ({_SUPPLIER_SQL}) s
"""


@query("candidate_pairs", _PAIRS_SQL)
def candidate_pairs(spark, sf_dir):
    return customer_supplier(spark, sf_dir).select("pair_id", "source_column", "target_column", "source_text", "target_text")


@query(
    "candidate_labels",
    f"SELECT pair_id, source_column, target_column, CAST(substr(source_column, 3) = substr(target_column, 3) AS INTEGER) AS label FROM ({_PAIRS_SQL})",
)
def candidate_labels(spark, sf_dir):
    pairs = customer_supplier(spark, sf_dir)
    return candidates.label(pairs, suffix_truth(pairs)).select("pair_id", "source_column", "target_column", "label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, candidates, native string features, label, mean score, precision, recall and F1."""
    pairs = customer_supplier(spark, sf_dir)
    labelled = candidates.label(pairs, suffix_truth(pairs))
    x, y = syntax.normalize_ascii(F.col("source_norm")), syntax.normalize_ascii(F.col("target_norm"))
    made = syntax.syntax_native(x, y)
    five = ("syn_levenshtein_sim", "syn_jaccard_tokens", "syn_jaccard_bigrams", "syn_common_suffix_ratio", "syn_dice_tokens")
    scored = labelled.withColumn("score", sum((made[n] for n in five), F.lit(0.0)) / len(five))
    return evaluate.pair_metrics(scored.withColumn("pred", (F.col("score") > 0.5).cast("int")))


QUERIES["flagship"] = flagship


def entities(spark, sf_dir, tables_: str | tuple[str, ...], pair_id: str, maxdim: int | None = None) -> DataFrame:
    """The encoded columns of tables: (table, column, norm, text, vec, tok), tok of at most the encoder's 64 words.

    Written once: pairs, labels and every feature family read them. With ``maxdim`` they
    have their spectral statistics and diagrams.
    """
    texts = None
    for n in (tables_,) if isinstance(tables_, str) else tables_:
        one = profile.column_texts(t(spark, sf_dir, n)).withColumns({"pair_id": F.lit(pair_id), "table": F.lit(n)})
        texts = one if texts is None else texts.unionByName(one)
    # Few rows and much work on each: a fixed number of tasks, not merged by size.
    encoded = encoder.encode(texts.repartition(16, "table", "column"), "text")
    return materialize(encoded if maxdim is None else candidates.with_entity_features(encoded, maxdim), "entities")


@query("candidate_features_reduced")
def candidate_features_reduced(spark, sf_dir):
    side = lambda n: entities(spark, sf_dir, n, "customer__supplier")
    pairs = candidates.candidate_pairs(side("customer"), side("supplier"))
    made = candidates.with_features(candidates.label(pairs, suffix_truth(pairs)), list(candidates.REDUCED_FEATURES))
    return made.select("pair_id", "source_column", "target_column", "label", *candidates.REDUCED_FEATURES)


_WIDE = (("customer", "orders", "lineitem", "part"), ("supplier", "nation", "region", "events", "documents", "pages", "benchmark", "labels", "conversations"))


def wide_candidates(spark, sf_dir, maxdim: int | None = None) -> DataFrame:
    """A pair of many columns: those of four tables against those of nine."""
    pairs = candidates.candidate_pairs(*(entities(spark, sf_dir, tables_, "wide", maxdim) for tables_ in _WIDE), part_columns=2)
    return candidates.label(pairs, suffix_truth(pairs))


@query("candidate_features_wide")
def candidate_features_wide(spark, sf_dir):
    """The ten selected features of a pair with some 700 candidates."""
    made = candidates.with_features(wide_candidates(spark, sf_dir), list(candidates.REDUCED_FEATURES))
    return report.round_numeric(made.select("source_table", "source_column", "target_table", "target_column", "label", *candidates.REDUCED_FEATURES), 6)


@query("candidate_features_full")
def candidate_features_full(spark, sf_dir):
    """All 79 features of nation x region, with homology up to dimension 2."""
    side = lambda n: entities(spark, sf_dir, n, "nation__region", 2)
    pairs = candidates.candidate_pairs(side("nation"), side("region"))
    made = candidates.with_features(candidates.label(pairs, suffix_truth(pairs)), list(candidates.ALL_FEATURES))
    return made.select("pair_id", "source_column", "target_column", "label", *candidates.ALL_FEATURES)


# String similarities


def string_pairs(spark, sf_dir) -> DataFrame:
    """(k, a, b): name with type and brand of each part."""
    p = t(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("b"))


_SP = "SELECT p_partkey AS k, p_name AS a, p_type || ' ' || p_brand || ' ' || p_name AS b FROM part"
_NORM = f"SELECT k, a, b, trim(regexp_replace(lower(a), '[^0-9a-z]+', ' ', 'g')) AS x, trim(regexp_replace(lower(b), '[^0-9a-z]+', ' ', 'g')) AS y FROM ({_SP})"


def normal_pairs(spark, sf_dir) -> DataFrame:
    return string_pairs(spark, sf_dir).select("k", "a", "b", syntax.normalize_ascii(F.col("a")).alias("x"), syntax.normalize_ascii(F.col("b")).alias("y"))


def _native(names):
    def run(spark, sf_dir):
        made = syntax.syntax_native(F.col("x"), F.col("y"))
        return normal_pairs(spark, sf_dir).select("k", *[r6(made[n]).alias(n) for n in names])

    return run


def _arrow(names):
    def run(spark, sf_dir):
        made = string_pairs(spark, sf_dir).select("k", syntax.syntax_features(F.col("a"), F.col("b"), names).alias("f"))
        return made.select("k", *[r6(F.col("f")[n]).alias(n) for n in names])

    return run


_LONGEST = "greatest(length(x), length(y), 1)"
query(
    "syn_lengths_contains",
    f"SELECT k, CAST(length(x) AS DOUBLE) AS syn_len_a, CAST(length(y) AS DOUBLE) AS syn_len_b, CAST(length(x) > 0 AND contains(y, x) AS INTEGER)::DOUBLE AS syn_contains_a_in_b, CAST(length(y) > 0 AND contains(x, y) AS INTEGER)::DOUBLE AS syn_contains_b_in_a FROM ({_NORM})",
)(_native(["syn_len_a", "syn_len_b", "syn_contains_a_in_b", "syn_contains_b_in_a"]))
query(
    "syn_equality",
    f"SELECT k, CAST(a = b AS INTEGER)::DOUBLE AS syn_equal_exact, CAST(lower(a) = lower(b) AS INTEGER)::DOUBLE AS syn_equal_casefold FROM ({_SP})",
)(_arrow(["syn_equal_exact", "syn_equal_casefold"]))
query(
    "syn_levenshtein",
    f"SELECT k, levenshtein(x, y)::DOUBLE AS syn_levenshtein, round(1 - levenshtein(x, y) / {_LONGEST}, 6) AS syn_levenshtein_sim FROM ({_NORM})",
)(_native(["syn_levenshtein", "syn_levenshtein_sim"]))
_PREFIX = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: left({0}, i) = left({1}, i)))"
query(
    "syn_prefix_suffix",
    f"SELECT k, round({_PREFIX.format('x', 'y')} / {_LONGEST}, 6) AS syn_common_prefix_ratio, round({_PREFIX.format('reverse(x)', 'reverse(y)')} / {_LONGEST}, 6) AS syn_common_suffix_ratio FROM ({_NORM})",
)(_native(["syn_common_prefix_ratio", "syn_common_suffix_ratio"]))
_SETS = (
    "CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6) END"
)
query(
    "syn_token_sets",
    f"""WITH s AS (SELECT k, list_distinct(string_split(x, ' ')) AS p, list_distinct(string_split(y, ' ')) AS q FROM ({_NORM}))
    SELECT k, round(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) AS syn_jaccard_tokens,
           round(2 * len(list_intersect(p, q)) / (len(p) + len(q)), 6) AS syn_dice_tokens FROM s""",
)(_native(["syn_jaccard_tokens", "syn_dice_tokens"]))
_G = "list_transform(range(1, length(replace({0}, ' ', '')) - {1} + 2), lambda i: substr(replace({0}, ' ', ''), i, {1}))"
_J = "round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6)"
query(
    "syn_ngram_sets",
    f"""WITH s AS (SELECT k, {_G.format('x', 2)} AS a2, {_G.format('y', 2)} AS b2, {_G.format('x', 3)} AS a3, {_G.format('y', 3)} AS b3 FROM ({_NORM}))
    SELECT k, {_J.format('a2', 'b2')} AS syn_jaccard_bigrams, {_J.format('a3', 'b3')} AS syn_jaccard_trigrams FROM s""",
)(_native(["syn_jaccard_bigrams", "syn_jaccard_trigrams"]))
_COS = """
  SELECT s.k, round(coalesce(d.dot, 0) / sqrt(na.n * nb.n), 6) AS {name} FROM s
  LEFT JOIN (SELECT a.k, sum(a.n * b.n) AS dot FROM a{n} a JOIN b{n} b ON a.k = b.k AND a.g = b.g GROUP BY a.k) d ON s.k = d.k
  JOIN (SELECT k, sum(n * n) AS n FROM a{n} GROUP BY k) na ON s.k = na.k JOIN (SELECT k, sum(n * n) AS n FROM b{n} GROUP BY k) nb ON s.k = nb.k
"""
query(
    "syn_ngram_cosine",
    f"""WITH s AS (SELECT k, x, y FROM ({_NORM})),
    {", ".join(f"{c}{n} AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest({_G.format('x' if c == 'a' else 'y', n)}) AS g FROM s) GROUP BY ALL)" for c in "ab" for n in (2, 3))}
    SELECT p.k, syn_cosine_bigrams, syn_cosine_trigrams FROM ({_COS.format(n=2, name="syn_cosine_bigrams")}) p JOIN ({_COS.format(n=3, name="syn_cosine_trigrams")}) q ON p.k = q.k""",
)(_native(["syn_cosine_bigrams", "syn_cosine_trigrams"]))
_BI = {c: _G.format(c, 2) for c in "xy"}
ORACLES["flagship"] = f"""WITH p AS (SELECT pair_id, source_column, target_column, trim(regexp_replace(lower(source_column), '[^0-9a-z]+', ' ', 'g')) AS x,
  trim(regexp_replace(lower(target_column), '[^0-9a-z]+', ' ', 'g')) AS y FROM ({_PAIRS_SQL})),
s AS (SELECT *, string_split(x, ' ') AS tx, string_split(y, ' ') AS ty, {_BI['x']} AS gx, {_BI['y']} AS gy FROM p),
r AS (SELECT pair_id, CAST(substr(source_column, 3) = substr(target_column, 3) AS INTEGER) AS label, CAST((1 - levenshtein(x, y) / {_LONGEST}
    + len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty))) + coalesce(len(list_intersect(gx, gy)) / nullif(len(list_distinct(list_concat(gx, gy))), 0), 1)
    + {_PREFIX.format('reverse(x)', 'reverse(y)')} / {_LONGEST} + 2 * len(list_intersect(tx, ty)) / (len(list_distinct(tx)) + len(list_distinct(ty)))) / 5 > 0.5 AS INTEGER) AS pred FROM s),
n AS (SELECT pair_id, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM r GROUP BY pair_id)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM n"""
_JW = "j + 0.1 * len(list_filter(range(1, least(length(x), length(y), 4) + 1), lambda i: left(x, i) = left(y, i))) * (1 - j)"
query("syn_jaro", f"SELECT k, round(CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jaro_similarity(x, y) END, 6) AS syn_jaro FROM ({_NORM})")(_arrow(["syn_jaro"]))
query(
    "syn_jaro_winkler",
    f"SELECT k, round({_JW}, 6) AS syn_jaro_winkler FROM (SELECT k, x, y, CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jaro_similarity(x, y) END AS j FROM ({_NORM}))",
)(_arrow(["syn_jaro_winkler"]))
query("syn_osa_lcs")(_arrow(["syn_damerau_osa", "syn_damerau_osa_sim", "syn_lcs_len", "syn_lcs_ratio"]))


@query("syn_all_conversations")
def syn_all_conversations(spark, sf_dir):
    """All 22 features of neighbouring turns, whole texts, accents included."""
    c = t(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    both = c.select("conv_id", "turn", F.col("text").alias("a")).join(n, ["conv_id", "turn"])
    f = syntax.syntax_features(F.col("a"), F.col("b"))
    return both.withColumn("f", f).select("conv_id", "turn", *[r6(F.col("f")[x]).alias(x) for x in syntax.SYNTAX_FEATURES])


@query(
    "text_normalize",
    """SELECT conv_id, turn, trim(regexp_replace(lower(trim(strip_accents(text))), '[^0-9a-z]+', ' ', 'g')) AS norm, strip_accents(text) AS plain FROM conversations""",
)
def text_normalize(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", syntax.normalize_text(F.col("text")).alias("norm"), syntax.strip_accents_text(F.col("text")).alias("plain"))


@query(
    "alnum_tokens",
    "SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM benchmark",
)
def alnum_tokens(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("words"))
    return b.select("item_id", "words", F.size("words").cast("long").alias("n"))


@query("hash_seed", "SELECT doc_id, left(sha1(text), 16) AS prefix FROM documents")
def hash_seed(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"), encoder.hash_seed_native(F.col("text")).alias("seed"))
    return d.select("doc_id", F.lower(F.lpad(F.conv(F.col("seed").cast("string"), 10, 16), 16, "0")).alias("prefix"))


@query(
    "sql_functions",
    f"""SELECT k, levenshtein(x, y)::DOUBLE AS lev, length(x)::DOUBLE AS len_a, round(CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jaro_similarity(x, y) END, 6) AS jaro FROM ({_NORM})""",
)
def sql_functions(spark, sf_dir):
    """The features as functions of Spark SQL."""
    register.register(spark)
    string_pairs(spark, sf_dir).createOrReplaceTempView("string_pairs")
    return spark.sql("SELECT k, syn_levenshtein(a, b) AS lev, syn_len_a(a, b) AS len_a, round(syn_jaro(a, b), 6) AS jaro FROM string_pairs")


# Vector distances


def vector_pairs(spark, sf_dir) -> DataFrame:
    """(vec_id, x, y): each embedding and the next."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


_VP = """WITH v AS (SELECT a.vec_id, list_transform(a.embedding, lambda z: z::DOUBLE) AS x, list_transform(b.embedding, lambda z: z::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
u AS (SELECT vec_id, unnest(x) AS p, unnest(y) AS q, generate_subscripts(x, 1) AS i FROM v) """
_CLS_SQL = {
    "cls_euclidean": "sqrt(sum((p - q) ** 2))",
    "cls_cosine_sim": "sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))",
    "cls_cosine_dist": "1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))",
    "cls_pearson": "corr(p, q)",
    "cls_minkowski": "pow(sum(pow(abs(p - q), 3)), 1 / 3.0)",
    "cls_canberra": "sum(CASE WHEN abs(p) + abs(q) > 0 THEN abs(p - q) / (abs(p) + abs(q)) ELSE 0 END)",
    "cls_chebyshev": "max(abs(p - q))",
}


def _cls(name):
    def run(spark, sf_dir):
        made = vectors.classical_native(F.col("x"), F.col("y"))[name]
        return vector_pairs(spark, sf_dir).select("vec_id", F.round(vectors.clean(made), 5).alias(name))

    return run


for _n, _e in _CLS_SQL.items():
    query(_n, f"{_VP} SELECT vec_id, round({_e}, 5) AS {_n} FROM u GROUP BY vec_id")(_cls(_n))


@query(
    "cls_spearman",
    f"""{_VP}, k AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY p) + (count(*) OVER (PARTITION BY vec_id, p) - 1) / 2.0 AS rp,
      rank() OVER (PARTITION BY vec_id ORDER BY q) + (count(*) OVER (PARTITION BY vec_id, q) - 1) / 2.0 AS rq FROM u)
    SELECT vec_id, round(corr(rp, rq), 5) AS cls_spearman FROM k GROUP BY vec_id""",
)
def cls_spearman(spark, sf_dir):
    v = vector_pairs(spark, sf_dir).select("vec_id", vectors.average_ranks(F.col("x")).alias("x"), vectors.average_ranks(F.col("y")).alias("y"))
    return v.select("vec_id", F.round(vectors.pearson(F.col("x"), F.col("y")), 5).alias("cls_spearman"))


# Matrices and point clouds: the embeddings of a label


def clouds(spark, sf_dir) -> DataFrame:
    """(label, tok): all of a label's vectors, in order of their ids. A cloud is one value of the functions on it."""
    e = t(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    return e.repartition(32, "label").select("label", F.transform("m", lambda x: x["embedding"]).alias("tok"))


def _stats(names, f):
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(tok: pd.Series) -> pd.DataFrame:
        return encoder.to_frame([f(encoder.matrix(x)) for x in tok], names)

    return run


@query("spc_stats")
def spc_stats(spark, sf_dir):
    names = tuple(f"spc_{s}" for s in matrices.SPECTRAL_STATS)
    f = _stats(names, lambda m: {f"spc_{k}": v for k, v in matrices.spectral(m).items()})
    return clouds(spark, sf_dir).select("label", f("tok").alias("s")).select("label", *[r6(F.col("s")[n]).alias(n) for n in names])


@query(
    "spc_cov_trace",
    """SELECT label, round(sum(v), 5) AS cov_trace FROM (
      SELECT label, i, var_samp(p) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label""",
)
def spc_cov_trace(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("label", F.posexplode(vectors.doubles(F.col("embedding"))).alias("i", "p"))
    return e.groupBy("label", "i").agg(F.var_samp("p").alias("v")).groupBy("label").agg(F.round(F.sum("v"), 5).alias("cov_trace"))


@query(
    "spc_self_cluster",
    """WITH e AS (SELECT label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
    g AS (SELECT a.label, sqrt(sum(pow(list_dot_product(a.v, b.v), 2))) AS f FROM e a JOIN e b ON a.label = b.label GROUP BY a.label),
    n AS (SELECT label, count(*) AS n, max(len(v)) AS d FROM e GROUP BY label)
    SELECT label, round((d * f - n * (d + n - 1)) / ((d - 1) * (n - 1) * n), 5) AS self_cluster FROM g JOIN n USING (label) WHERE n >= 2""",
)
def spc_self_cluster(spark, sf_dir):
    """From the Gram matrix of the columns (d x d sums), whose norm is that of the rows: no pairs of rows."""
    x = t(spark, sf_dir, "embeddings").select("label", vectors.doubles(F.col("embedding")).alias("x"))
    n = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"))
    p = x.select("label", "x", F.posexplode("x").alias("i", "a")).select("label", "i", "a", F.posexplode("x").alias("j", "b"))
    g = p.groupBy("label", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).groupBy("label").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("f"))
    d, m = F.col("d"), F.col("n")
    value = (d * F.col("f") - m * (d + m - 1)) / ((d - 1) * (m - 1) * m)
    return g.join(n, "label").where("n >= 2").select("label", F.round(value, 5).alias("self_cluster"))


def cloud_pairs(spark, sf_dir) -> DataFrame:
    """Each label's cloud with the next label's."""
    c = clouds(spark, sf_dir)
    return c.select(F.col("label").alias("a"), F.col("tok").alias("x")).join(c.select((F.col("label") - 1).alias("a"), F.col("tok").alias("y")), "a")


def _pair_stats(names, f):
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return encoder.to_frame([f(encoder.matrix(p), encoder.matrix(q)) for p, q in zip(x, y, strict=True)], names)

    return run


def _pairs_query(names, f):
    def run(spark, sf_dir):
        made = cloud_pairs(spark, sf_dir).select("a", _pair_stats(names, f)("x", "y").alias("s"))
        return made.select("a", *[r6(F.col("s")[n]).alias(n) for n in names])

    return run


_TRIANGLE = "label int, n long, width int, r array<double>"


def _merged(frames, ready: bool):
    """Rows with 1 before each, or triangles of them (``ready``), to triangles by label; at most 256 labels are held."""
    open_: dict = {}

    def close():
        done = [(k, n, r.shape[1], r.ravel()) for k, (n, r) in open_.items()]
        open_.clear()
        return pd.DataFrame(done, columns=["label", "n", "width", "r"])

    for pdf in frames:
        for label, part in pdf.groupby("label", dropna=False):
            label = None if pd.isna(label) else int(label)
            if ready:
                n, rows = int(part["n"].sum()), [np.reshape(x, (-1, w)) for x, w in zip(part["r"], part["width"], strict=True)]
            else:
                m = np.vstack([np.asarray(x, float) for x in part["embedding"]])
                n, rows = len(m), [np.column_stack([np.ones(len(m)), m])]
            before, r = open_.get(label, (0, None))
            open_[label] = before + n, matrices.triangle(np.vstack(rows if r is None else [r, *rows]))
        if len(open_) > 256:
            yield close()
    if open_:
        yield close()


def triangles(spark, sf_dir) -> DataFrame:
    """(label, n, width, r): of all vectors of a label with 1 before each, the triangle that has the same singular values; no cloud is gathered."""
    e = t(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), "embedding")
    made = e.mapInPandas(lambda frames: _merged(frames, False), _TRIANGLE)
    return made.groupBy("label").applyInPandas(lambda pdf: next(_merged([pdf], True)), _TRIANGLE)  # one small row for each task and label


@query("spc_pair")
def spc_pair(spark, sf_dir):
    @F.pandas_udf(", ".join(f"{n} double" for n in matrices.SPECTRAL_FEATURES))
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        side = lambda p: [(np.reshape(r, (-1, w)), n) for n, w, r in zip(p["n"], p["width"], p["r"], strict=True)]
        return encoder.to_frame([matrices.spectral_pair_of_triangles(*a, *b) for a, b in zip(side(x), side(y), strict=True)], matrices.SPECTRAL_FEATURES)

    c = triangles(spark, sf_dir)
    one = F.struct("n", "width", "r")
    made = c.select(F.col("label").alias("a"), one.alias("x")).join(c.select((F.col("label") - 1).alias("a"), one.alias("y")), "a").select("a", run("x", "y").alias("s"))
    return made.select("a", *[r6(F.col("s")[n]).alias(n) for n in matrices.SPECTRAL_FEATURES])


_OVERLAP = ("tda_overlap_sym", "tda_overlap_a2b", "tda_overlap_b2a")
query(
    "tda_overlap",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
    own AS (SELECT a.vec_id, min(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
    across AS (SELECT a.vec_id, a.label AS l, b.label AS m, min(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON abs(a.label - b.label) = 1 GROUP BY a.vec_id, a.label, b.label),
    s AS (SELECT l, m, avg(CASE WHEN across.d <= own.d THEN 1.0 ELSE 0.0 END) AS p FROM across JOIN own USING (vec_id) GROUP BY l, m)
    SELECT f.l AS a, round((f.p + g.p) / 2, 6) AS tda_overlap_sym, round(f.p, 6) AS tda_overlap_a2b, round(g.p, 6) AS tda_overlap_b2a
    FROM s f JOIN s g ON f.l = g.m AND f.m = g.l WHERE f.m = f.l + 1""",
)(_pairs_query(_OVERLAP, lambda a, b: dict(zip(_OVERLAP, topology.overlap(a, b), strict=True))))


@query(
    "vr_edges",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings)
    SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_distance(a.v, b.v) <= 1.2""",
)
def vr_edges(spark, sf_dir):
    """The edges of length up to 1.2 within a label."""
    e = t(spark, sf_dir, "embeddings").select("label", "vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    b = e.select("label", F.col("vec_id").alias("j"), F.col("v").alias("w"))
    near = e.join(b, "label").where((F.col("vec_id") < F.col("j")) & (vectors.euclidean(F.col("v"), F.col("w")) <= 1.2))
    return near.select("label", F.col("vec_id").alias("i"), "j")


@query("tda_h0")
def tda_h0(spark, sf_dir):
    names = ("h0_count", "h0_max_life", "h0_entropy", "h0_total")

    def f(m):
        bars = topology.diagram(m, 0)[0]
        values = len(bars), topology.max_lifetime(bars), topology.persistence_entropy(bars), topology.total_persistence(bars)
        return dict(zip(names, map(float, values), strict=True))

    return clouds(spark, sf_dir).select("label", _stats(names, f)("tok").alias("s")).select("label", *[r6(F.col("s")[n]).alias(n) for n in names])


query("tda_h0_count", "SELECT label, count(*)::DOUBLE AS h0_count FROM embeddings GROUP BY label")(lambda spark, sf_dir: tda_h0(spark, sf_dir).select("label", "h0_count"))


def _diagram_names(maxdim: int) -> tuple[str, ...]:
    return tuple(f"tda_all_h{k}_{s}" for k in range(maxdim + 1) for s in ("count", "max_life", "entropy"))


def _diagram_stats(maxdim: int):
    names = _diagram_names(maxdim)
    return _stats(names, lambda m: {k: v for k, v in topology.unary(topology.diagram(m, maxdim), "all").items() if k in names})


@query("tda_h1")
def tda_h1(spark, sf_dir):
    """Of all vectors of each label."""
    made = clouds(spark, sf_dir).select("label", _diagram_stats(1)("tok").alias("s"))
    return made.select("label", *[r6(F.col("s")[n]).alias(n) for n in _diagram_names(1)])


@query("tda_h2")
def tda_h2(spark, sf_dir):
    """Of the token matrices of all columns of customer, supplier, nation and region."""
    e = entities(spark, sf_dir, ("customer", "supplier", "nation", "region"), "all")
    made = e.repartition(16, "table", "column").select("table", "column", _diagram_stats(2)("tok").alias("s"))
    return made.select("table", "column", *[r6(F.col("s")[n]).alias(n) for n in _diagram_names(2)])


_DIST = ("tda_h0_bottleneck", "tda_h1_bottleneck", "tda_h0_wasserstein", "tda_h1_wasserstein")


@query("tda_diagram_distances")
def tda_diagram_distances(spark, sf_dir):
    """Between the diagrams of all columns of customer and of supplier, made once for each column."""
    side = lambda n: entities(spark, sf_dir, n, "customer__supplier", 1)

    @F.pandas_udf(", ".join(f"{n} double" for n in _DIST))
    def distances(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            a, b = ([np.asarray(v, float).reshape(-1, 2) for v in bars] for bars in (p, q))
            rows.append(dict(zip(_DIST, (topology.bottleneck(a[0], b[0]), topology.bottleneck(a[1], b[1]), topology.wasserstein(a[0], b[0]), topology.wasserstein(a[1], b[1])), strict=True)))
        return encoder.to_frame(rows, _DIST)

    pairs = candidates.candidate_pairs(side("customer"), side("supplier")).repartition(16, "source_column", "target_column")
    made = pairs.select("source_column", "target_column", distances("source_bars", "target_bars").alias("s"))
    return made.select("source_column", "target_column", *[r6(F.col("s")[n]).alias(n) for n in _DIST])


query("tda_h0_entropy_combined")(_pairs_query(("tda_h0_entropy_combined",), lambda a, b: {"tda_h0_entropy_combined": topology.h0_entropy_combined(np.vstack([a, b]))}))

# Evaluation: labelled documents, source as the pair, a score from the length


def scored(spark, sf_dir) -> DataFrame:
    d, lab = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    s = F.round((F.col("n_chars") % 1000) / 1000.0, 3)
    return d.select("doc_id", F.col("source").alias("pair_id"), "lang", s.alias("score")).join(lab.select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


_SCORED = "SELECT doc_id, source AS pair_id, lang, round((n_chars % 1000) / 1000.0, 3) AS score, quality AS label, toxic FROM documents JOIN labels USING (doc_id)"
_PRED = f"SELECT *, CAST(score > 0.3 AS INTEGER) AS pred FROM ({_SCORED})"
_PRF = """SELECT {keys} tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
  SELECT {keys} count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM ({src}) {group})"""


def predicted(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("pred", (F.col("score") > 0.3).cast("int"))


@query("pair_prf", _PRF.format(keys="pair_id,", src=_PRED, group="GROUP BY pair_id"))
def pair_prf(spark, sf_dir):
    return report.round_numeric(evaluate.pair_metrics(predicted(spark, sf_dir)), 6)


@query("global_prf", _PRF.format(keys="", src=_PRED, group=""))
def global_prf(spark, sf_dir):
    return report.round_numeric(evaluate.global_metrics(predicted(spark, sf_dir)), 6)


_SWEEP = f"""WITH s AS ({_SCORED}), p AS (SELECT pair_id, sum(label) AS total FROM s GROUP BY pair_id HAVING sum(label) > 0),
g AS (SELECT unnest(range(0, 1001)) AS k),
c AS (SELECT g.k, p.pair_id, p.total, count(s.doc_id) FILTER (s.score > g.k / 1000.0) AS n, coalesce(sum(s.label) FILTER (s.score > g.k / 1000.0), 0) AS tp
      FROM g CROSS JOIN p JOIN s ON s.pair_id = p.pair_id GROUP BY ALL),
m AS (SELECT k / 1000.0 AS threshold, avg(2 * tp / (n + total)) AS mean_f1 FROM c GROUP BY k)"""


@query("threshold_sweep", f"{_SWEEP} SELECT threshold, round(mean_f1, 6) AS mean_f1 FROM m")
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(scored(spark, sf_dir)).select("threshold", r6("mean_f1").alias("mean_f1"))


@query("best_threshold", f"{_SWEEP} SELECT threshold, round(mean_f1, 6) AS mean_f1 FROM m ORDER BY round(m.mean_f1, 12) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(scored(spark, sf_dir)).select("threshold", r6("mean_f1").alias("mean_f1"))


_CURVE = f"""WITH b AS (SELECT lang, score, sum(label) AS pos, count(*) AS n FROM ({_SCORED}) GROUP BY ALL),
c AS (SELECT lang, score, sum(pos) OVER w / sum(n) OVER w AS p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY lang) AS r, lead(score) OVER w AS lower
      FROM b WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
f AS (SELECT lang, score, lower, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM c)"""
_BEST = "SELECT lang, {s} AS threshold, round(f1, 6) AS f1 FROM f {where} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(f1, 12) DESC, {s}) = 1"


def _pr(mode):
    return lambda spark, sf_dir: evaluate.pr_threshold(scored(spark, sf_dir), ["lang"], mode).select("lang", "threshold", r6("f1").alias("f1"))


query("pr_curve_threshold_aligned", f"{_CURVE} {_BEST.format(s='score', where='')}")(_pr("aligned"))
query("pr_curve_threshold_faithful", f"{_CURVE} {_BEST.format(s='lower', where='WHERE lower IS NOT NULL')}")(_pr("faithful"))


@query(
    "ground_size_topk",
    f"SELECT doc_id, pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, doc_id) <= sum(label) OVER (PARTITION BY pair_id) AS INTEGER) AS pred FROM ({_SCORED})",
)
def ground_size_topk(spark, sf_dir):
    return evaluate.ground_size(scored(spark, sf_dir), ["pair_id"], ["doc_id"]).select("doc_id", "pair_id", "pred")


@query(
    "roc_auc",
    f"""SELECT pair_id, CASE WHEN p > 0 AND q > 0 THEN round((r - p * (p + 1) / 2) / (p * q), 6) END AS auc FROM (
    SELECT pair_id, sum(label * rk) AS r, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM (
      SELECT pair_id, label, rank() OVER (PARTITION BY pair_id ORDER BY score) + (count(*) OVER (PARTITION BY pair_id, score) - 1) / 2.0 AS rk FROM ({_SCORED})) GROUP BY pair_id)""",
)
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored(spark, sf_dir), ["pair_id"]).select("pair_id", r6("auc").alias("auc"))


@query(
    "average_precision",
    f"""{_CURVE}, g AS (SELECT lang, (r - coalesce(lag(r) OVER (PARTITION BY lang ORDER BY score DESC), 0)) * p AS s FROM f)
    SELECT lang, round(sum(s), 6) AS average_precision FROM g GROUP BY lang""",
)
def average_precision(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir), ["lang"]).select("lang", r6("average_precision").alias("average_precision"))


def matching_candidates(spark, sf_dir) -> DataFrame:
    """Candidates of each source: seven source columns against five target columns, by the remainders of the ids."""
    s = scored(spark, sf_dir)
    return s.select(
        "pair_id", F.concat_ws("-", F.lit("s"), F.col("doc_id") % 7).alias("source_col_norm"), F.concat_ws("-", F.lit("t"), F.col("doc_id") % 5).alias("target_col_norm"), "label", "score", "doc_id"
    )


@query("greedy_one_to_one")
def greedy_one_to_one(spark, sf_dir):
    return evaluate.greedy_one_to_one(matching_candidates(spark, sf_dir))


@query("metrics_bundle")
def metrics_bundle(spark, sf_dir):
    return report.round_numeric(evaluate.metrics_bundle(matching_candidates(spark, sf_dir)), 6)


# Folds

_STRATA = "SELECT doc_id AS pair_id, lang || '::' || source AS stratum FROM documents"


def strata(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), splits.stratum(F.col("lang"), F.col("source")).alias("stratum"))


@query(
    "stratified_folds",
    f"""WITH s AS ({_STRATA}), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM s GROUP BY stratum))
    SELECT pair_id, stratum, CAST((CASE WHEN least >= 5 THEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42/' || pair_id), pair_id)
      ELSE row_number() OVER (ORDER BY md5('42/' || pair_id), pair_id) END - 1) % 5 AS INTEGER) AS fold_id FROM s, m""",
)
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(strata(spark, sf_dir))


@query(
    "split_70_30",
    f"""SELECT pair_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42/' || pair_id), pair_id) <= round(count(*) OVER (PARTITION BY stratum) * 0.3) THEN 'test' ELSE 'train' END AS role FROM ({_STRATA})""",
)
def split_70_30(spark, sf_dir):
    return splits.one_split(strata(spark, sf_dir), 42)


_SPLITS = """SELECT fold_id, pair_id, CASE WHEN row_number() OVER (PARTITION BY fold_id, stratum ORDER BY md5((42 + fold_id) || '/' || pair_id), pair_id)
  <= round(count(*) OVER (PARTITION BY fold_id, stratum) * 0.3) THEN 'test' ELSE 'train' END AS role FROM (SELECT DISTINCT pair_id, stratum FROM ({src})), (SELECT unnest(range(0, 5)) AS fold_id)"""


# The SQL takes the first five seeds, each of which tests a new pair on these tables.
@query("repeated_splits", _SPLITS.format(src=_STRATA))
def repeated_splits(spark, sf_dir):
    return splits.repeated_splits(strata(spark, sf_dir))


def fold_rows(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "pair_id", "label", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("role"), (F.col("doc_id") % 11).alias("key"))


_ROWS = f"SELECT doc_id, pair_id, label, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS role, doc_id % 11 AS key FROM ({_SCORED})"


@query(
    "leakage_antijoin",
    f"""WITH r AS ({_ROWS}) SELECT doc_id, pair_id, label, key FROM r WHERE role = 'train' AND NOT (label = 1 AND EXISTS (
      SELECT 1 FROM r s WHERE s.role = 'test' AND s.label = 1 AND s.key = r.key AND s.pair_id = r.pair_id))""",
)
def leakage_antijoin(spark, sf_dir):
    r = fold_rows(spark, sf_dir)
    return splits.filter_leakage(r.where("role = 'train'").drop("role"), r.where("role = 'test'"), ["pair_id", "key"])


@query(
    "materialize_folds",
    f"""WITH f AS ({_SPLITS.format(src="SELECT source AS pair_id, 'all' AS stratum FROM documents")}), d AS (SELECT s.doc_id, s.pair_id, s.label, s.doc_id % 11 AS key, fold_id, role FROM ({_SCORED}) s JOIN f ON s.pair_id = f.pair_id),
    k AS (SELECT * FROM d WHERE role = 'test' OR label <> 1 OR NOT EXISTS (SELECT 1 FROM d t WHERE t.role = 'test' AND t.label = 1 AND t.fold_id = d.fold_id AND t.key = d.key))
    SELECT fold_id, count(*) FILTER (role = 'train') AS n_train_rows, count(*) FILTER (role = 'test') AS n_test_rows,
      count(DISTINCT pair_id) FILTER (role = 'train') AS n_train_pairs, count(DISTINCT pair_id) FILTER (role = 'test') AS n_test_pairs FROM k GROUP BY fold_id""",
)
def materialize_folds(spark, sf_dir):
    from matchloom.session import shared_folder

    pairs = t(spark, sf_dir, "documents").select(F.col("source").alias("pair_id"), F.lit("all").alias("stratum")).distinct()
    rows = scored(spark, sf_dir).select("doc_id", "pair_id", "label", (F.col("doc_id") % 11).alias("key"))
    return splits.materialize_folds(rows, splits.repeated_splits(pairs), f"{shared_folder(spark).rstrip('/')}/matchloom/{uuid.uuid4().hex}/folds", ["key"])


# Statistics: event types as methods, users as pairs, mean value as metric


def methods(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("pair_id"), "event_id", "ts", "value")
    means = report.mean_in_order(e, ["method", "pair_id"], "value", ["event_id", "ts", "value"])
    return means.select("method", "pair_id", report.round_half_away(F.col("mean"), 1).alias("f1"))


_M = "SELECT event_type AS method, user_id AS pair_id, round(avg(value), 1) AS f1 FROM events GROUP BY ALL"
_WIN = f"""WITH m AS ({_M}), p AS (SELECT a.method AS a, b.method AS b, a.pair_id, a.f1 AS x, b.f1 AS y FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.method <> b.method),
w AS (SELECT a, b, count(*) FILTER (x > y) AS wins, count(*) FILTER (x = y) AS ties, count(*) FILTER (x < y) AS losses, count(*) AS support, avg(x - y) AS mean_delta, median(x - y) AS median_delta FROM p GROUP BY a, b)"""


@query(
    "winrate_long",
    f"""{_WIN} SELECT a, b, wins, ties, losses, support, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta,
    round(CASE WHEN wins + losses > 0 THEN 100.0 * wins / (wins + losses) END, 6) AS winrate_no_ties, round((wins + 0.5 * ties) / support, 6) AS winrate_half_ties,
    round((wins - losses) / support, 6) AS cliff_delta FROM w""",
)
def winrate_long(spark, sf_dir):
    return report.round_numeric(stats.winrates(methods(spark, sf_dir), "f1"), 6)


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "winrate_matrix",
    f"""{_WIN} SELECT a AS method, {", ".join(f"max(round(CASE WHEN wins + losses > 0 THEN 100.0 * wins / (wins + losses) END, 4)) FILTER (b = '{c}') AS {c}" for c in _TYPES)} FROM w GROUP BY a""",
)
def winrate_matrix(spark, sf_dir):
    return report.round_numeric(stats.winrate_matrix(methods(spark, sf_dir), "f1", list(_TYPES)), 4)


def _matrix_query(value: str):
    name = {"support": "winrate_support_matrix", "ties": "winrate_ties_matrix"}[value]
    columns = ", ".join(f"coalesce(max({value}) FILTER (b = '{c}'), 0) AS {c}" for c in _TYPES)

    @query(name, f"{_WIN} SELECT a AS method, {columns} FROM w GROUP BY a")
    def run(spark, sf_dir):
        return stats.winrate_matrix(methods(spark, sf_dir), "f1", list(_TYPES), value).na.fill(0)


_matrix_query("support")
_matrix_query("ties")


@query("against_best", f"{_WIN}, best AS (SELECT method FROM m GROUP BY method ORDER BY avg(f1) DESC, method DESC LIMIT 1) SELECT a, b, wins, ties, losses FROM w JOIN best ON a = method")
def against_best(spark, sf_dir):
    """Of all methods: every name starts with the empty prefix."""
    return stats.against_best(methods(spark, sf_dir), "f1", "").select("a", "b", "wins", "ties", "losses")


_SIGN = """CASE WHEN wins + losses = 0 THEN 'nan'::DOUBLE ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
  lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 9) END"""


@query("sign_test", f"{_WIN} SELECT a, b, wins, losses, {_SIGN} AS sign_p FROM w")
def sign_test(spark, sf_dir):
    w = stats.winrates(methods(spark, sf_dir), "f1").select("a", "b", "wins", "losses")
    return w.withColumn("sign_p", F.round(stats.sign_test_column(F.col("wins"), F.col("losses")), 9))


@query("wilcoxon")
def wilcoxon(spark, sf_dir):
    return report.round_numeric(stats.wilcoxon_by_pair_of_methods(methods(spark, sf_dir), "f1"), 9)


_P = f"{_WIN}, q AS (SELECT a, b, round(1.0 / (1 + wins), 9) AS p FROM w), k AS (SELECT *, p * (count(*) OVER (PARTITION BY a) - row_number() OVER (PARTITION BY a ORDER BY p, b) + 1) AS s FROM q)"


@query("holm", f"{_P} SELECT a, b, p, round(least(1.0, max(s) OVER (PARTITION BY a ORDER BY p, b ROWS UNBOUNDED PRECEDING)), 6) AS holm_p FROM k")
def holm(spark, sf_dir):
    w = stats.winrates(methods(spark, sf_dir), "f1").select("a", "b", F.round(1.0 / (1 + F.col("wins")), 9).alias("p"))
    return stats.holm(w, "p", ["a"], ["b"]).select("a", "b", "p", r6("holm_p").alias("holm_p"))


# The comparison protocol: saved scores of three methods over three folds of the labelled documents


def saved_scores(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    score = lambda k: F.round((F.col("n_chars") % k) / float(k), 3)
    runs = F.array(
        *[F.struct(F.lit(r).alias("run_id"), F.lit(m).alias("method"), score(k).alias("score")) for r, m, k in (("1", "own_a", 1000), ("1", "own_b", 777), ("1", "plain", 333), ("2", "late", 100))]
    )
    return d.select(
        (F.col("doc_id") % 3).cast("int").alias("fold_id"), F.col("source").alias("pair_id"), F.concat(F.lit(" S"), F.col("doc_id")).alias("source_col_norm"),
        F.lit("T").alias("target_col_norm"), F.explode(runs).alias("r"),
    ).select("fold_id", "pair_id", "source_col_norm", "target_col_norm", "r.*")


def saved_labels(spark, sf_dir) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(
        (F.col("doc_id") % 3).cast("int").alias("fold_id"), "pair_id", F.concat(F.lit("s"), F.col("doc_id")).alias("source_col_norm"), F.lit("t").alias("target_col_norm"), "label"
    )


def labelled_scores(spark, sf_dir) -> DataFrame:
    return protocol.labelled_scores(tables.normalise_scores(saved_scores(spark, sf_dir), "documents"), saved_labels(spark, sf_dir))


_LABELLED = """SELECT CAST(doc_id % 3 AS INTEGER) AS fold_id, source AS pair_id, 's' || doc_id AS source_col_norm, quality AS label, run_id, method, round((n_chars % k) / k, 3) AS score
  FROM documents JOIN labels USING (doc_id), (VALUES ('1', 'own_a', 1000.0::DOUBLE), ('1', 'own_b', 777.0), ('1', 'plain', 333.0), ('2', 'late', 100.0)) AS v(run_id, method, k)"""
_PROTOCOL = f"""WITH d AS ({_LABELLED}), f AS (SELECT DISTINCT run_id, method, fold_id AS held FROM d),
c AS (SELECT run_id, method, held, score, sum(label) AS pos, count(*) AS n FROM d JOIN f USING (run_id, method) WHERE held <> fold_id GROUP BY ALL),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY run_id, method, held) AS total, lead(score) OVER (PARTITION BY run_id, method, held ORDER BY score DESC) AS lower
  FROM c WINDOW w AS (PARTITION BY run_id, method, held ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
th AS (SELECT run_id, method, held AS fold_id, lower AS threshold FROM u WHERE lower IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id, method, held ORDER BY round(coalesce(2 * (tp / k) * (tp / total) / nullif(tp / k + tp / total, 0), 0), 12) DESC, lower) = 1),
p AS (SELECT d.*, threshold, CAST(score >= threshold AS INTEGER) AS pred_opt_train,
  CAST(row_number() OVER (PARTITION BY d.run_id, d.method, d.fold_id, pair_id ORDER BY score DESC, source_col_norm) <= sum(label) OVER (PARTITION BY d.run_id, d.method, d.fold_id, pair_id) AS INTEGER) AS pred_ground_size
  FROM d JOIN th USING (run_id, method, fold_id)),
"""
_PRF_OF = ", ".join(
    f"round(coalesce(sum(label * pred_{p}) / nullif(sum(pred_{p}), 0), 0), 6) AS precision_{p}, round(coalesce(sum(label * pred_{p}) / nullif(sum(label), 0), 0), 6) AS recall_{p}, "
    f"round(coalesce(2 * sum(label * pred_{p}) / nullif(sum(pred_{p}) + sum(label), 0), 0), 6) AS f1_{p}"
    for p in protocol.PREDICTIONS
)
_COUNTED = "round(threshold, 6) AS threshold, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive"
_PAIR_ROWS = f"{_PROTOCOL} pm AS (SELECT run_id, method, fold_id, pair_id, {_COUNTED}, {_PRF_OF} FROM p GROUP BY run_id, method, fold_id, pair_id, threshold)"


@query("scores_join_labels", f"SELECT fold_id, pair_id, source_col_norm, run_id, method, score, label FROM ({_LABELLED})")
def scores_join_labels(spark, sf_dir):
    return labelled_scores(spark, sf_dir).select("fold_id", "pair_id", "source_col_norm", "run_id", "method", "score", "label")


@query("score_fold_metrics", f"{_PROTOCOL} x AS (SELECT 1) SELECT run_id, method, fold_id, {_COUNTED}, count(DISTINCT pair_id) AS n_pair_id, {_PRF_OF} FROM p GROUP BY run_id, method, fold_id, threshold")
def score_fold_metrics(spark, sf_dir):
    return report.round_numeric(protocol.fold_metrics(protocol.predictions(labelled_scores(spark, sf_dir))), 6)


def score_pairs(spark, sf_dir) -> DataFrame:
    return report.round_numeric(protocol.pair_metrics(protocol.predictions(labelled_scores(spark, sf_dir))), 6)


query("score_pair_metrics", f"{_PAIR_ROWS} SELECT * FROM pm")(score_pairs)


@query(
    "score_method_summary",
    f"{_PAIR_ROWS} SELECT method, "
    + ", ".join(f"round(avg({m}_{p}), 5) AS mean_{m}_{p}" for p in protocol.PREDICTIONS for m in ("f1", "precision", "recall"))
    + ", " + ", ".join(f"round(stddev_samp(f1_{p}), 5) AS std_f1_{p}" for p in protocol.PREDICTIONS)
    + ", count(DISTINCT pair_id) AS n_pair_id, count(DISTINCT run_id) AS n_runs FROM pm GROUP BY method",
)
def score_method_summary(spark, sf_dir):
    return report.round_numeric(protocol.summarize_methods(score_pairs(spark, sf_dir)), 5)


@query(
    "score_against_best",
    f"""{_PAIR_ROWS}, b AS (SELECT method AS best FROM pm WHERE method LIKE 'own~_%' ESCAPE '~' GROUP BY method ORDER BY avg(f1_opt_train) DESC, method DESC LIMIT 1),
    e AS (SELECT best, o.method, o.pair_id, x.f1_opt_train - o.f1_opt_train AS d, 'run_id+pair_id' AS paired_on FROM pm x JOIN b ON x.method = best JOIN pm o ON o.run_id = x.run_id AND o.pair_id = x.pair_id AND o.method <> best),
    g AS (SELECT best, o.method, pair_id, x.v - o.v AS d, 'pair_id_mean_over_runs' AS paired_on FROM (SELECT best, pair_id, round(avg(f1_opt_train), 9) AS v FROM pm JOIN b ON method = best GROUP BY ALL) x
      JOIN (SELECT method, pair_id, round(avg(f1_opt_train), 9) AS v FROM pm, b WHERE method <> best AND method NOT IN (SELECT method FROM e) GROUP BY ALL) o USING (pair_id)),
    w AS (SELECT best, method, paired_on, count(*) AS n_pairs_runs, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d), 5) AS mean_delta FROM (FROM e UNION ALL FROM g) GROUP BY ALL)
    SELECT *, round((wins + 0.5 * ties) / n_pairs_runs, 9) AS winrate_half_ties, {_SIGN.replace(", 9)", ", 5)")} AS sign_test_pvalue FROM w""",
)
def score_against_best(spark, sf_dir):
    made = protocol.against_best(materialize(score_pairs(spark, sf_dir), "pair-rows"), "f1_opt_train", "own_")
    return made.select("best", "method", "paired_on", "n_pairs_runs", "wins", "ties", "losses", *[F.round(c, d).alias(c) for c, d in (("mean_delta", 5), ("winrate_half_ties", 9), ("sign_test_pvalue", 5))])


@query(
    "f1_distribution",
    f"{_PAIR_ROWS} SELECT method, pair_id, round(max(f1_opt_train), 2) AS f1 FROM pm WHERE method IN ('plain', 'own_b', 'late') GROUP BY method, pair_id",
)
def f1_distribution(spark, sf_dir):
    """The best F1 of each method and pair, in a fixed order of methods."""
    one = protocol.first_of_each(score_pairs(spark, sf_dir).select("method", "pair_id", F.col("f1_opt_train").alias("f1")), ["method", "pair_id"], "f1")
    return report.round_numeric(protocol.ordered(one, "method", ["plain", "own_b", "late"], "method", "pair_id"), 2)


@query(
    "classifier_table",
    f"{_PAIR_ROWS} SELECT method AS classifier, "
    + ", ".join(f"round(avg({m}_opt_train), 2) AS mean_{m}, round(stddev_samp({m}_opt_train), 2) AS std_{m}, printf('%.2f +/- %.2f', avg({m}_opt_train), stddev_samp({m}_opt_train)) AS {m}_pm_std" for m in ("f1", "precision", "recall"))
    + ", count(DISTINCT pair_id) AS n_pair_id FROM pm GROUP BY method",
)
def classifier_table(spark, sf_dir):
    pairs = score_pairs(spark, sf_dir).withColumnsRenamed({f"{m}_opt_train": m for m in ("f1", "precision", "recall")})
    s = report.summarize(pairs, ["method"], ["f1", "precision", "recall"])
    out = [F.col("method").alias("classifier")]
    for m in ("f1", "precision", "recall"):
        mean, std = F.col(f"{m}_mean"), F.col(f"{m}_std")
        out += [F.round(mean, 2).alias(f"mean_{m}"), F.round(std, 2).alias(f"std_{m}"), F.format_string("%.2f +/- %.2f", mean, std).alias(f"{m}_pm_std")]
    return s.select(*out, "n_pair_id")


# Reports

_SUM = "round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, round(median(f1), 6) AS f1_median"


@query("summary_by_config", f"SELECT method, count(*) AS n, count(DISTINCT pair_id) AS n_pair_id, {_SUM} FROM ({_M}) GROUP BY method")
def summary_by_config(spark, sf_dir):
    return report.round_numeric(report.summarize(methods(spark, sf_dir), ["method"], ["f1"]), 6)


@query(
    "summary_by_unit",
    f"SELECT event_type AS method, count(*) AS n, count(DISTINCT pair_id) AS n_pair_id, {_SUM.replace('f1)', 'v)')} FROM (SELECT event_type, user_id AS pair_id, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type",
)
def summary_by_unit(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("pair_id"), F.col("value").alias("f1"))
    return report.round_numeric(report.summarize_units(e, ["method"], ["f1"]), 6)


@query(
    "group_breakdown",
    """SELECT grouping, "group", status AS method, round(avg(v), 1) AS mean, round(stddev_samp(v), 1) AS std, round(median(v), 1) AS median, count(*) AS n FROM (
      SELECT 'priority' AS grouping, o_orderpriority AS "group", o_orderstatus AS status, o_totalprice AS v FROM orders
      UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_orderstatus, o_totalprice FROM orders) GROUP BY ALL""",
)
def group_breakdown(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("v"))
    return report.round_numeric(report.breakdown(o, ["priority", "year"], "method", "v"), 1)


def sizes(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.count(F.lit(1)).alias("candidate_pairs"))


_SIZES = "SELECT o_custkey AS pair_id, count(*) AS candidate_pairs FROM orders GROUP BY 1"
_REPS = f"""WITH s AS ({_SIZES}), q AS (SELECT *, row_number() OVER (ORDER BY candidate_pairs, pair_id) AS rn, count(*) OVER () AS n, least(8, (SELECT count(DISTINCT candidate_pairs) FROM s)) AS q FROM s),
b AS (SELECT *, CAST(greatest(0, ceil((rn - 1) * q / greatest(n - 1, 1)) - 1) AS INTEGER) AS size_bin FROM q),
m AS (SELECT b.*, row_number() OVER (PARTITION BY b.size_bin ORDER BY abs(candidate_pairs - md), rn) AS nth, rn = 1 OR rn > n - 3 AS edge
      FROM b JOIN (SELECT size_bin, median(candidate_pairs) AS md FROM b GROUP BY size_bin) USING (size_bin)),
r AS (SELECT *, (nth = 1 OR edge) AND row_number() OVER (PARTITION BY (nth = 1 OR edge) ORDER BY edge DESC, size_bin, candidate_pairs, rn) <= 10 AS is_timed_representative FROM m)"""


@query("representatives", f"{_REPS} SELECT pair_id, candidate_pairs, size_bin, is_timed_representative FROM r")
def representatives(spark, sf_dir):
    return report.representatives(sizes(spark, sf_dir), 8, 3, 10)


_NEAR = f"""{_REPS}, x AS (SELECT pair_id AS p, candidate_pairs AS v FROM r WHERE is_timed_representative),
z AS (SELECT s.pair_id, s.candidate_pairs, x.p AS representative, x.v AS representative_value FROM s CROSS JOIN x
      QUALIFY row_number() OVER (PARTITION BY s.pair_id ORDER BY round(abs(ln(1 + x.v) - ln(1 + s.candidate_pairs)), 12), x.p) = 1)"""


def nearby(spark, sf_dir):
    reps = representatives(spark, sf_dir).where("is_timed_representative")
    return report.nearest(sizes(spark, sf_dir), reps, "candidate_pairs")


@query("nearest_representative", f"{_NEAR} SELECT * FROM z")
def nearest_representative(spark, sf_dir):
    return nearby(spark, sf_dir)


@query("runtime_extrapolation", f"{_NEAR} SELECT pair_id, round((representative_value * 0.5 + 1) * candidate_pairs / greatest(representative_value, 1), 6) AS seconds FROM z")
def runtime_extrapolation(spark, sf_dir):
    n = nearby(spark, sf_dir)
    times = n.select(F.col("representative").alias("pair_id"), (F.col("representative_value") * 0.5 + 1).alias("seconds")).distinct()
    return report.extrapolate(n, times, "candidate_pairs").select("pair_id", r6("seconds").alias("seconds"))


@query(
    "runtime_allocation",
    "SELECT l_returnflag, l_linestatus, count(*) AS rows, round(5620.26 * count(*) / sum(count(*)) OVER (), 6) AS seconds FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def runtime_allocation(spark, sf_dir):
    return report.allocate(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], 5620.26).withColumn("seconds", r6("seconds"))


@query(
    "efficiency_table",
    """WITH m AS (SELECT event_type AS method, avg(value) AS m, count(DISTINCT user_id) AS n FROM events GROUP BY 1), f(method, preliminary_sec, application_sec) AS (VALUES ('click', 100.0::DOUBLE, NULL::DOUBLE), ('view', NULL, 7.5), ('other', 5.0, NULL))
    SELECT method, preliminary_sec, round(coalesce(application_sec, m * 551), 4) AS application_sec, round(coalesce(preliminary_sec, 0) + coalesce(application_sec, m * 551, 0), 4) AS total_sec,
    round((coalesce(preliminary_sec, 0) + coalesce(application_sec, m * 551, 0)) / 3600.0, 4) AS total_hours, coalesce(n, 0) AS n_runtime_pairs FROM m FULL JOIN f USING (method)""",
)
def efficiency_table(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("pair_id"), F.col("value").alias("seconds"))
    rules = spark.createDataFrame([("click", 100.0, None), ("view", None, 7.5), ("other", 5.0, None)], "method string, preliminary_sec double, application_sec double")
    return report.round_numeric(report.efficiency(e, rules, 551), 4)


@query("format_mean_std", f"SELECT method, printf('%.2f ± %.2f', avg(f1), stddev_samp(f1)) AS text FROM ({_M}) GROUP BY method")
def format_mean_std(spark, sf_dir):
    s = report.summarize(methods(spark, sf_dir), ["method"], ["f1"])
    return s.select("method", report.mean_std(F.col("f1_mean"), F.col("f1_std")).alias("text"))


@query(
    "inf_nan_cleanup",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS x FROM lineitem",
)
def inf_nan_cleanup(spark, sf_dir):
    x = F.col("l_tax") / F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(vectors.clean(x)).alias("x"))


@query(
    "round_numeric",
    "SELECT o_orderkey, round(o_totalprice / 7, 2) AS x, round(o_totalprice / 3600.0, 2) AS hours FROM orders",
)
def round_numeric(spark, sf_dir):
    return report.round_numeric(t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("x"), report.hours(F.col("o_totalprice")).alias("hours")), 2)


# Learning

_FEATURES = ["n_chars", "n_words", "n_lines", "symbols", "mean_word"]


def document_features(spark, sf_dir) -> DataFrame:
    d, lab = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    words = F.size(F.split("text", r"\s+")).cast("double")
    made = d.select(
        "doc_id", F.col("source").alias("pair_id"), F.col("n_chars").cast("double"), words.alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"), F.regexp_count("text", F.lit("[^\\w\\s]")).cast("double").alias("symbols"),
        (F.length("text") / words).alias("mean_word"),
    )
    return made.join(lab.select("doc_id", F.col("quality").alias("label")), "doc_id").repartition("doc_id").sortWithinPartitions("doc_id")


def _learned(kind):
    def run(spark, sf_dir):
        rows = document_features(spark, sf_dir)
        test = F.col("doc_id") % 3 == 0
        made = model.train_and_predict(rows.where(~test), rows.where(test), _FEATURES, kind)
        return made.select("doc_id", "label", F.round("score", 4).alias("score"))

    return run


query("rf_score")(_learned("rf"))
query("logreg_score")(_learned("logreg"))


@query("rf_evaluate")
def rf_evaluate(spark, sf_dir):
    rows = document_features(spark, sf_dir)
    test = F.col("doc_id") % 3 == 0
    return report.round_numeric(model.evaluate(rows.where(~test), rows.where(test), _FEATURES, scale=False)[0], 6)


_CONFIGURATIONS = {"all": _FEATURES, "sizes": ["n_chars", "n_words", "n_lines"]}


def learned_folds(spark, sf_dir, seeds=(42,)):
    """Forests of the default size over three folds of the sources, two configurations."""
    rows = materialize(document_features(spark, sf_dir), "rows")
    pairs = rows.select("pair_id").distinct().withColumn("stratum", F.lit("all"))
    return model.evaluate_folds(rows, splits.repeated_splits(pairs, 3), _CONFIGURATIONS, seeds)


_RF_FOLD = ["run_id", "seed", "config", "fold_id", "n_features", "threshold_opt_train", "train_mean_f1_pair_at_threshold", "precision", "recall", "f1", "features"]


@query("rf_folds")
def rf_folds(spark, sf_dir):
    """Fold rows; the seconds, which differ from run to run, stay out of the query's result."""
    return report.round_numeric(learned_folds(spark, sf_dir)[0].select(*_RF_FOLD), 6)


@query("rf_ablation_summary")
def rf_ablation_summary(spark, sf_dir):
    folds, pairs = learned_folds(spark, sf_dir)
    return report.round_numeric(model.summarize_folds(pairs, folds).drop("mean_fit_sec", "mean_train_score_sec", "mean_predict_sec"), 6)


@query("rf_repeated_seeds")
def rf_repeated_seeds(spark, sf_dir):
    return report.round_numeric(model.summarize_seeds(learned_folds(spark, sf_dir, (42, 43))[1]), 6)


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "feature_correlations",
    "SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_LI) for b in _LI[i + 1 :]) + ")",
)
def feature_correlations(spark, sf_dir):
    pairs = [(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1 :]]
    made = t(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return made.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


_MI_BIN = "CAST(least(9, floor(({0} - lo_{0}) / (hi_{0} - lo_{0}) * 10)) AS INTEGER)"


@query(
    "mutual_information",
    "WITH e AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _LI) + " FROM lineitem), f AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_MI_BIN.format(c)} AS bin, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem, e" for c in _LI)
    + """), c AS (SELECT feature, bin, label, count(*)::DOUBLE AS k FROM f GROUP BY ALL),
    j AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, bin) AS nb, sum(k) OVER (PARTITION BY feature, label) AS nl FROM c)
    SELECT feature, round(sum(k / n * ln(k * n / (nb * nl))), 8) AS mi FROM j GROUP BY feature""",
)
def mutual_information(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(*_LI, (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return model.mutual_information(rows, _LI).select("feature", F.round("mi", 8).alias("mi"))


@query("feature_selection")
def feature_selection(spark, sf_dir):
    chosen = model.select_features(document_features(spark, sf_dir), _FEATURES, k=3)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, feature string")


# Sources

_PRS = "SELECT source AS pair_id, ' Col' || (doc_id % 9) || ' ' AS source_column, 'T' || (doc_id % 4) AS target_column, CASE WHEN doc_id % 6 = 0 THEN 'n/a' ELSE CAST((doc_id % 10) AS VARCHAR) END AS similarity FROM documents"


def raw_scores(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.col("source").alias("pair_id"), F.concat(F.lit(" Col"), k % 9, F.lit(" ")).alias("source_column"), F.concat(F.lit("T"), k % 4).alias("target_column"),
        F.when(k % 6 == 0, "n/a").otherwise((k % 10).cast("string")).alias("similarity"),
    )


@query("score_adapter", f"SELECT pair_id, lower(trim(source_column)) AS source_col_norm, lower(trim(target_column)) AS target_col_norm, coalesce(TRY_CAST(similarity AS DOUBLE), 0) AS score FROM ({_PRS})")
def score_adapter(spark, sf_dir):
    return tables.adapt_scores(raw_scores(spark, sf_dir))


@query(
    "score_left_join",
    f"""WITH s AS (SELECT pair_id, lower(trim(source_column)) AS s, lower(trim(target_column)) AS t, max(coalesce(TRY_CAST(similarity AS DOUBLE), 0)) AS score FROM ({_PRS}) GROUP BY ALL)
    SELECT doc_id, coalesce(s.score, 0) AS score FROM documents d LEFT JOIN s ON s.pair_id = d.source AND s.s = 'col' || (d.doc_id % 12) AND s.t = 't' || (d.doc_id % 4)""",
)
def score_left_join(spark, sf_dir):
    k = F.col("doc_id")
    test = t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pair_id"), F.concat(F.lit("col"), k % 12).alias("source_col_norm"), F.concat(F.lit("t"), k % 4).alias("target_col_norm"))
    return tables.left_join_scores(test, tables.adapt_scores(raw_scores(spark, sf_dir))).select("doc_id", "score")


@query(
    "keep_first",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
)
def keep_first(spark, sf_dir):
    return tables.keep_first(t(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("relation_normalize", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Joinable' WHEN 1 THEN 'View-Unionable' WHEN 2 THEN 'Semantically-Joinable' ELSE 'Entity-Matching' END AS relation FROM nation")
def relation_normalize(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, " joinable ").when(k == 1, "View -Unionable").when(k == 2, "SEMANTICALLY-JOINABLE").otherwise("wikidata")
    return t(spark, sf_dir, "nation").select("n_nationkey", catalog.relation_type(raw).alias("relation"))


@query("pair_size_grid", "SELECT pair, n_src_cols, n_tgt_cols, n_src_rows, n_tgt_rows, n_src_cols * n_tgt_cols AS candidate_pairs FROM (SELECT 'customer__supplier' AS pair, 5 AS n_src_cols, 4 AS n_tgt_cols, (SELECT count(*) FROM customer) AS n_src_rows, (SELECT count(*) FROM supplier) AS n_tgt_rows UNION ALL SELECT 'nation__region', 3, 2, (SELECT count(*) FROM nation), (SELECT count(*) FROM region))")
def pair_size_grid(spark, sf_dir):
    out = None
    for a, b in (("customer", "supplier"), ("nation", "region")):
        x, y = t(spark, sf_dir, a), t(spark, sf_dir, b)
        n = x.agg(F.count(F.lit(1)).alias("n_src_rows")).join(F.broadcast(y.agg(F.count(F.lit(1)).alias("n_tgt_rows"))))
        one = n.select(F.lit(f"{a}__{b}").alias("pair"), F.lit(len(x.columns)).alias("n_src_cols"), F.lit(len(y.columns)).alias("n_tgt_cols"), "n_src_rows", "n_tgt_rows", F.lit(len(x.columns) * len(y.columns)).alias("candidate_pairs"))
        out = one if out is None else out.unionByName(one)
    return out
