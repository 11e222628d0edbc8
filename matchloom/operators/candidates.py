"""Candidates of table pairs and their feature families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import encoder as enc
from matchloom.functions import matrices, topology, vectors
from matchloom.functions.syntax import SYNTAX_FEATURES, syntax_features
from matchloom.functions.vectors import CLASSICAL_FEATURES, classical_native, clean

#: The ten selected features, in order; fixed names.
REDUCED_FEATURES = (
    "syn_cosine_bigrams", "syn_jaccard_trigrams", "syn_jaccard_tokens", "syn_jaro_winkler", "cls_euclidean",
    "syn_lcs_ratio", "cls_chebyshev", "syn_len_b", "syn_common_suffix_ratio", "tda_h0_entropy_combined",
)
#: Columns that say what a candidate is; fixed names.
CONTEXT = (
    "pair_id", "dataset", "relation_type", "category", "source_table", "target_table", "source_column", "target_column",
    "source_col_norm", "target_col_norm", "label",
)
#: Source columns of one pair in one task.
PART_COLUMNS = 8
ALL_FEATURES = (*SYNTAX_FEATURES, *CLASSICAL_FEATURES, *matrices.SPECTRAL_FEATURES, *topology.TOPOLOGICAL_FEATURES)


def paper_features(names=ALL_FEATURES) -> list[str]:
    """The 60 of the full configuration: no spectral ones, overlaps or cosine distance."""
    return [n for n in names if n.startswith(("syn_", "cls_", "tda_")) and "overlap" not in n and n != "cls_cosine_dist"]


def configurations() -> dict[str, list[str]]:
    """The eight ablations."""
    full = paper_features()
    family = lambda *p: [n for n in full if n.startswith(p)]
    return {
        "full60": full, "syn": family("syn_"), "cls": family("cls_"), "tda": family("tda_"), "syn_cls": family("syn_", "cls_"),
        "syn_tda": family("syn_", "tda_"), "cls_tda": family("cls_", "tda_"), "reduced": list(REDUCED_FEATURES),
    }


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no context."""
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in number and c not in (*CONTEXT, "fold_id", "score", "feature_build_sec_pair_real")]


def select_paper_columns(df: DataFrame) -> DataFrame:
    """Context and exactly the 60 features, or an error."""
    missing = [c for c in (*CONTEXT, *paper_features()) if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    return df.select(*CONTEXT, *paper_features())


def candidate_pairs(source: DataFrame, target: DataFrame, part_columns: int = PART_COLUMNS) -> DataFrame:
    """Every source column with every target column of the same pair_id: a hash join on it.

    Both sides are (pair_id, column, norm, text, ...). A pair's source columns are dealt to
    parts of about ``part_columns``, and its target columns repeated for each part, so a
    pair with very many columns is met by many tasks. A candidate is few bytes and much
    work, so partitions keep their number and are not merged by their size.
    """
    rename = lambda df, k: df.select("pair_id", *[F.col(c).alias(f"{k}_{c}") for c in df.columns if c != "pair_id"])
    parts = source.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / part_columns).cast("int").alias("parts"))
    left = rename(source, "source").join(parts, "pair_id").withColumn("part", F.pmod(F.xxhash64("source_column"), F.col("parts")).cast("int"))
    right = rename(target, "target").join(parts, "pair_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.drop("parts").repartition(n, "pair_id", "part")
    return dealt(left).join(dealt(right), ["pair_id", "part"]).drop("part")


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """1 where (pair_id, source_col_norm, target_col_norm) is in ``truth``, else 0."""
    one = truth.select("pair_id", F.col("source_col_norm").alias("source_norm"), F.col("target_col_norm").alias("target_norm")).distinct()
    return candidates.join(one.withColumn("label", F.lit(1)), ["pair_id", "source_norm", "target_norm"], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def _matrix_udf(names: tuple[str, ...], f):
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def features(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [f(enc.matrix(x), enc.matrix(y)) for x, y in zip(a, b, strict=True)]
        return enc.to_frame(rows, names)

    return features


def _stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = [m for m in (a, b) if len(m)]
    return np.vstack(both) if both else np.zeros((0, 0))


def with_entity_features(entities: DataFrame, maxdim: int = 2) -> DataFrame:
    """``entities`` (tok) with what their pairs share: ``spc`` (5 statistics) and ``bars`` (the diagram's bars by dimension, end after start)."""

    @F.pandas_udf("spc array<double>, bars array<array<double>>")
    def made(tok: pd.Series) -> pd.DataFrame:
        clouds = [enc.matrix(t) for t in tok]
        spc = [[matrices.spectral(m)[k] for k in matrices.SPECTRAL_STATS] for m in clouds]
        bars = [[x.ravel().tolist() for x in topology.diagram(m, maxdim)] if len(m) else [[]] * (maxdim + 1) for m in clouds]
        return pd.DataFrame({"spc": spc, "bars": bars})

    return entities.withColumn("__e", made("tok")).select(*entities.columns, "__e.*")


def _bars(column) -> list[np.ndarray]:
    return [np.asarray(x, float).reshape(-1, 2) for x in column]


def _topology_udf(maxdim: int):
    @F.pandas_udf(", ".join(f"{n} double" for n in topology.TOPOLOGICAL_FEATURES))
    def features(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [
            topology.topological_pair(enc.matrix(p), enc.matrix(q), maxdim, (_bars(u), _bars(v))) for p, q, u, v in zip(a, b, x, y, strict=True)
        ]
        return enc.to_frame(rows, topology.TOPOLOGICAL_FEATURES)

    return features


def with_features(candidates: DataFrame, names: list[str], maxdim: int = 2) -> DataFrame:
    """``candidates`` (source_text, target_text, source_vec, target_vec, source_tok, target_tok) with features.

    A family costs only if it is asked for: strings and matrices are Arrow calls of
    their own, vectors native. What one entity alone decides comes from
    ``with_entity_features`` (source_spc, source_bars, ...), which spectral features and
    those of whole diagrams need; of topology, what needs only spanning trees skips the
    rest. Infinities, NaN and nulls become 0.
    """
    out, want = candidates, set(names)
    syn = tuple(n for n in SYNTAX_FEATURES if n in want)
    if syn:
        out = out.withColumn("__syn", syntax_features(F.col("source_text"), F.col("target_text"), syn)).select("*", "__syn.*").drop("__syn")
    cls = [n for n in CLASSICAL_FEATURES if n in want]
    if cls:
        x, y = vectors.doubles(F.col("source_vec")), vectors.doubles(F.col("target_vec"))
        made = classical_native(x, y)
        out = out.withColumns({n: made[n] for n in cls})
    both = enc.has_rows(F.col("source_tok")) & enc.has_rows(F.col("target_tok"))
    spc = want & set(matrices.SPECTRAL_FEATURES)
    if spc:
        own = {f"spc_{k}_{n}": F.when(both, F.get(f"{side}_spc", F.lit(i))) for side, k in (("source", "src"), ("target", "tgt")) for i, n in enumerate(matrices.SPECTRAL_STATS)}
        out = out.withColumns({n: c for n, c in own.items() if n in spc})
        stacked = tuple(f"spc_combined_{n}" for n in matrices.SPECTRAL_STATS)
        if spc & set(stacked):
            empty = dict.fromkeys(matrices.SPECTRAL_STATS, 0.0)
            f = _matrix_udf(stacked, lambda a, b: {f"spc_combined_{k}": v for k, v in (matrices.spectral(np.vstack([a, b])) if len(a) and len(b) else empty).items()})
            out = out.withColumn("__m", f("source_tok", "target_tok")).select("*", "__m.*").drop("__m")
    tda = want & set(topology.TOPOLOGICAL_FEATURES)
    if tda == {"tda_h0_entropy_combined"} or (not tda and "tda_h0_entropy_combined" in want):
        f = _matrix_udf(("tda_h0_entropy_combined",), lambda a, b: {"tda_h0_entropy_combined": topology.h0_entropy_combined(_stacked(a, b))})
        out = out.withColumn("__m", f("source_tok", "target_tok")).select("*", "__m.*").drop("__m")
    elif tda:
        made = _topology_udf(maxdim)("source_tok", "target_tok", "source_bars", "target_bars")
        out = out.withColumn("__m", made).select("*", "__m.*").drop("__m")
    keep = [c for c in out.columns if c not in ALL_FEATURES or c in want]
    return out.select(*keep).withColumns({n: clean(F.col(n).cast("double")) for n in names})
