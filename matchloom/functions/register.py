"""The string and vector features as SQL functions of a session: ``SELECT syn_jaro(a, b), cls_euclidean(x, y)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchloom.functions.syntax import SYNTAX_FEATURES, features_of

#: Of two arrays of numbers of the same length.
VECTOR_RULES = {
    "cls_euclidean": lambda x, y: np.sqrt(((x - y) ** 2).sum()),
    "cls_chebyshev": lambda x, y: np.abs(x - y).max(),
    "cls_minkowski": lambda x, y: (np.abs(x - y) ** 3).sum() ** (1 / 3),
    "cls_cosine_sim": lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y)) if x.any() and y.any() else 0.0,
    "cls_canberra": lambda x, y: (np.abs(x - y) / np.where(np.abs(x) + np.abs(y) > 0, np.abs(x) + np.abs(y), 1)).sum(),
}


def _text(name: str):
    @F.pandas_udf("double")
    def feature(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([features_of(x, y, (name,))[name] for x, y in zip(a, b, strict=True)], dtype=float)

    return feature


def _vector(rule):
    @F.pandas_udf("double")
    def feature(a: pd.Series, b: pd.Series) -> pd.Series:
        made = [None if x is None or y is None or not len(x) else float(rule(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b, strict=True)]
        return pd.Series(made, dtype=float)

    return feature


def register(spark: SparkSession) -> list[str]:
    """Register all of them; the names."""
    made = {n: _text(n) for n in SYNTAX_FEATURES} | {n: _vector(r) for n, r in VECTOR_RULES.items()}
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)
