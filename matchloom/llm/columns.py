"""Rows kept as one struct, so that no private column can clash with theirs, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def own(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def wrapped(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one column ``row``, and the columns ``more`` computed from it; ``select("row.*")`` gives it back."""
    return df.select(F.struct(*own(df)).alias(ROW), *[c.alias(k) for k, c in more.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
