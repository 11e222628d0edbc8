"""Vector distances: the eight ``cls_*`` features, as native array expressions.

Constant vectors have no correlation (0); a zero vector has no cosine (null, which the
table builder's clean-up turns into 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names and order.
CLASSICAL_FEATURES = (
    "cls_euclidean", "cls_cosine_dist", "cls_cosine_sim", "cls_pearson", "cls_spearman", "cls_minkowski", "cls_canberra", "cls_chebyshev",
)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def _pairs(x: Column, y: Column, f) -> Column:
    return F.zip_with(x, y, f)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total(_pairs(x, y, lambda a, b: (a - b) * (a - b))))


def cosine_sim(x: Column, y: Column, epsilon: float = 0.0) -> Column:
    """``epsilon`` > 0 is added to the denominator: a zero vector then has similarity 0."""
    norm = F.sqrt(total(_pairs(x, x, lambda a, b: a * b))) * F.sqrt(total(_pairs(y, y, lambda a, b: a * b))) + epsilon
    return F.when(norm > 0, total(_pairs(x, y, lambda a, b: a * b)) / norm)


def minkowski(x: Column, y: Column, p: float = 3.0) -> Column:
    return F.pow(total(_pairs(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))), F.lit(1 / p))


def canberra(x: Column, y: Column) -> Column:
    size = lambda a, b: F.abs(a) + F.abs(b)
    return total(_pairs(x, y, lambda a, b: F.when(size(a, b) > 0, F.abs(a - b) / size(a, b)).otherwise(F.lit(0.0))))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(_pairs(x, y, lambda a, b: F.abs(a - b)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pearson(x: Column, y: Column) -> Column:
    def of(mx: Column, my: Column) -> Column:
        xy = total(_pairs(x, y, lambda a, b: (a - mx) * (b - my)))
        xx = total(F.transform(x, lambda a: (a - mx) * (a - mx)))
        yy = total(F.transform(y, lambda b: (b - my) * (b - my)))
        sums = F.struct(xy.alias("xy"), xx.alias("xx"), yy.alias("yy"))
        return let(sums, lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(F.lit(0.0)))

    return let(total(x) / F.size(x), lambda mx: let(total(y) / F.size(y), lambda my: of(mx, my)))


def average_ranks(x: Column) -> Column:
    """Ranks from 1, ties share the mean of theirs."""
    below = lambda v: F.size(F.filter(x, lambda w: w < v))
    same = lambda v: F.size(F.filter(x, lambda w: w == v))
    return F.transform(x, lambda v: below(v) + (same(v) + 1) / 2.0)


def spearman(x: Column, y: Column) -> Column:
    return let(average_ranks(x), lambda r: let(average_ranks(y), lambda s: pearson(r, s)))


def classical_native(x: Column, y: Column) -> dict[str, Column]:
    """All eight over columns of doubles."""
    cos = cosine_sim(x, y)
    values = (euclidean(x, y), 1 - cos, cos, pearson(x, y), spearman(x, y), minkowski(x, y), canberra(x, y), chebyshev(x, y))
    return dict(zip(CLASSICAL_FEATURES, values, strict=True))


def clean(c: Column) -> Column:
    """Infinities, NaN and null become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
