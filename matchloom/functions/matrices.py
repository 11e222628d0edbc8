"""Spectral statistics of token matrices (``spc_*``), NumPy inside grouped Arrow calls.

One singular value decomposition serves all statistics of a matrix; statistics of the
two sides are made once for each entity, before pairs are formed
(``candidates.with_entity_features``), and only those of both stacked for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed names and order.
SPECTRAL_STATS = ("alpha_req", "ne_sum", "rank_me", "stable_rank", "self_cluster")
SPECTRAL_FEATURES = tuple(f"spc_{side}_{s}" for side in ("src", "tgt", "combined") for s in SPECTRAL_STATS)


def spectral(m: np.ndarray) -> dict[str, float]:
    """The five statistics of an n x d matrix; degenerate matrices give zeros."""
    if m.ndim != 2 or not m.size:
        return dict.fromkeys(SPECTRAL_STATS, 0.0)
    n, d = m.shape
    s = np.linalg.svd(m.astype(float), compute_uv=False)
    return _statistics(s, lambda: np.linalg.svd(m - m.mean(axis=0), compute_uv=False), n, d)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition: with 1 before each row, all that the statistics need of any number of rows; R of parts stacked is R of all."""
    return np.linalg.qr(rows, mode="r")


def spectral_of_triangle(r: np.ndarray, n: int) -> dict[str, float]:
    """``spectral`` of ``n`` rows from the ``triangle`` of [1, rows]: below its first row is the triangle of the centred rows."""
    d = r.shape[1] - 1
    if not n or d < 1:
        return dict.fromkeys(SPECTRAL_STATS, 0.0)
    s = np.linalg.svd(r[:, 1:], compute_uv=False)
    return _statistics(s, lambda: np.linalg.svd(r[1:, 1:], compute_uv=False), n, d)


def _statistics(s: np.ndarray, centred_values: Callable[[], np.ndarray], n: int, d: int) -> dict[str, float]:
    """From the singular values of the rows and of the centred rows."""
    out = dict.fromkeys(SPECTRAL_STATS, 0.0)
    big = s[s > 1e-10]
    if n >= 2 and d >= 2 and len(big) >= 2:
        x, y = np.log(np.arange(1, len(big) + 1)), np.log(big)
        x = x - x.mean()
        out["alpha_req"] = float(-(x * (y - y.mean())).sum() / (x * x).sum())
    if n >= 2:
        centred = centred_values() ** 2 / (n - 1)
        if centred.size and centred[0] > 1e-10:
            out["ne_sum"] = float(centred.sum() / centred[0])
    if len(big):
        p = big / big.sum()
        out["rank_me"] = float(np.exp(-(p * np.log(p + 1e-12)).sum()))
        out["stable_rank"] = float((s**2).sum() / s[0] ** 2)
    if n >= 2 and d >= 2:
        gram = np.sqrt((s**4).sum())  # the norm of m m', whose size is that of the rows' square
        out["self_cluster"] = float((d * gram - n * (d + n - 1)) / ((d - 1) * (n - 1) * n))
    return out


def spectral_pair(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """15 statistics of two matrices and of both stacked; zeros if either is empty."""
    if not len(a) or not len(b):
        return dict.fromkeys(SPECTRAL_FEATURES, 0.0)
    sides = {"src": a, "tgt": b, "combined": np.vstack([a, b])}
    return {f"spc_{side}_{k}": v for side, m in sides.items() for k, v in spectral(m).items()}


def spectral_pair_of_triangles(a: np.ndarray, n: int, b: np.ndarray, m: int) -> dict[str, float]:
    """``spectral_pair`` from the triangles of [1, rows] of both sides."""
    if not n or not m:
        return dict.fromkeys(SPECTRAL_FEATURES, 0.0)
    sides = {"src": (a, n), "tgt": (b, m), "combined": (triangle(np.vstack([a, b])), n + m)}
    return {f"spc_{side}_{k}": v for side, (r, rows) in sides.items() for k, v in spectral_of_triangle(r, rows).items()}
