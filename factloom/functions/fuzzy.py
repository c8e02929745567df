"""Similarity ratios of two strings (0 to 100) as Arrow UDFs, meant for distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, x, y = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not x or not y):
        return 100.0
    s = len(" ".join(sorted(both)))
    gap = s > 0
    la, lb = s + gap + len(x), s + gap + len(y)
    out = 100.0 - 100.0 * (len(x) + len(y) - 2 * common_length(x, y)) / (la + lb)
    if s:
        out = max(out, *(100.0 - 100.0 * (gap + len(z)) / (s + n) for z, n in ((x, la), (y, lb))))
    return out


def _places(short: str, long_: str, cutoff: float) -> set[int]:
    """Starts of the windows that can reach ``cutoff``: with so few characters missing, one piece of ``short`` stands there whole."""
    c, n = cutoff / 100, len(short)
    missing = int(n * (1 - c / (2 - c)))
    size = n // (missing + 1)
    if not size:
        return set(range(1 - n, len(long_)))
    out: set[int] = set()
    for k in range(0, n - size + 1, size):
        at = long_.find(short[k : k + size])
        while at >= 0:
            out.update(range(at - k - missing - 1, at - k + missing + 2))
            at = long_.find(short[k : k + size], at + 1)
    return {s for s in out if -n < s < len(long_)}


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """The best ratio of the shorter string against windows of the longer one, the cut-off ones at its ends included; 0 if it is below ``cutoff``."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n, best = len(short), 0.0
    for start in sorted(_places(short, long_, cutoff)) if cutoff else range(1 - n, len(long_)):
        best = max(best, ratio(short, long_[max(0, start) : start + n]))
        if best == 100.0:
            break
    return best if best >= cutoff else 0.0


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


set_ratio, sort_ratio = _udf(token_set_ratio), _udf(token_sort_ratio)


def best_partial(cutoff: float):
    """``partial_ratio`` as a UDF, 0 below ``cutoff``."""
    return _udf(lambda a, b: partial_ratio(a, b, cutoff))
