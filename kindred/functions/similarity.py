"""String similarity: normalised indel similarity and what is built on it.

``indel_ratio`` of two strings is twice the length of their longest common subsequence
over the sum of their lengths; two empty strings are equal (1).  Token-set ratio is 0 if
either side has no token.  The Arrow functions compare whole batches at
once (see ``bulk``); ``indel_ratio_expr`` is the ratio as an expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from .bulk import common_of, partials, ratios


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratios([_sorted(x) for x in a], [_sorted(y) for y in b])


def set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best of three ratios: the common tokens, and these with either side's own, against each other."""
    left, right, floor = [], [], np.zeros(len(a))
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        both = " ".join(sorted(x & y))
        one, two = (f"{both} {' '.join(sorted(own))}".strip() for own in (x - y, y - x))
        if not x or not y:
            one, two = "a", "b"
        elif both:  # the common tokens begin the longer strings, and so are their subsequence
            floor[i] = max(2 * len(both) / (len(both) + len(z)) for z in (one, two))
        left.append(one)
        right.append(two)
    return np.maximum(floor, ratios(left, right))


def best_both(xs: list[list[str]], ys: list[list[str]]) -> tuple[list[list[float]], list[list[float]]]:
    """For each string of each list, its best ratio to a string of the other list (0 if that is empty); both ways."""
    number: dict[str, int] = {}
    own = [[np.array([number.setdefault(t, len(number)) for t in ts], dtype=np.int64) for ts in side] for side in (xs, ys)]
    left = [np.repeat(a, len(b)) for a, b in zip(*own, strict=True)]
    right = [np.tile(b, len(a)) for a, b in zip(*own, strict=True)]
    strings = list(number)
    a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    size = np.array([len(s) for s in strings], dtype=np.int64)
    got = 2 * common_of(strings, a, b) / np.maximum(size[a] + size[b], 1) if len(a) else np.zeros(0)
    one, two, at = [], [], 0
    for x, y in zip(xs, ys, strict=True):
        n = len(x) * len(y)
        table = got[at : at + n].reshape(len(x), len(y))
        one.append(table.max(axis=1).tolist() if n else [0.0] * len(x))
        two.append(table.max(axis=0).tolist() if n else [0.0] * len(y))
        at += n
    return one, two


def _strings(s: pd.Series) -> list[str]:
    return s.fillna("").tolist()


def _lists(s: pd.Series) -> list[list[str]]:
    return [[] if x is None else list(x) for x in s]


# The Arrow functions are made when they are used: workers import this module without a session.
def _arrow(f, a: Column | str, b: Column | str) -> Column:
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(_strings(x), _strings(y)), dtype=float)

    return F.pandas_udf(compared, "double")(a, b)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(ratios, a, b)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(sort_ratios, a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    return _arrow(set_ratios, a, b)


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    """The best ratio of the shorter string to a window of its length (or cut off at an end) of the longer."""
    return _arrow(partials, a, b)


def best_matches(a: Column | str, b: Column | str) -> Column:
    """For each string of ``a``, its best ratio to a string of ``b``."""

    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(best_both(_lists(x), _lists(y))[0], dtype=object)

    return F.pandas_udf(best, "array<double>")(a, b)


PAIR_FIELDS = (
    "name_tsr double, name_sort double, name_ratio double, name_partial double, name_skel double, addr_tsr double, addr_sort double,"
    " best1 array<double>, best2 array<double>, num_digitsim double"
)


#: Pairs that are compared together.
SLICE = 4096


def _numbered(columns: tuple[pd.Series, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row stands first, and for every row the number of its like."""
    seen: dict[tuple, int] = {}
    plain = [[x if x is None or isinstance(x, str) else tuple(x) for x in c] for c in columns]
    which = np.array([seen.setdefault(row, len(seen)) for row in zip(*plain, strict=True)], dtype=np.int64)
    return np.unique(which, return_index=True)[1], which


def _pair(*columns: pd.Series) -> pd.DataFrame:
    """The similarities of all rows; rows that are alike are compared once."""
    first, which = _numbered(columns)
    return _compared(*(c.iloc[first] for c in columns)).iloc[which].reset_index(drop=True)


def _compared(
    core1: pd.Series, core2: pd.Series, comp1: pd.Series, comp2: pd.Series, skel1: pd.Series, skel2: pd.Series,
    text1: pd.Series, text2: pd.Series, set1: pd.Series, set2: pd.Series, num1: pd.Series, num2: pd.Series,
) -> pd.DataFrame:
    parts = []
    for at in range(0, len(core1), SLICE):
        cut = slice(at, at + SLICE)
        c1, c2, k1, k2, s1, s2, a1, a2 = (_strings(x.iloc[cut]) for x in (core1, core2, comp1, comp2, skel1, skel2, text1, text2))
        t1, t2, n1, n2 = (_lists(x.iloc[cut]) for x in (set1, set2, num1, num2))
        digits = best_both([x[:6] for x in n1], [x[:6] for x in n2])[0]
        best1, best2 = best_both(t1, t2)
        parts.append(pd.DataFrame({
            "name_tsr": set_ratios(c1, c2), "name_sort": sort_ratios(c1, c2), "name_ratio": ratios(k1, k2), "name_partial": partials(k1, k2),
            "name_skel": set_ratios(s1, s2), "addr_tsr": set_ratios(a1, a2), "addr_sort": sort_ratios(a1, a2),
            "best1": [x if y else [] for x, y in zip(best1, t2, strict=True)], "best2": [x if y else [] for x, y in zip(best2, t1, strict=True)],
            "num_digitsim": [max(x, default=0.0) for x in digits],
        }))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f.split()[0]: [] for f in PAIR_FIELDS.split(",")})


def pair_similarity(*columns: str) -> Column:
    """All string similarities of candidate pairs, in one trip to Python.

    Columns, each for both sides: core, compact, skeletons, address text, token set, numbers.
    """
    # a predicate on what is made of the similarities would have them, and all below them, made again for itself
    return F.pandas_udf(_pair, PAIR_FIELDS, PandasUDFType.SCALAR).asNondeterministic()(*columns)


def indel_ratio_expr(a: Column, b: Column) -> Column:
    """``indel_ratio`` as an expression: one row of the dynamic programme for each character of ``a``."""
    bs = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(before: Column, c: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            hit = F.element_at(before, j) + 1
            miss = F.greatest(F.element_at(before, j + 1), F.element_at(acc, -1))
            return F.concat(acc, F.array(F.when(F.element_at(bs, j) == c, hit).otherwise(miss)))

        return F.when(F.length(b) == 0, before).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)), cell))

    last = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), start, row)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.element_at(last, -1) / total)
