"""Exact order statistics of several columns by brackets (linear interpolation, like pandas).

Values are never shuffled or sorted as a whole.  ``order_statistics`` narrows, for every wanted rank, an
open interval that holds it:

1. one aggregate makes a bounded quantile sketch per column; two of its values bracket each rank;
2. one aggregate counts exactly what lies below and at those values.  A rank that falls on one of them
   is found; one that the sketch missed keeps the side on which it lies, so the result never depends
   on the sketch's error;
3. where more than ``held`` values lie inside, both steps repeat within the interval;
4. one filter fetches what lies inside the last intervals: at most ``held`` values altogether.

Ties cost nothing: a value that holds a third of all rows is an end of an interval, not its content.
``method="approx"`` uses ``percentile_approx`` alone.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
GRID = 256
HELD = 200_000


def _number(c: str) -> Column:
    """The column as double; NaN counts as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _sketch(x: Column) -> Column:
    grid = F.expr(f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})")
    return F.percentile_approx(x, grid, ACCURACY)


def _inside(x: Column, low: float | None, high: float | None) -> Column:
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (x > F.lit(low))
    if high is not None:
        ok = ok & (x < F.lit(high))
    return ok


def _row(df: DataFrame, exprs: Sequence[Column]) -> list:
    """The values of one aggregate row."""
    return list(df.agg(*[e.alias(f"a{i}") for i, e in enumerate(exprs)]).first())


class _Rank:
    """A wanted rank and the open interval (low, high) that holds it; None: no bound yet."""

    def __init__(self, col: str, rank: int, n: int):
        self.col, self.rank, self.low, self.high = col, rank, None, None
        self.below, self.until = 0, n  # values up to low; values under high
        self.value: float | None = None

    def learn(self, v: float, under: int, upto: int) -> None:
        """``under`` values are less than ``v``, ``upto`` are not greater."""
        if self.value is not None or (self.low is not None and v <= self.low) or (self.high is not None and v >= self.high):
            return
        if self.rank < under:
            self.high, self.until = v, under
        elif self.rank < upto:
            self.value = v
        else:
            self.low, self.below = v, upto

    @property
    def key(self) -> tuple:
        return self.col, self.low, self.high

    @property
    def size(self) -> int:
        return self.until - self.below


def brackets(df: DataFrame, keys: Sequence[tuple]) -> DataFrame:
    """``at, v``: the values strictly inside each ``(col, low, high)``; a filter without any shuffle."""
    within = [_inside(_number(c), low, high) for c, low, high in keys]
    cells = [F.when(ok, F.struct(F.lit(i).alias("at"), _number(c).alias("v"))) for i, ((c, _, _), ok) in enumerate(zip(keys, within))]
    rows = df.where(functools.reduce(operator.or_, within))  # few rows, before any array is made
    return rows.select(F.explode(F.array_compact(F.array(*cells))).alias("kv")).select("kv.at", "kv.v")


def order_statistics(df: DataFrame, wanted: Mapping[str, Callable[[int, int], Iterable[int]]],
                     held: int = HELD) -> dict[str, tuple[int, int, dict[int, float]]]:
    """``{col: (n, missing, {rank: value})}`` for the ranks (from 0) that ``wanted[col](n, missing)`` names.

    ``n`` counts a column's values, ``missing`` its nulls and NaNs.  ``df`` is scanned three times, and twice more for each
    factor of about ``GRID`` by which the values exceed ``held``; persist it if it is dear to compute.
    """
    cols = list(wanted)
    if not cols:
        return {}
    said = _row(df, [F.count(F.lit(1)), *[e for c in cols for e in (F.count(_number(c)), _sketch(_number(c)))]])
    total, counts = said[0], {c: said[1 + 2 * i] for i, c in enumerate(cols)}
    sketches = {(c, None, None): said[2 + 2 * i] for i, c in enumerate(cols)}
    ranks = [_Rank(c, r, counts[c]) for c in cols for r in sorted(set(wanted[c](counts[c], total - counts[c]))) if 0 <= r < counts[c]]

    while True:
        # the two values of the sketch around each rank, with room for its error
        asked: dict[tuple[str, float], None] = {}
        for t in (t for t in ranks if t.value is None and t.key in sketches):
            grid, place, slack = sketches[t.key], (t.rank - t.below) / max(1, t.size), 2 / ACCURACY
            for at in (math.floor((place - slack) * GRID), math.ceil((place + slack) * GRID)):
                asked[t.col, grid[min(max(at, 0), GRID)]] = None
        points = list(asked)
        if points:
            exact = _row(df, [e for c, v in points for e in (F.count(F.when(_number(c) < F.lit(v), 1)), F.count(F.when(_number(c) <= F.lit(v), 1)))])
            for i, (c, v) in enumerate(points):
                for t in ranks:
                    if t.col == c:
                        t.learn(v, exact[2 * i], exact[2 * i + 1])
        left = {t.key: t.size for t in ranks if t.value is None}
        share = held // max(1, len(left))
        wide = [k for k, size in left.items() if size > share]
        if not wide:
            break
        sketches = dict(zip(wide, _row(df, [_sketch(F.when(_inside(_number(c), low, high), _number(c))) for c, low, high in wide])))

    if left:
        keys = list(left)
        rows = brackets(df, keys).toArrow()  # at most `held` values
        at, values = rows["at"].to_numpy(), rows["v"].to_numpy()
        for i, key in enumerate(keys):
            inside = sorted(values[at == i].tolist())
            for t in ranks:
                if t.value is None and t.key == key:
                    t.value = inside[t.rank - t.below]
    out = {c: (counts[c], total - counts[c], {}) for c in cols}
    for t in ranks:
        out[t.col][2][t.rank] = t.value
    return out


def _places(n: int, p: float) -> tuple[float, int, int]:
    h = (n - 1) * p
    return h, math.floor(h), math.ceil(h)


def _between(a: float, b: float, part: float) -> float:
    return a if part == 0 or a == b else a + (b - a) * part


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact",
              accuracy: int = 100_000) -> dict[str, list[float | None]]:
    """``{col: [q(p) for p in probs]}``; a column without values gives ``None``s."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    if method == "approx":
        row = _row(df, [F.percentile_approx(_number(c), probs, accuracy) for c in cols])
        return {c: (list(v) if v is not None else [None] * len(probs)) for c, v in zip(cols, row)}
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")

    found = order_statistics(df, {c: lambda n, _: [r for p in probs for r in _places(n, p)[1:]] for c in cols})
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n, _, at = found[c]
        places = [_places(n, p) for p in probs]
        out[c] = [_between(at[lo], at[hi], h - lo) if n else None for h, lo, hi in places]
    return out


def filled_quartiles(df: DataFrame, cols: Sequence[str], method: str = "exact") -> dict[str, list[float | None]]:
    """``{col: [median, q25, q50, q75]}``: the median, and the quartiles after missing values were filled with it.

    Both come from one search: the filled column in order is the values up to the median, one median for
    each missing value, and the values above."""
    cols = list(cols)
    if method != "exact":
        medians = {c: v[0] for c, v in quantiles(df, cols, [0.5], method).items()}
        filled = df.select(*[F.coalesce(_number(c), F.lit(m)).alias(c) for c, m in medians.items() if m is not None])
        return {c: [m, *quantiles(filled, [c], [0.25, 0.5, 0.75], method)[c]] if m is not None else [None] * 4 for c, m in medians.items()}

    def own(n: int, missing: int, r: int) -> int | None:
        """Rank among the values of rank ``r`` of the filled column; None: the median itself."""
        middle = _places(n, 0.5)[1]
        return r if r <= middle else None if r <= middle + missing else r - missing

    def wanted(n: int, missing: int) -> list[int]:
        if not n:
            return []
        ranks = [own(n, missing, r) for p in (0.25, 0.5, 0.75) for r in _places(n + missing, p)[1:]]
        return [*_places(n, 0.5)[1:], *(r for r in ranks if r is not None)]

    out: dict[str, list[float | None]] = {}
    for c, (n, missing, at) in order_statistics(df, {c: wanted for c in cols}).items():
        if not n:
            out[c] = [None] * 4
            continue
        h, lo, hi = _places(n, 0.5)
        median = _between(at[lo], at[hi], h - lo)
        got = [median]
        for p in (0.25, 0.5, 0.75):
            h, lo, hi = _places(n + missing, p)
            a, b = (median if own(n, missing, r) is None else at[own(n, missing, r)] for r in (lo, hi))
            got.append(_between(a, b, h - lo))
        out[c] = got
    return out
