"""Exact quantiles of several columns from counts per cell, refined around the rank."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of one pass over all columns.
COUNTERS = 1 << 16


@dataclass
class _Search:
    """What is known of a column: the rows below ``low``, and that the wanted ranks lie in [low, high]."""

    low: float
    high: float
    below: int
    position: float


def _octave(x: Column) -> Column:
    """A key that grows with x, about one step per power of two."""
    size = F.log2(F.abs(x)) + 1075.0  # the least double is 2**-1074
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * size)


def _cells(x: Column, search: _Search | None, cells: int) -> Column:
    """The number of x's cell: of equal steps of ``_octave`` first, then of equal parts of [low, high]."""
    if search is None:
        step = F.floor(F.least((_octave(x) + 2100.0) / (4200.0 / (cells - 1)), F.lit(float(cells))))
        return F.when(x == -math.inf, -1).otherwise(step)  # the infinities have cells of their own
    k = 1.0 if math.isfinite(search.high - search.low) else 0.5  # halves where the range exceeds the largest double
    part = (x * k - search.low * k) / (search.high * k - search.low * k) * cells
    return F.floor(F.least(part, F.lit(cells - 1.0)))


def exact_quantiles(df: DataFrame, columns: list[str], p: float = 0.5) -> dict[str, float | None]:
    """The value at position p * (n - 1) of each column's n values in order, interpolated as ``percentile`` does.

    Every pass counts the values of cells, for all columns that are still open together, with partial sums in each
    task, so that at most ``COUNTERS`` counts, minima and maxima are shuffled and read by the driver, however
    many distinct values there are.  The cell that holds the rank is divided in the next pass.  The first pass has a cell
    per power of two or so; each further one adds at least log2(COUNTERS / columns) - 1 of the 52 bits below it, and columns
    of few distinct values end after one or two.

    Defined cases: nulls do not count; a column without values gives None; NaN is above all numbers and is the result
    if the rank meets one; both zeros are one value.
    """
    found: dict[str, float | None] = {}
    open_: dict[str, _Search | None] = dict.fromkeys(columns)
    while open_:
        cells = COUNTERS // len(open_)
        parts = []
        for c, search in open_.items():
            x = F.col(c).cast("double")
            inside = x.isNotNull() if search is None else x.between(search.low, search.high) & ~F.isnan(x)
            cell = F.when(F.isnan(x), cells + 1).otherwise(_cells(x, search, cells))
            parts.append(F.when(inside, F.struct(F.lit(c).alias("name"), cell.cast("long").alias("cell"), x.alias("x"))))
        rows = df.select(F.explode(F.array(*parts)).alias("r")).where("r is not null").groupBy("r.name", "r.cell")
        counts: dict[str, list] = {c: [] for c in open_}
        for r in rows.agg(F.count("*").alias("n"), F.min("r.x").alias("low"), F.max("r.x").alias("high")).collect():
            counts[r["name"]].append((r["cell"], r["n"], r["low"], r["high"]))
        for c in list(open_):
            search, got = open_[c], sorted(counts[c])
            if search is None:
                total = sum(n for _, n, _, _ in got)
                if not total:
                    found[c] = open_.pop(c)
                    continue
                search = _Search(-math.inf, math.inf, 0, p * (total - 1))
            result = _narrowed(search, got)
            if isinstance(result, float):
                found[c] = result
                del open_[c]
            else:
                open_[c] = result
    return {c: found[c] for c in columns}


def _narrowed(search: _Search, cells: list[tuple[int, int, float, float]]) -> _Search | float:
    """The cell that holds both ranks around the position, or the result."""
    first, share = math.floor(search.position), search.position - math.floor(search.position)
    ranks = [first, first + 1] if share else [first]
    below, ends = search.below, []
    for _, n, low, high in cells:
        inside = [r for r in ranks if below <= r < below + n]
        if len(inside) == len(ranks) and low != high and n > 2 and not math.isnan(low):
            return _Search(low, high, below, search.position)
        for r in inside:
            if low == high or math.isnan(low) or r == below + n - 1:
                ends.append(high)
            elif r == below:
                ends.append(low)
            else:
                raise AssertionError("ranks are neighbours")
        below += n
    return float(ends[0]) if len(ends) == 1 else ends[0] * (1 - share) + ends[1] * share
