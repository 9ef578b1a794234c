"""Exact order statistics of a column in a few counting passes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096     # rows the driver receives per pass


def _values_at(df: DataFrame, x: Column, ranks: Sequence[int], low: float, high: float) -> list[float]:
    """The values of those ranks (from 0). Each pass counts the values of equal bins of every range that holds
    some rank and goes on with the range of the values in its bin; ranks in one range share its bins."""
    held = [(low, high, 0) for _ in ranks]      # per rank: its range, and how many values lie below that
    while open_ranges := sorted({(a, b) for a, b, _ in held if a < b}):
        bin_of = [F.when((x >= a) & (x <= b), F.struct(
            F.lit(i).alias("range"), F.least(F.floor((x - a) / F.lit((b - a) / BINS)), F.lit(BINS - 1)).alias("bin")))
            for i, (a, b) in enumerate(open_ranges)]
        placed = df.select(x.alias("x"), F.inline(F.array_compact(F.array(*bin_of))))
        bins = placed.groupBy("range", "bin").agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("range", "bin").collect()
        for k, (a, b, below) in enumerate(held):
            for row in (r for r in bins if a < b and r.range == open_ranges.index((a, b))):
                if below + row.n > ranks[k]:
                    held[k] = row.low, row.high, below
                    break
                below += row.n
    return [a for a, _, _ in held]


def exact_quantiles(df: DataFrame, column: str | Column, shares: Sequence[float]) -> list[float | None]:
    """The quantiles with linear interpolation between neighbours, as numpy's and SQL's ``quantile_cont``;
    null without values. Nulls and NaN are left out. Persist ``df`` if it is costly: each pass reads it, and
    there are as many passes for several shares as for one."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    df = df.select(x.alias("x")).filter("x is not null and not isnan(x)")
    x = F.col("x")
    n, low, high = df.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * share for share in shares]
    values = _values_at(df, x, [math.floor(at) for at in places], low, high)
    after = df.agg(*[F.count_if(x <= v) for v in values], *[F.min(F.when(x > v, x)) for v in values]).first()
    found = []
    for k, (at, value) in enumerate(zip(places, values, strict=True)):
        whole = at == math.floor(at) or after[k] > math.floor(at) + 1
        found.append(value if whole else value + (at - math.floor(at)) * (after[len(values) + k] - value))
    return found


def exact_quantile(df: DataFrame, column: str | Column, share: float) -> float | None:
    """One of ``exact_quantiles``."""
    return exact_quantiles(df, column, [share])[0]
