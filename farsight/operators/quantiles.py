"""Exact order statistics by distributed selection.

A wanted rank is found by narrowing: approximate quantiles of what is left, a summary of fixed size, give bounds; rows are counted at each bound and between neighbours; only
the gap that holds the rank stays. No aggregate's state grows with the number of different values, no task orders the rows, and far outliers or
values that nearly all rows share don't matter, as bounds follow ranks and a bound's own rows are counted apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.functions.order import range_of

#: Bounds of a round, accuracy of the summary that gives them, and rows of a gap whose values are read instead of narrowed.
BOUNDS, ACCURACY, READ = 64, 1000, 2000


def _between(value: Column, low, high) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value > F.lit(low))
    return inside if high is None else inside & (value < F.lit(high))


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, object]:
    """The values at places from 0 in the order of a column without nulls. Values of any type with an order, whose summary Spark has: numbers, dates and times."""
    rows = df.select(F.col(column).alias("v"))
    found: dict[int, object] = {}
    gaps: dict[tuple, list[int]] = {(None, None, 0): sorted(set(ranks))}  # (low, high, rows up to low): the ranks that lie strictly between low and high
    while gaps:
        keys = list(gaps)
        which = F.coalesce(*(F.when(_between(F.col("v"), low, high), F.lit(i)) for i, (low, high, _) in enumerate(keys)), F.lit(-1))
        left = rows.withColumn("g", which).filter("g >= 0")
        shares = [(i + 1) / (BOUNDS + 1) for i in range(BOUNDS)]
        summary = left.groupBy("g").agg(F.percentile_approx("v", shares, ACCURACY).alias("b")).collect()
        bounds = {r["g"]: sorted(set(r["b"])) for r in summary}
        # 2 i + 1 at bound i, 2 i below it and above the one before
        place = lambda b: 2 * range_of(F.col("v"), b) - F.when(F.array_contains(F.lit(b), F.col("v")), 1).otherwise(0)
        code = F.coalesce(*(F.when(F.col("g") == g, place(b)) for g, b in bounds.items()))
        sizes: dict[int, dict[int, int]] = {g: {} for g in bounds}
        for r in left.groupBy("g", code.alias("p")).count().collect():  # 2 BOUNDS + 1 rows a gap at most
            sizes[r["g"]][r["p"]] = r["count"]
        narrowed: dict[tuple, list[int]] = {}
        small: list[tuple] = []
        for i, (low, high, before) in enumerate(keys):
            b, done = bounds[i], before
            for p in range(2 * len(b) + 1):
                n = sizes[i].get(p, 0)
                own = [r for r in gaps[keys[i]] if done <= r < done + n]
                if own and p % 2:
                    found.update(dict.fromkeys(own, b[p // 2]))
                elif own:
                    gap = (b[p // 2 - 1] if p else low, b[p // 2] if p < 2 * len(b) else high, done)
                    if n <= READ:
                        small.append((gap, own))
                    else:
                        narrowed[gap] = own
                done += n
        for gap, own in small:
            values = sorted(r["v"] for r in rows.filter(_between(F.col("v"), gap[0], gap[1])).collect())  # READ at most
            found.update({r: values[r - gap[2]] for r in own})
        gaps = narrowed
    return found


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours; nulls don't count. Nothing at all gives an empty list."""
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    ranks = {k for p in places for k in (math.floor(p), math.ceil(p))}
    value = at_ranks(rows, "v", sorted(ranks))
    out = []
    for p in places:
        low, high = value[math.floor(p)], value[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
