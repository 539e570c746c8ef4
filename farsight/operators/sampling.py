"""Samples over score histograms, extremes and exact splits, all in an order by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.functions.order import ordered, placed
from farsight.operators.quantiles import quantiles
from farsight.operators.stats import bucket, score_range

MODES = ("count", "average", "percentage", "equal", "equal_tails")


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def _checked(df: DataFrame, y: str) -> None:
    if df.filter(F.col(y).isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).limit(1).count():
        raise ValueError(f"{y} must be finite")


def _first(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """The first n rows in an order by hash; n may be a share of all rows."""
    ranked = placed(df.withColumn("__h", shuffled(key, seed)).withColumn("__all", F.lit(0)), "__h", key, ["__all"])
    return ranked.filter(F.col("__r") <= n).select(*df.columns)


def by_histogram(df: DataFrame, y: str, key: str, bins: int, mode: str = "average", amount: float = 1.0, seed: int = 42) -> DataFrame:
    """A sample over equal bins of y (P5 to P10).

    count: at most `amount` of each bin. average: at most the mean of the non-empty bins, rounded up. percentage: at most
    that share of the fullest bin. equal: all of the first `amount` bins and as many of the rest. equal_tails: as many
    of the first as of the last `amount` bins; tails that overlap repeat rows."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "percentage" and not 0 < amount <= 1:
        raise ValueError("a percentage lies over 0 and up to 1")
    _checked(df, y)
    if mode.startswith("equal") and not 1 <= int(amount) < bins:
        raise ValueError("equal samples need at least one pivot bin and fewer than all")
    lo, hi = score_range(df, y)
    binned = df.withColumn("bin", bucket(y, lo, hi, bins))
    sizes = [r["count"] for r in binned.groupBy("bin").count().collect()]
    if mode == "equal":
        low = binned.filter(F.col("bin") < int(amount))
        return low.unionByName(_first(binned.filter(F.col("bin") >= int(amount)), low.count(), key, seed))
    if mode == "equal_tails":
        low, high = binned.filter(F.col("bin") < int(amount)), binned.filter(F.col("bin") >= bins - int(amount))
        k = min(low.count(), high.count())
        return _first(low, k, key, seed).unionByName(_first(high, k, key, seed))
    cap = int(amount) if mode == "count" else math.ceil(sum(sizes) / max(len(sizes), 1)) if mode == "average" else math.ceil(amount * max(sizes, default=0))
    if cap < 1 and sizes:
        raise ValueError("the cap leaves nothing")
    ranked = placed(binned.withColumn("__h", shuffled(key, seed)), "__h", key, ["bin"])
    return ranked.filter(F.col("__r") <= cap).drop("__r", "__h")


def extremes(df: DataFrame, y: str, key: str, share: float, k: int, seed: int = 42) -> DataFrame:
    """At most k rows from each end: y up to the quantile of share, and from that of 1 - share."""
    if not 0 < share < 0.5:
        raise ValueError("the share lies between 0 and 0.5")
    lo, hi = quantiles(df, y, [share, 1 - share]) or (None, None)
    low = _first(df.filter(F.col(y) <= F.lit(lo)), k, key, seed).withColumn("side", F.lit("low"))
    return low.unionByName(_first(df.filter(F.col(y) >= F.lit(hi)), k, key, seed).withColumn("side", F.lit("high")))


def split_sizes(n: int, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> tuple[int, int, int]:
    """Rows of train, validation and test part; shares are rounded up in floating point."""
    t = math.ceil(test * n)
    v = math.ceil(val / (train + val) * (n - t))
    return n - t - v, v, t


def split(df: DataFrame, key: str, seed: int = 42, strata: str | None = None) -> DataFrame:
    """df with `part`: exact shares of 70, 15 and 15 percent, of each stratum if given.

    Places in the order by hash come from counts per hash prefix, so that no task orders all rows."""
    group = strata or "__all"
    rows = df.withColumn("__h", shuffled(key, seed))
    rows = rows if strata else rows.withColumn("__all", F.lit(0))
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    ranked = placed(rows, "__h", key, [group]).join(sizes, F.expr(f"`{group}` <=> __g"))
    test = F.ceil(F.lit(0.15) * F.col("__n"))
    val = F.ceil(F.lit(0.15 / (0.7 + 0.15)) * (F.col("__n") - test))
    part = F.when(F.col("__r") <= test, "test").when(F.col("__r") <= test + val, "val").otherwise("train")
    return ranked.withColumn("part", part).select(*df.columns, "part")


def range_splits(df: DataFrame, order: str, size: int, drop_tail: bool = False) -> DataFrame:
    """df with `split`: the number of its run of `size` rows in order (K5)."""
    idx = ordered(df, order).select(F.col("node").alias(order), F.floor(F.col("idx") / size).alias("split"))
    out = df.join(idx, order)
    return out.filter(F.col("split") < df.count() // size) if drop_tail else out


def shards(df: DataFrame, order: str, workers: int) -> DataFrame:
    """df with `shard`: contiguous runs of which the first n % workers have one row more (K6)."""
    n = df.count()
    small, big = n // workers, n % workers
    idx = ordered(df, order)
    cut = big * (small + 1)
    shard = F.when(F.col("idx") < cut, F.floor(F.col("idx") / (small + 1))).otherwise(big + F.floor((F.col("idx") - cut) / max(small, 1)))
    return df.join(idx.select(F.col("node").alias(order), shard.cast("int").alias("shard")), order)
