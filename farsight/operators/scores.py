"""Scores of an item from its ranks, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.functions.vectors import safe_divide

Ranks = Column | str


def below(r: Ranks, k: int = 50) -> Column:
    """Share of ranks under k; no ranks give 0."""
    return F.when(F.size(r) > 0, F.size(F.filter(r, lambda x: x < k)) / F.size(r)).otherwise(0.0)


def worst(r: Ranks) -> Column:
    return F.array_max(r).cast("double")


def mean(r: Ranks) -> Column:
    return F.try_divide(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), F.size(r))


def percentile(r: Ranks, p: float = 0.9) -> Column:
    """Percentile with linear interpolation."""
    s = F.array_sort(r)
    at = (F.size(r) - 1) * F.lit(p)
    lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def minmax_combo(r: Ranks, alpha: float = 0.7) -> Column:
    return alpha * worst(r) + (1 - alpha) * mean(r)


def log_count(r: Ranks) -> Column:
    return F.try_divide(F.lit(1.0), F.log(F.size(r) + F.lit(1)))


def inverse_power(r: Ranks, power: float = 0.5) -> Column:
    return 1.0 / F.pow(F.size(r) + F.lit(1), F.lit(power))


def below_legacy(r: Ranks, k: int = 1000) -> Column:
    return below(r, k)


def in_top(r: Ranks, k: int = 50, use_min: bool = False) -> Column:
    """Least rank / k if the first rank (with use_min the least) is at most k, else 1."""
    tested = F.array_min(r) if use_min else F.get(r, F.lit(0))
    return F.when((F.size(r) > 0) & (tested <= k), F.array_min(r) / F.lit(k)).otherwise(1.0)


REGISTRY: dict[str, Callable[..., Column]] = {
    "ratio_unrelevant_below_k": below, "worst_rank": worst, "mean_rank": mean, "percentile_rank": percentile, "minmax_combo": minmax_combo,
    "dev_log_num_tags": log_count, "dev_num_tags_inverse_power": inverse_power, "portion_below_k": below_legacy, "exists_in_top_k": in_top,
}


def combined(r: Ranks, names: list[str], weights: list[float]) -> Column:
    """Weighted sum of named scores."""
    if len(names) != len(weights):
        raise ValueError("as many weights as scores are needed")
    return sum((w * score(n)(r) for n, w in zip(names, weights, strict=True)), F.lit(0.0))


REGISTRY["combined"] = combined


def score(name: str) -> Callable[..., Column]:
    """Score by name, in any case."""
    key = name.strip().lower()
    if key not in REGISTRY:
        raise ValueError(f"unknown score {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[key]


def legacy_ranks(ranks: Column) -> Column:
    """Ranks of a tag -> rank map as numbers, others dropped; none left is an error."""
    r = F.filter(F.transform(F.map_values(ranks), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return F.when(F.size(r) > 0, r).otherwise(F.raise_error(F.lit("no ranks")).cast("array<int>"))


def order_ranks(n: int) -> Column:
    """Ranks of the export form for one order, as numbers; what is none is dropped."""
    return F.filter(F.transform(f"rank_among_unrelevant_tags_{n}", lambda x: x.cast("string").try_cast("int")), lambda x: x.isNotNull())


def normalised(df: DataFrame, column: str, method: str) -> Column:
    """Column by none, max, zscore or minmax over df; one row of aggregates is read."""
    if method == "none":
        return F.col(column).cast("double")
    mean_, sd, lo, hi = df.agg(F.avg(column), F.stddev_pop(column), F.min(column), F.max(column)).first()
    if mean_ is None:
        return F.col(column).cast("double")
    if method == "max":
        return F.col(column) / F.lit(float(hi)) if hi > 0 else F.col(column).cast("double")
    if method == "zscore":
        return (F.col(column) - F.lit(float(mean_))) / F.lit(float(sd) if sd > 1e-12 else 1.0)
    if method == "minmax":
        return (F.col(column) - F.lit(float(lo))) / F.lit(float(hi - lo)) if hi - lo > 1e-12 else F.lit(0.0)
    raise ValueError(f"unknown method {method!r}")


def high_low(scored: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """Share of high scores (over the threshold) per group; null if a group has no low ones."""
    g = scored.groupBy(*by).agg(F.count_if(F.col("score") > threshold).alias("high"), F.count_if(F.col("score") <= threshold).alias("low"))
    return g.withColumn("ratio", F.when(F.col("low") > 0, safe_divide(F.col("high"), F.col("high") + F.col("low"))))


def on_grid(results: DataFrame, **values: list) -> DataFrame:
    """Results for every combination of the given values, null where there are none."""
    from itertools import product

    names = list(values)
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in product(*values.values())))
    grid = results.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    return grid.join(results, names, "left")
