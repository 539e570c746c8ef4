"""Histograms, regression and class metrics, rank correlation and aggregates over seeds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.functions.order import range_of
from farsight.functions.vectors import safe_divide, score_class
from farsight.operators.quantiles import quantiles

CLASSES = ["low", "medium", "high"]
#: Ranges of values that are ranked each by itself.
RANGES = 256


def score_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Least and largest value; the largest is the least + 1 if they are the same."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    lo, hi = float(lo or 0.0), float(hi or 0.0)
    return lo, lo + 1.0 if hi <= lo + 1e-12 else hi


def bucket(column: str, lo: float, hi: float, bins: int) -> Column:
    """Number of the bin from 0, the last one with its right edge."""
    return F.least(F.width_bucket(F.col(column).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int") - 1


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """(bin, n) for equal bins over the range, empty ones too; with density n / (rows * width)."""
    lo, hi = score_range(df, column)
    counts = df.filter(F.col(column).isNotNull()).groupBy(bucket(column, lo, hi, bins).alias("bin")).count()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))
    if density:
        total = df.filter(F.col(column).isNotNull()).count()
        out = out.withColumn("density", F.col("n") / F.lit(max(total, 1) * (hi - lo) / bins))
    return out


def bin_width(df: DataFrame, column: str, rule: str = "auto") -> tuple[int, float, float, float]:
    """(rows, least, largest, width) by a named rule for the width of equal bins.

    sqrt, sturges, rice, scott, doane, fd, and auto: the narrower of fd and sturges, or sturges where fd has no width."""
    x = F.col(column).cast("double")
    n, lo, hi, sd, skew = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_pop(x), F.skewness(x)).first()
    if not n or hi == lo:
        return n or 0, lo or 0.0, hi or 0.0, 0.0
    span = hi - lo

    def quartiles() -> float:
        q1, q3 = quantiles(df, column, [0.25, 0.75])
        return 2 * (q3 - q1) / n ** (1 / 3)

    def doane() -> float:
        if n < 3:
            return 0.0
        spread = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
        return span / (1 + math.log2(n) + math.log2(1 + abs(skew) / spread))

    rules = {
        "sqrt": lambda: span / math.sqrt(n), "sturges": lambda: span / (math.log2(n) + 1), "rice": lambda: span / (2 * n ** (1 / 3)),
        "scott": lambda: (24 * math.sqrt(math.pi) / n) ** (1 / 3) * sd, "doane": doane, "fd": quartiles,
    }
    if rule not in (*rules, "auto"):
        raise ValueError(f"unknown rule {rule!r}; there are auto, {', '.join(rules)}")
    width = min(w for w in (rules["sturges"](), quartiles()) if w > 0) if rule == "auto" else rules[rule]()
    return n, lo, hi, width


def bin_count(df: DataFrame, column: str, rule: str = "auto") -> int:
    """Number of equal bins over the range by a named rule."""
    _, lo, hi, width = bin_width(df, column, rule)
    return max(1, math.ceil((hi - lo) / width)) if width > 0 else 1


def bin_edges(df: DataFrame, column: str, rule: str = "auto") -> list[float]:
    """Edges of equal bins by a named rule, one more than there are bins; a lone value gets a bin of width 1 from it."""
    lo, hi = score_range(df, column)
    k = bin_count(df, column, rule)
    return [lo + (hi - lo) * i / k for i in range(k)] + [hi]


def quantile_classes(df: DataFrame, column: str, classes: int) -> DataFrame:
    """df with `class` from 0: how many inner quantile edges are at most the value. Ties may leave classes empty."""
    edges = quantiles(df, column, [i / classes for i in range(1, classes)])
    return df.withColumn("class", sum(((F.lit(float(e)) <= F.col(column)).cast("int") for e in edges), F.lit(0)))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and pearson per group (A26 to A28); r2 and pearson are 0 where they have no meaning."""
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    cov = safe_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.var_pop(y) > 0, 1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).otherwise(0.0).alias("r2"),
        F.when(F.count("*") < 2, 0.0).otherwise(cov).alias("pearson"),
    )


def mean_ranks(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, value, rank): the mean rank of equal values within each group, from counts per different value and ranges of values.

    Ranges lie between approximate quantiles over all groups, so that a range holds like numbers of rows whatever the values are."""
    counts = df.groupBy(*by, F.col(column).alias("value")).count()
    bounds = df.agg(F.percentile_approx(F.col(column), [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("b")).first()["b"]
    ranged = counts.withColumn("r", range_of(F.col("value"), sorted(set(bounds or []))))
    before = Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "r").agg(F.sum("count").alias("c")).select(*by, "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("count").over(Window.partitionBy(*by, "r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(starts, [*by, "r"]).select(*by, "value", (F.col("before") + F.col("inside") + (F.col("count") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, y: str = "y", p: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Spearman's correlation, equal values at their mean rank, of all rows or of each group (A29). Group columns must not be null."""
    a, b = (mean_ranks(df, c, by).select(*by, F.col("value").alias(c), F.col("rank").alias(r)) for c, r in ((y, "ra"), (p, "rb")))
    pairs = df.groupBy(*by, y, p).count().join(a, [*by, y]).join(b, [*by, p])
    m = F.sum(F.col("count"))
    mean_a, mean_b = F.sum(F.col("ra") * F.col("count")) / m, F.sum(F.col("rb") * F.col("count")) / m
    cov = F.sum(F.col("ra") * F.col("rb") * F.col("count")) / m - mean_a * mean_b
    va, vb = F.sum(F.col("ra") * F.col("ra") * F.col("count")) / m - mean_a * mean_a, F.sum(F.col("rb") * F.col("rb") * F.col("count")) / m - mean_b * mean_b
    return pairs.groupBy(*by).agg(safe_divide(cov, F.sqrt(va * vb)).alias("spearman"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", classes: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, truth, pred, n) for all pairs of the classes, of each group (A30). Group columns must not be null."""
    classes = classes or CLASSES
    cells = F.array(*(F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred")) for a in classes for b in classes))
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    grid = groups.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    return grid.join(counts, [*by, "truth", "pred"], "left").select(*by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred", classes: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, class, precision, recall, f1, support) of each class, 0 for 0/0."""
    cells = confusion(df, truth, pred, classes, by)
    rows = cells.groupBy(*by, F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, [*by, "class"]).withColumn("precision", safe_divide(F.col("hit"), F.col("predicted"))).withColumn("recall", safe_divide(F.col("hit"), F.col("support")))
    return out.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "class", "precision", "recall", "f1", "support", "predicted", "hit")


def overall_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred", classes: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro, micro and weighted averages, Matthews correlation and kappa, of all rows or of each group."""
    m = class_metrics(df, truth, pred, classes, by)
    n, hit = F.sum("support"), F.sum("hit")
    rc, c2, r2 = F.sum(F.col("support") * F.col("predicted")), F.sum(F.col("predicted") * F.col("predicted")), F.sum(F.col("support") * F.col("support"))
    averages = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    averages += [safe_divide(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    accuracy, chance = safe_divide(hit, n), safe_divide(rc, n * n)
    return m.groupBy(*by).agg(
        n.alias("n"), accuracy.alias("accuracy"), accuracy.alias("micro_f1"), *averages,
        safe_divide(hit * n - rc, F.sqrt((n * n - c2).cast("double") * (n * n - r2))).alias("mcc"),
        safe_divide(accuracy - chance, 1 - chance).alias("kappa"),
    )


def metric_suite(df: DataFrame, y: str = "y", p: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, metric, value): all regression metrics, and class metrics of the scores by thirds, of all rows or of each group in one pass over the groups."""
    reg = regression_metrics(df, y, p, by).drop("n")
    classed = df.select(*by, score_class(F.col(y)).alias("truth"), score_class(F.col(p)).alias("pred"))
    wide = reg
    for more in (spearman(df, y, p, by), overall_metrics(classed, by=by)):
        wide = wide.join(more, list(by)) if by else wide.join(more)
    names = [c for c in wide.columns if c not in by]
    flat = confusion(classed, by=by).select(*by, F.concat_ws("_", F.lit("cm"), "truth", "pred").alias("metric"), F.col("n").cast("double").alias("value"))
    return wide.select(*by, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(by), names, "metric", "value").unionByName(flat)


def over_seeds(metrics: DataFrame, by: tuple[str, ...] = ("model", "metric")) -> DataFrame:
    """Mean and population deviation of each metric."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def curve_band(curves: DataFrame, epochs: int) -> DataFrame:
    """(config, epoch, mean, least, most) of a loss over seeds; a run that ended early keeps its last loss."""
    runs = curves.select("config", "seed").distinct()
    grid = runs.select("config", "seed", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    w = Window.partitionBy("config", "seed").orderBy("epoch")
    full = grid.join(curves, ["config", "seed", "epoch"], "left").withColumn("loss", F.last("loss", ignorenulls=True).over(w))
    return full.groupBy("config", "epoch").agg(F.avg("loss").alias("mean"), F.min("loss").alias("least"), F.max("loss").alias("most"))


def best_model(results: DataFrame, metric: str = "rmse", eligible: str = "") -> DataFrame:
    """Row with the least metric, the first by pos of equals, among models whose name has `eligible`."""
    rest = [c for c in results.columns]
    return results.filter(F.contains("model", F.lit(eligible))).agg(F.min_by(F.struct(*rest), F.struct(metric, "pos")).alias("r")).select("r.*")


def losses(df: DataFrame, y: str = "y", p: str = "pred", beta: float = 1.0) -> DataFrame:
    """Mean squared, absolute, smooth absolute and Bernoulli divergence losses; the last takes p as a logit."""
    d = F.abs(F.col(p) - F.col(y))
    q = F.least(F.greatest(1 / (1 + F.exp(-F.col(p))), F.lit(1e-7)), F.lit(1 - 1e-7))
    t = F.least(F.greatest(F.col(y), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.agg(
        F.avg(d * d).alias("mse"), F.avg(d).alias("mae"), F.avg(F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2)).alias("smooth_l1"),
        F.avg(t * F.log(t / q) + (1 - t) * F.log((1 - t) / (1 - q))).alias("kl"),
    )


def residuals(df: DataFrame, y: str = "y", p: str = "pred", bins: int = 50) -> DataFrame:
    """Histogram of errors with their mean."""
    e = df.select((F.col(y) - F.col(p)).alias("e"))
    return histogram(e, "e", bins, density=True).join(e.agg(F.avg("e").alias("mean_error")))


def report_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each model with metrics to three decimals, a family's name only at its first."""
    wide = metrics.groupBy("family", "model").pivot("metric", names).agg(F.first("value"))
    w = Window.partitionBy("family").orderBy("model")
    shown = F.when(F.row_number().over(w) == 1, F.col("family")).otherwise("")
    return wide.select(shown.alias("shown"), "family", "model", *(F.round(n, 3).alias(n) for n in names)).orderBy("family", "model").drop("family")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
