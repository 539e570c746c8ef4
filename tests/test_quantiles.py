"""Exact order statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.operators import quantiles as Q
from farsight.operators import sampling, stats

SHARES = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)


@pytest.mark.parametrize("case", ["outlier", "ties", "spread", "few"])
def test_quantiles(spark, monkeypatch, case):
    monkeypatch.setattr(Q, "READ", 20)
    monkeypatch.setattr(Q, "BOUNDS", 6)
    rng = np.random.default_rng(3)
    values = {
        "outlier": [*rng.normal(size=900), 1e300, -1e300], "ties": [*np.zeros(800), *rng.normal(size=150), *np.full(60, 3.5)],
        "spread": rng.lognormal(0, 12, 1000), "few": [3.0, 1.0],
    }[case]
    got = Q.quantiles(frame(spark, values), "v", SHARES)
    assert np.allclose(got, np.percentile(values, [100 * s for s in SHARES]), rtol=1e-12, atol=0)


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None,), (2.0,), (None,)], "v double")
    assert Q.quantiles(df.limit(0), "v", [0.5]) == []
    assert Q.quantiles(df, "v", [0.0, 0.5]) == [2.0, 2.0]


def test_state_is_bounded(spark):
    plan = stats.quantile_classes(frame(spark, range(50)), "v", 4)
    assert [r.n for r in plan.groupBy("class").agg(F.count("*").alias("n")).orderBy("class").collect()] == [13, 12, 12, 13]


def test_bin_rules(spark):
    rng = np.random.default_rng(5)
    values = rng.gamma(2.0, 3.0, 700)
    df = frame(spark, values)
    for rule in ("sqrt", "sturges", "rice", "scott", "doane", "fd", "auto"):
        want = np.histogram_bin_edges(values, bins=rule)
        assert np.allclose(stats.bin_edges(df, "v", rule), want, rtol=1e-9), rule
    assert stats.bin_edges(frame(spark, [4.0, 4.0]), "v", "fd") == [4.0, 5.0]
    with pytest.raises(ValueError):
        stats.bin_count(df, "v", "stone")


def test_ranks_by_group(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(rng.integers(0, 9)) if g else float(rng.normal() * 10 ** rng.integers(0, 200)), float(rng.integers(0, 5))) for g in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, y double, pred double")
    import pandas as pd

    want = pd.DataFrame(rows, columns=["g", "y", "pred"]).groupby("g")[["y", "pred"]].apply(lambda x: x.y.rank().corr(x.pred.rank()))
    got = {r.g: r.spearman for r in stats.spearman(df, by=("g",)).collect()}
    assert np.allclose([got[0], got[1]], [want[0], want[1]])


def test_pivot_bins_are_checked(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, y double")
    for amount in (0, 10, 11):
        for mode in ("equal", "equal_tails"):
            with pytest.raises(ValueError):
                sampling.by_histogram(df, "y", "k", 10, mode, amount)
