"""Experiments over models and seeds, and the choice of artifacts."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from farsight.operators import models, sampling, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = 0.5 + 0.2 * x[:, 0] - 0.03 * x[:, 1] + 0.05 * rng.normal(size=400)
    df = spark.createDataFrame([(f"Q{i}", v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "qid string, x array<double>, y double")
    return df.select("qid", array_to_vector("x").alias("features"), "y").cache()


def test_grouped_metrics_are_those_of_each_group(spark, rows):
    done = models.predictions(rows, ["zero", "mean", "ridge"], [1, 2]).filter("part <> 'train'").cache()
    assert done.count() == 2 * 3 * sum(sampling.split_sizes(400)[1:])
    got = {(r.model, r.seed, r.part, r.metric): r.value for r in stats.metric_suite(done, by=("model", "seed", "part")).collect()}
    for model, seed, part in (("ridge", 1, "test"), ("mean", 2, "val"), ("zero", 1, "val")):
        own = done.filter((F.col("model") == model) & (F.col("seed") == seed) & (F.col("part") == part)).select("y", "pred")
        one = {r.metric: r.value for r in stats.metric_suite(own).collect()}
        assert len(one) == 26 and one["micro_f1"] == one["accuracy"]
        for metric, value in one.items():
            assert got[model, seed, part, metric] == pytest.approx(value, abs=1e-12), metric
    evaluated = {(r.model, r.seed, r.part, r.metric): r.value for r in models.evaluate(rows, ["ridge"], [2]).collect()}
    assert evaluated["ridge", 2, "test", "rmse"] == pytest.approx(got["ridge", 2, "test", "rmse"])


def test_ridge_is_fitted_on_the_training_part(spark, rows):
    parts = [(r.part, r.features.toArray(), r.y) for r in sampling.split(rows, "qid", 7).collect()]
    x, y = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    train = np.array([p[0] == "train" for p in parts])
    z = (x - x[train].mean(0)) / x[train].std(0)
    w = np.linalg.solve(z[train].T @ z[train] + np.eye(3), z[train].T @ (y[train] - y[train].mean()))
    want = np.sort(y[train].mean() + z[~train] @ w)
    got = sorted(r.pred for r in models.predictions(rows, ["ridge"], [7]).filter("part <> 'train'").collect())
    assert np.allclose(got, want, atol=1e-6)


def test_an_experiment_reports_and_keeps_the_best(spark, rows, tmp_path):
    done = models.experiment(rows, {"Baselines": ["zero", "mean"], "Linear": ["ridge", "linear_head"]}, [1, 2], folder=str(tmp_path))
    assert done.best in ("ridge", "linear_head")
    means = {(r.model, r.metric): r["mean"] for r in done.summary.filter("part = 'val'").collect()}
    other = {"ridge": "linear_head", "linear_head": "ridge"}[done.best]
    assert means[done.best, "rmse"] <= means[other, "rmse"] < means["mean", "rmse"] < means["zero", "rmse"]
    report = done.report.collect()
    assert [(r.shown, r.model) for r in report] == [("Baselines", "mean"), ("", "zero"), ("Linear", "linear_head"), ("", "ridge")]
    kept = PipelineModel.load(f"{tmp_path}/Linear_best_{done.best}")
    assert kept.transform(rows).select("prediction").count() == 400


def test_choice_of_an_artifact(spark):
    names = [("m1", "a_o_1_k_2", "other.bin", 9), ("m2", "a_o_1_k_2", "baseline_best_x", 5), ("m3", "a_o_1_k_2", "baseline_best_y", 7), ("m4", "b_o_1_k_2", "mlp_best_z", 1), ("m5", "a_o_9", "mlp_best_q", 3)]
    registry = spark.createDataFrame([(p, f, n, t) for p, f, n, t in names], "path string, folder string, name string, mtime long")
    pick = lambda **k: models.choose_artifact(registry, **k).first().path
    assert pick() == "m5" and pick(path="m1") == "m1" and pick(folder="a_o_1_k_2") == "m3"
    assert pick(tag="none", pattern="*_o_1_k_2*") == "m3" and pick(tag="b_o_1_k_2", pattern="a*") == "m4" and pick(pattern="b*") == "m4"
    for wrong in ({"path": "m9"}, {"folder": "zzz"}, {"tag": "zzz", "pattern": "q*"}):
        with pytest.raises(ValueError):
            pick(**wrong)
