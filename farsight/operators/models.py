"""Models of scores on vectors: scaling, estimators, evaluation, selection, scoring, projections."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.functions import text as X
from farsight.functions import vectors as V
from farsight.operators import encode, sampling, stats
from farsight.sources.shared import cut


def training_set(items: DataFrame, bank: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, features, y) for items with a vector and a score."""
    rows = items.select("qid").join(bank.select("qid", "embedding"), "qid").join(scores.select("qid", "y"), "qid")
    return rows.select("qid", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("y").cast("double").alias("y"))


def standardised(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """features with mean 0 and population deviation 1; a constant entry becomes 0 (M4)."""
    stat = (df if fit_on is None else fit_on).agg(Summarizer.mean(F.col("features")).alias("m"), Summarizer.variance(F.col("features")).alias("v"), F.count("*").alias("n")).first()
    n = stat["n"]
    sd = np.sqrt(stat["v"].toArray() * (n - 1) / n)
    m, inverse = stat["m"].toArray(), np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0)
    moved = F.zip_with(vector_to_array("features"), F.lit(m.tolist()), lambda x, a: x - a)
    return df.withColumn("features", array_to_vector(F.zip_with(moved, F.lit(inverse.tolist()), lambda x, b: x * b)))


def ridge(train: DataFrame, alpha: float = 1.0) -> LinearRegression:
    """Least squares with alpha times the squared weights; the library scales the penalty by the label's deviation (M6)."""
    n, sd, width = train.agg(F.count("*"), F.stddev_pop("y"), F.first(F.size(vector_to_array("features")))).first()
    exact = width <= 4096
    sd = sd if exact else sd * (n / max(n - 1, 1)) ** 0.5
    return LinearRegression(labelCol="y", elasticNetParam=0.0, standardization=False, solver="normal" if exact else "l-bfgs", regParam=alpha * (sd or 1.0) / n)


#: By name: a maker of an estimator, of a constant, or of a function that adds predictions to a table.
MODELS: dict[str, Callable[[DataFrame], Estimator | float | Callable[[DataFrame], DataFrame]]] = {
    "zero": lambda train: 0.0,
    "one": lambda train: 1.0,
    "mean": lambda train: float(train.agg(F.avg("y")).first()[0] or 0.0),
    "cosine": lambda train: lambda df: df.withColumn("pred", V.paired_cosine(vector_to_array("features"))),
    "ridge": ridge,
    "linear_head": lambda train: LinearRegression(labelCol="y", regParam=1e-4, elasticNetParam=0.0),
    "huber": lambda train: LinearRegression(labelCol="y", loss="huber", regParam=1e-4),
    "gbt": lambda train: GBTRegressor(labelCol="y", maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42),
    "forest": lambda train: RandomForestRegressor(labelCol="y", numTrees=100, maxDepth=30, seed=42),
}
ALIASES = {"linear": "ridge", "xgboost": "gbt", "xgb": "gbt", "randomforest": "forest", "random_forest": "forest", "rf": "forest", "mlp": "linear_head"}


def model(name: str) -> Callable[[DataFrame], Estimator | float]:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted({*MODELS, *ALIASES}))}")
    return MODELS[key]


def fitted(name: str, train: DataFrame):
    made = model(name)(train)
    return made.fit(train) if isinstance(made, Estimator) else made


def predicted(fit, df: DataFrame) -> DataFrame:
    if callable(fit):
        return fit(df)
    return df.withColumn("pred", F.lit(fit)) if isinstance(fit, float) else fit.transform(df).withColumnRenamed("prediction", "pred")


def predictions(rows: DataFrame, names: list[str], seeds: list[int] | None = None, compat: bool = False) -> DataFrame:
    """(model, seed, part, qid, y, pred) of models on rows(qid, features, y), written once.

    A seed's rows are split and scaled once, by the training part (with compat by all rows), and every model predicts them all in one pass."""
    out = []
    for seed in seeds or [42]:
        parts = sampling.split(rows.select("qid", "features", "y"), "qid", seed)
        scaled = cut(standardised(parts, None if compat else parts.filter("part = 'train'")))
        train, done = scaled.filter("part = 'train'").drop("part"), scaled
        for i, name in enumerate(names):
            done = predicted(fitted(name, train), done).withColumnRenamed("pred", f"__p{i}")
        each = F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"__p{i}").cast("double").alias("pred")) for i, n in enumerate(names)))
        out.append(done.select(F.lit(seed).alias("seed"), "part", "qid", "y", F.explode(each).alias("x")).select("x.model", "seed", "part", "qid", "y", "x.pred"))
    return cut(stats.union_all(*out))


def evaluate(rows: DataFrame, names: list[str], seeds: list[int] | None = None, compat: bool = False) -> DataFrame:
    """(model, seed, part, metric, value) of models on rows(qid, features, y), all models and seeds in one grouped pass over their predictions."""
    done = predictions(rows, names, seeds, compat).filter("part <> 'train'")
    return stats.metric_suite(done, by=("model", "seed", "part"))


@dataclass
class Evaluation:
    """What an experiment leaves: metrics of each model, seed and part; their means over seeds; the best model by the validation part; the table of the test part."""

    metrics: DataFrame
    summary: DataFrame
    best: str
    report: DataFrame


def experiment(rows: DataFrame, families: dict[str, list[str]], seeds: list[int] | None = None, metric: str = "rmse", folder: str | None = None, compat: bool = False) -> Evaluation:
    """Evaluates models by family over seeds, chooses the best that can be kept, and saves its artifact in folder as `<family>_best_<model>`.

    The best has the least mean of the metric on the validation part, the first by order of equals. It is fitted on the first seed's training part."""
    names = [n for group in families.values() for n in group]
    family = {n: f for f, group in families.items() for n in group}
    metrics = cut(evaluate(rows, names, seeds, compat))
    summary = stats.over_seeds(metrics, ("model", "part", "metric"))
    place = F.coalesce(*(F.when(F.col("model") == n, i) for i, n in enumerate(names)))
    of = F.coalesce(*(F.when(F.col("model") == n, F.lit(f)) for n, f in family.items()))
    kept = [n for n in names if n not in ("zero", "one", "mean", "cosine")]
    tried = summary.filter((F.col("part") == "val") & (F.col("metric") == metric) & F.col("model").isin(kept)).select("model", F.col("mean").alias(metric), place.alias("pos"))
    row = stats.best_model(tried, metric).first()
    best = row["model"] if row else ""
    test = summary.filter("part = 'test'").select(of.alias("family"), "model", "metric", F.col("mean").alias("value"))
    report = stats.report_table(test, ["rmse", "mae", "pearson", "spearman", "macro_precision", "macro_recall", "macro_f1", "micro_f1", "weighted_f1", "accuracy"])
    if folder and best:
        train = sampling.split(rows.select("qid", "features", "y"), "qid", (seeds or [42])[0]).filter("part = 'train'").drop("part")
        artifact(train, best).write().overwrite().save(f"{folder}/{family[best]}_best_{best}")
    return Evaluation(metrics, summary, best, report)


def artifact(train: DataFrame, name: str = "ridge") -> PipelineModel:
    """Scaler and model in one, to be saved together."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    made = model(name)(train)
    if not isinstance(made, Estimator):
        raise ValueError(f"{name} is no estimator and makes no artifact")
    return PipelineModel([scaler, made.copy({made.featuresCol: "scaled"}).fit(scaler.transform(train))])


def score_pairs(pairs: DataFrame, model: PipelineModel, artifact_name: str, encoder: str = "hashing", text_mode: str = "canonical", label: str = "label", context: str = "context") -> DataFrame:
    """pairs with risk_score, score_model_artifact, score_retriever and score_text_mode; other columns stay. Batch or stream, `span` in batch only.

    context encodes the context, canonical `label : context`, span the label where it stands in the context; a context without it is encoded whole."""
    if text_mode not in ("context", "canonical", "span"):
        raise ValueError("text_mode is context, canonical or span")
    if text_mode == "span":
        whole, name = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (context, label))
        rows = pairs.withColumn("__text", whole).withColumn("__key", F.md5(F.concat_ws("\x00", name, whole)))
        docs = rows.select(F.col("__key").alias("doc_id"), F.col("__text").alias("text"), name.alias("phrase")).distinct()
        spans = encode.embed_spans(docs, encoder).select(F.col("doc_id").alias("__key"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
        rest = encode.embed(rows.join(spans, "__key", "left_anti"), "__text", encoder)
        rows = rows.join(spans, "__key").unionByName(rest)
    else:
        text = F.col(context) if text_mode == "context" else X.pair_text(F.col(label), F.col(context))
        rows = encode.embed(pairs.withColumn("__text", text), "__text", encoder)
    rows = rows.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    return model.transform(rows).select(
        *pairs.columns, F.col("prediction").alias("risk_score"), F.lit(artifact_name).alias("score_model_artifact"), F.lit(encoder).alias("score_retriever"), F.lit(text_mode).alias("score_text_mode")
    )


def choose_artifact(registry: DataFrame, path: str | None = None, folder: str | None = None, tag: str | None = None, pattern: str | None = None) -> DataFrame:
    """The artifact of registry(path, name, folder, mtime) to score with.

    A path must be there and is taken as it is. Else the first place that has artifacts counts: the folder if given; or else the folder of the tag, then those whose names match a pattern with * in their order. Within a
    folder mlp_best comes before baseline_best before others, then the newest, then by name. Nothing to be found is an error."""
    if path:
        found = registry.filter(F.col("path") == path).limit(1)
        if found.isEmpty():
            raise ValueError(f"no artifact {path}")
        return found
    priority = F.when(F.col("name").startswith("mlp_best_"), 0).when(F.col("name").startswith("baseline_best_"), 1).otherwise(2)
    place = F.lit(None).cast("int")
    if folder:
        place = F.when(F.col("folder") == folder, 0)
    elif tag or pattern:
        like = ("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$") if pattern else None
        place = F.when(F.col("folder") == (tag or ""), 0).when(F.col("folder").rlike(like) if like else F.lit(False), 1)
    else:
        place = F.lit(0)
    found = registry.withColumn("__place", place).filter("__place is not null").orderBy("__place", F.when(F.col("__place") == 1, F.col("folder")), priority, F.desc("mtime"), "name").limit(1)
    if found.isEmpty():
        raise ValueError(f"no artifact in {', '.join(x for x in (folder, tag, pattern) if x) or 'the registry'}")
    return found.drop("__place")


def principal(df: DataFrame, k: int = 2) -> DataFrame:
    """df with `projection` on k principal axes of the centred features, zeros where there are fewer."""
    mean = df.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    centred = df.withColumn("__c", array_to_vector(F.zip_with(vector_to_array("features"), F.lit(mean.tolist()), lambda x, a: x - a)))
    axes = min(k, len(mean))
    done = PCA(k=axes, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    pad = F.array_repeat(F.lit(0.0), k - axes)
    return done.withColumn("projection", F.concat(vector_to_array("__p"), pad)).drop("__c", "__p")


def discriminant(df: DataFrame, label: str = "class", k: int = 2) -> DataFrame:
    """df with `projection` on the axes that part the classes best.

    Class means come from one aggregate, the scatter within classes from sums of products per partition; only these
    D x D sums reach the driver. Missing axes are filled from the principal axes of what the others leave."""
    means = {r["c"]: (r["m"].toArray(), r["n"]) for r in df.groupBy(F.col(label).alias("c")).agg(Summarizer.mean(F.col("features")).alias("m"), F.count("*").alias("n")).collect()}
    classes = sorted(means, key=str)
    width = len(means[classes[0]][0])
    held = df.sparkSession.sparkContext.broadcast({c: means[c][0] for c in classes})

    def scatter(frames):
        import pandas as pd

        total = np.zeros((width, width))
        for f in frames:
            x = np.stack(f["x"].to_list()) - np.stack([held.value[c] for c in f["c"]])
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "s": total.ravel()})

    sums = df.select(vector_to_array("features").alias("x"), F.col(label).alias("c")).mapInPandas(scatter, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    within = np.zeros((width, width))
    for r in sums:
        within[r["i"], r["j"]] = r["s"]
    n = sum(v[1] for v in means.values())
    centre = sum(m * c for m, c in means.values()) / n
    between = sum(c * np.outer(m - centre, m - centre) for m, c in means.values())
    w, u = np.linalg.eigh(within / n + 1e-9 * np.eye(width))
    half = u / np.sqrt(np.maximum(w, 1e-9))
    values, vectors = np.linalg.eigh(half.T @ (between / n) @ half)
    axes = (half @ vectors[:, ::-1])[:, : min(k, width, len(classes) - 1)]
    if axes.shape[1] < k:
        q = np.linalg.qr(axes)[0] if axes.shape[1] else np.zeros((width, 0))
        rest = np.eye(width) - q @ q.T
        more = np.linalg.eigh(rest @ ((within + between) / n) @ rest)[1][:, ::-1][:, : k - axes.shape[1]]
        axes = np.concatenate([axes, more, np.zeros((width, max(0, k - axes.shape[1] - more.shape[1])))], 1)
    moved = F.zip_with(vector_to_array("features"), F.lit(centre.tolist()), lambda x, a: x - a)
    return df.withColumn("__m", moved).withColumn(
        "projection", F.array(*(F.aggregate(F.zip_with("__m", F.lit(axes[:, i].tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i in range(k)))
    ).drop("__m")
