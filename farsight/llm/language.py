"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased letters are hashed to BUCKETS features. Document frequencies
are counted over all training rows. The regression is fitted by follow-the-regularised-leader with an elastic net on a
bounded sample of them (MAX_DOCS rows, the same share of each language, in an order by hash, of which each tenth is kept for the temperature that calibrates its scores)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import SAMPLE_BYTES, bounded, crc32_mod, documents, fitted, tidy

MAX_DOCS = 3000
BUCKETS = 1 << 15
_OTHER = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text's letters; None if it has no letter."""
    letters = _OTHER.sub(" ", text.lower())
    if not any(c.isalpha() for c in letters[:64]) and not any(c.isalpha() for c in letters):
        return None
    c = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    one = c * np.uint32(0x165667B1)
    every = np.concatenate((one, two, three))
    return np.bincount((every ^ (every >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.05) -> Model:
    """Follow-the-regularised-leader, one row at a time, with per-coordinate rates."""
    langs = sorted({lang for _, lang in rows})
    data = [(tf_idf(c, idf), langs.index(lang)) for text, lang in rows if (c := gram_counts(text)) is not None]
    kept, fitted = data[::10], [d for i, d in enumerate(data) if i % 10]
    z, n = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), BUCKETS))
    bias, bias_n = np.zeros(len(langs)), np.zeros(len(langs))

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[:, at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((1 + np.sqrt(n[:, at])) / alpha + l2))

    for _ in range(epochs):
        for (at, x), y in fitted:
            w = weights(at)
            g = _softmax(w @ x + bias)
            g[y] -= 1
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
            step = g[:, None] * x
            more = n[:, at] + step * step
            z[:, at] += step - (np.sqrt(more) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] = more
    final = weights(np.arange(BUCKETS))
    scores = [(final[:, at] @ x + bias, y) for (at, x), y in kept]
    temperature = min(
        np.geomspace(0.1, 5, 60), key=lambda t: sum(-np.log(max(_softmax(s / t)[y], 1e-12)) for s, y in scores)
    ) if scores else 1.0
    return Model(langs, idf, final, bias, float(temperature))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts = gram_counts(text or "")
            if counts is not None:
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def _predict(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    m = held.value
    for batch in batches:
        langs, scores = [], []
        for text in batch.column("text").to_pylist():
            counts = gram_counts(text or "") if m.langs else None
            if counts is None:
                langs.append("und")
                scores.append(0.0)
                continue
            at, x = tf_idf(counts, m.idf)
            p = _softmax((m.weights[:, at] @ x + m.bias) / m.temperature)
            i = int(p.argmax())
            langs.append(m.langs[i])
            scores.append(float(p[i]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on docs(doc_id, text, lang): frequencies on all rows with a lang, the regression, in one task, on max_docs of them at most, with texts of at most max_bytes.

    Languages share the sample evenly, so that a rare one is learned too. One row per language is collected."""
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.select("text").mapInArrow(tidy(_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, total = np.zeros(BUCKETS), 0
    for r in counts.collect():  # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 0.1
    # the same share for each language, what some lack goes to the others
    sizes = sorted((r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect())  # a row for each language
    taken, left = {}, max_docs
    for i, (n, lang) in enumerate(sizes):
        taken[lang] = min(n, left // (len(sizes) - i))
        left -= taken[lang]
    if not taken:
        return fit([], idf)
    h = F.md5(F.concat(F.lit("lang|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    short = rows.filter(F.octet_length("text") <= max_bytes)
    quotas = rows.sparkSession.createDataFrame(list(taken.items()), "lang string, most int")
    # hashes are even over their range: what lies under a language's share of it, and a margin, is ordered
    near = short.join(F.broadcast(quotas), "lang").withColumn("h", h)
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, (2 * taken[lang] + 50) / n)) for n, lang in sizes], "lang string, share double")
    near = near.join(F.broadcast(shares), "lang").filter(F.conv(F.substring("h", 1, 12), 16, 10).cast("double") < F.col("share") * float(1 << 48))
    ids = near.select("doc_id", "lang", "h", "most").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter("nth <= most")
    got = bounded(short.join(F.broadcast(ids.select("doc_id", "lang", "h")), ["doc_id", "lang"]), max_docs, "h", "text", group="lang").select("text", "lang")
    return fitted(got, lambda found: fit([(r["text"], r["lang"]) for r in found], idf))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs(doc_id, text): the likeliest language and its calibrated probability.

    A null text or one without a letter gives `und` with score 0, as does a model without languages. Repeated rows keep their
    rows, other columns are ignored, an empty table gives an empty one; equal probabilities go to the language first by code point."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(lambda it: _predict(it, held)), "doc_id long, lang_pred string, score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(crc32_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
