"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic, over word features (the word, its prefixes and suffix). Only documents carry labels, so token labels
come from them: in a document labelled toxic, a word is toxic if it or one of its prefixes is
found there far more often than in clean documents. The field is fitted on a bounded sample (MAX_DOCS labelled rows,
in an order by hash, weighted back to the shares of all labelled rows) with exact forward-backward gradients. Marginals of all tokens of the whole text are then aggregated to
features of a logistic score, fitted on the same labels, and tokens with a marginal over one half give the
offending offsets. A document is one chain: it is worked on in blocks of CHAIN words, and the odds are handed over from block to block."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.llm.common import SAMPLE_BYTES, bounded, crc32_mod, documents, fitted, runs, texts, tidy, words_of

#: Labelled rows that the field is fitted on, of at most SAMPLE_BYTES each: two in five toxic, as far as there are so many.
MAX_DOCS = 4000
#: Bytes of texts whose marginals are worked out together in fitting and scoring.
RUN = 1 << 20
#: Rows of a batch whose texts are Python objects at a time, where only scores are wanted.
ROWS = 1000
CHAIN = 64
BUCKETS = 1 << 18
MEMO = 200_000
_EDGE = b" .,;:!?|\"'()[]{}<>#*$%&_-/\\"


def word_features(word: bytes) -> list[int]:
    """Buckets of the lower-cased word without outer punctuation, its prefixes of 4 to 6 letters and its suffix of 3."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGE.decode())
    names = [f"w{w}", f"p4{w[:4]}", f"p5{w[:5]}", f"p6{w[:6]}", f"s{w[-3:]}"]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclass
class Field:
    """Emission weight of each bucket for the toxic state, transition log weights [from, to], document weights."""

    emission: np.ndarray
    transition: np.ndarray
    document: np.ndarray


def chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the documents goes in a table of blocks, flattened; the number of blocks of each document."""
    per = -(-sizes // CHAIN)
    first = np.concatenate(([0], np.cumsum(per)))
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    return np.arange(int(sizes.sum())) - np.repeat(begin, sizes) + np.repeat(first[:-1] * CHAIN, sizes), per


def marginal_odds(e: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds (toxic to clean) of each word, e being the emissions of documents of the given sizes, one after another."""
    place, per = chains(sizes)
    n, t = int(per.sum()), np.exp(transition)
    odds, real = np.ones(n * CHAIN), np.zeros(n * CHAIN, bool)
    odds[place], real[place] = np.exp(np.clip(e, -30, 30)), True
    odds, real = odds.reshape(n, CHAIN).T.copy(), real.reshape(n, CHAIN).T.copy()
    # what a block makes of (clean, toxic) before it: (a clean + b toxic, c clean + d toxic)
    a, b, c, d = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for o, here in zip(odds, real, strict=True):
        after = a * t[0, 0] + c * t[1, 0], b * t[0, 0] + d * t[1, 0], o * (a * t[0, 1] + c * t[1, 1]), o * (b * t[0, 1] + d * t[1, 1])
        scale = sum(after)
        a, b, c, d = (np.where(here, x / scale, old) for x, old in zip(after, (a, b, c, d), strict=True))
    # odds before each block, and backward odds at its end, of all documents that have a block of this number
    first = np.concatenate(([0], np.cumsum(per)))[:-1].astype(np.int64)
    order = np.argsort(-per, kind="stable")
    rank = np.searchsorted(-per[order], -np.arange(int(per.max(initial=0))), side="left")  # documents with more than k blocks
    before, end = np.zeros(n), np.ones(n)
    for k in range(1, len(rank)):
        at = first[order[: rank[k]]] + k
        m = at - 1
        if k == 1:  # a chain begins with the odds of its first word: no transition is before it
            r = odds[0, m]
            for o in odds[1:]:
                r = o[m] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            before[at] = r
        else:
            before[at] = (c[m] + d[m] * before[m]) / (a[m] + b[m] * before[m])
    for k in range(len(rank) - 1, 0, -1):
        at = first[order[: rank[k]]] + k
        end[at - 1] = (b[at] + d[at] * end[at]) / (a[at] + c[at] * end[at])
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    head = np.zeros(n, bool)
    head[first[per > 0]] = True
    if n:
        r = np.where(head, odds[0], odds[0] * (t[0, 1] + before * t[1, 1]) / (t[0, 0] + before * t[1, 0]))
        forward[0], backward[-1] = r, end
    for i in range(1, CHAIN):
        r = forward[i - 1]
        forward[i] = odds[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for i in range(CHAIN - 2, -1, -1):
        x = odds[i + 1] * backward[i + 1]
        backward[i] = np.where(real[i + 1], (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), end)
    return forward.T.ravel()[place], backward.T.ravel()[place]


def document_features(marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, log odds of the largest marginal, log of the expected number of toxic words, of their rate, of the size."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    most, total = np.full(n, 1e-6), np.zeros(n)
    np.maximum.at(most, doc, marginal)
    np.add.at(total, doc, marginal)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(most / (1 - most)), np.log(total + 1e-3), np.log(total / np.maximum(sizes, 1) + 1e-4), np.log1p(sizes) / 5], 1)


def strong_words(codes: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which words mark toxic documents, from how their features are spread over toxic and clean documents; codes are the words of each."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for found, label in zip(codes, toxic.tolist(), strict=True):
        seen[label, np.unique(buckets[found, :4])] += 1
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    k = seen[1]
    strong = (k >= 3) & ((k - 0.5 * k**0.5) / n1 > 8 * (seen[0] + 1) / n0)
    return strong[buckets[:, :4]].any(1)


def _coded(raw: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of the words of each text, and the feature buckets of the different words."""
    known: dict[int, int] = {}
    buckets: list[list[int]] = []
    codes = []
    for a, b in runs([len(t) for t in raw], RUN):
        words = words_of(raw[a:b])
        keys, at, code = np.unique(words.hashes(), return_index=True, return_inverse=True)
        here = np.empty(len(keys), np.int32)
        for i, (key, lo, hi) in enumerate(zip(keys.tolist(), words.starts[at].tolist(), words.ends[at].tolist(), strict=True)):
            n = known.get(key)
            if n is None:
                n = known[key] = len(buckets)
                buckets.append(word_features(words.data[lo:hi].tobytes()))
            here[i] = n
        codes += np.split(here[code], words.first()[1:-1])
    return codes, np.array(buckets, np.int32).reshape(-1, 5)


def fit(rows: list[tuple[bytes, int]], rounds: int = 25, rate: float = 0.5, penalty: float = 1e-4, stand: tuple[float, float] = (1.0, 1.0)) -> Field:
    """Fits the field on (text, label) rows; a clean and a toxic row stand for so many. Marginals are worked out by runs of documents, each a whole chain."""
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0, 0.0, 0.0]))
    toxic = np.array([r[1] for r in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        field.document[0] = 3.0 if len(rows) and toxic[0] else -3.0
        return field
    codes, buckets = _coded([r[0] for r in rows])
    hit = strong_words(codes, toxic, buckets)
    sizes = np.array([len(c) for c in codes], np.int64)
    weight = np.array(stand, float)[toxic]
    weight *= len(rows) / weight.sum()
    parts = []
    for a, b in runs((8 * sizes).tolist(), RUN):
        x, n = np.concatenate([np.zeros(0, np.int32), *codes[a:b]]), sizes[a:b]
        codes[a:b] = [None] * (b - a)  # a run has them now
        parts.append((x, n, hit[x] & np.repeat(toxic[a:b] == 1, n), weight[a:b]))
    seen_e, seen_t = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    n = int((-(-sizes // CHAIN)).sum())
    for _ in range(rounds):
        g, grad_t = np.zeros(len(buckets)), np.zeros((2, 2))
        by_word, t = field.emission[buckets].sum(1), np.exp(field.transition)
        for x, each_size, y, each_weight in parts:
            e, each, follows = by_word[x], np.repeat(each_weight, each_size), np.ones(len(x), bool)
            follows[(np.cumsum(each_size) - each_size)[each_size > 0]] = False
            follows = np.flatnonzero(follows)  # words with a neighbour before them
            forward, backward = marginal_odds(e, field.transition, each_size)
            odds = forward * backward
            g += np.bincount(x, (odds / (1 + odds) - y) * each, len(buckets))
            # joint marginals of neighbours, from the forward odds of the left and the backward odds of the right one
            right = np.exp(np.clip(e[follows], -30, 30)) * backward[follows]
            left = forward[follows - 1]
            joint = [np.full_like(left, t[0, 0]), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right]
            share = each[follows] / sum(joint)
            counts = np.bincount(2 * y[follows - 1] + y[follows], each[follows], 4).reshape(2, 2)
            grad_t += (np.array([j @ share for j in joint]).reshape(2, 2) - counts) / 10
        grad = np.bincount(buckets.ravel(), np.repeat(g, 5), BUCKETS) + penalty * n * field.emission
        seen_e += grad**2
        seen_t += grad_t**2
        field.emission -= rate * grad / np.sqrt(seen_e)
        field.transition -= rate * grad_t / np.sqrt(seen_t)
    by_word, found = field.emission[buckets].sum(1), []
    for x, each_size, *_ in parts:
        forward, backward = marginal_odds(by_word[x], field.transition, each_size)
        odds = forward * backward
        found.append(document_features(odds / (1 + odds), each_size))
    f = np.concatenate(found)
    w, ridge = np.zeros(f.shape[1]), 0.5

    def loss(w: np.ndarray) -> float:
        z = f @ w
        return float(weight @ (np.logaddexp(0, z) - z * toxic) + ridge / 2 * w @ w)

    for _ in range(30):  # Newton steps of a ridge logistic regression, halved until they improve
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve(f.T * (weight * p * (1 - p)) @ f + ridge * np.eye(len(w)), f.T @ (weight * (p - toxic)) + ridge * w)
        size = next((h for h in 0.5 ** np.arange(20) if loss(w - h * step) < loss(w)), 0.0)
        if not size:
            break
        w = w - size * step
    field.document = w
    return field


def _scored(raw: list[bytes], field: Field, memo: dict[int, float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marginals and sizes for runs of texts; only one run's words are held at a time. memo has the weights of words by hash."""
    for a, b in runs([len(t) for t in raw], RUN):
        words = words_of(raw[a:b])
        keys, at, code = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(memo) > MEMO:
            memo.clear()
        new = [(k, lo, hi) for k, lo, hi in zip(keys.tolist(), words.starts[at].tolist(), words.ends[at].tolist(), strict=True) if k not in memo]
        if new:
            weights = field.emission[np.array([word_features(words.data[lo:hi].tobytes()) for _, lo, hi in new])].sum(1)
            memo.update(zip([k for k, _, _ in new], weights.tolist(), strict=True))
        e = np.fromiter(map(memo.__getitem__, keys.tolist()), np.float64, count=len(keys))[code]
        forward, backward = marginal_odds(e, field.transition, words.sizes)
        odds = forward * backward
        yield odds / (1 + odds), words.sizes


def _likelihoods(marginal: np.ndarray, sizes: np.ndarray, field: Field) -> np.ndarray:
    z = document_features(marginal, sizes) @ field.document
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], held, names: list[str]) -> Iterator[pa.RecordBatch]:
    field, memo = held.value, {}
    for batch in batches:
        raw = texts(batch)
        scores, spans, at = [], [], 0
        for marginal, sizes in _scored(raw, field, memo):
            scores.append(_likelihoods(marginal, sizes, field))
            ends = np.cumsum(sizes)
            for hit, size, end in zip(np.split(marginal > 0.5, ends[:-1]) if len(sizes) else [], sizes, ends, strict=True):
                spans.append(_spans(raw[at], np.flatnonzero(hit)) if hit.any() else [])
                at += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            [*batch.schema.names, *names],
        )


def _spans(text: bytes, words: np.ndarray) -> list[dict]:
    """Code point offsets of runs of the given words."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text.decode("utf-8"))]
    out: list[dict] = []
    last = -2
    for w in words.tolist():
        if w == last + 1:
            out[-1]["end"] = places[w][1]
        else:
            out.append({"start": places[w][0], "end": places[w][1]})
        last = w
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = SAMPLE_BYTES) -> Field:
    """Fits the field, in one task, on at most max_docs rows of docs that have a label in labels(doc_id, toxic) and a text of at most max_bytes.

    They come in an order by hash of the id; where an id repeats, its rows count each. Ids with labels of both kinds have rows of both."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
    h = F.md5(F.concat(F.lit("tox|"), F.col("doc_id").cast("string")))
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    ids = short.select("doc_id").distinct().join(known, "doc_id").withColumn("h", h)  # texts are met only by the chosen ids
    most = max_docs * 3 // 5, max_docs * 2 // 5
    there = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    chosen = [ids.filter(F.col("toxic") == y).orderBy("h").limit(most[y]) for y in (1, 0)]
    rows = short.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = bounded(rows.select("toxic", "h", F.coalesce("text", F.lit("")).alias("text")), max_docs, "h", "text", group="toxic")

    def learn(got: list[dict]) -> Field:
        left = [sum(r["toxic"] == y for r in got) for y in (0, 1)]  # what the bound on bytes has left of each
        stand = tuple(max(1.0, there.get(y, 0) / max(left[y], 1)) for y in (0, 1))
        rows = [(r["text"].encode(), r["toxic"]) for r in got]
        got.clear()
        return fit(rows, stand=stand)

    return fitted(rows, learn)


def toxic_scores(docs: DataFrame, field: Field, score: str = "score", spans: str = "spans") -> DataFrame:
    """docs(text, ...) with score and spans, under these names.

    score lies between 0 and 1; spans are code point offsets of runs of words with a toxic marginal over one half.
    Null and empty texts get the score of a text without words and no spans. Every row stays, repeated ones and such
    with null ids too; input columns of these two names are replaced; an empty table gives an empty one. Without labels
    of both kinds, all texts get the same score on the side of the only kind."""
    docs = docs.drop(score, spans)
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"{score} double, {spans} array<struct<start: int, end: int>>").fields])
    return docs.mapInArrow(tidy(lambda it: _score(it, held, [score, spans])), schema)


def toxic_score(text: str, field: Field) -> Column:
    """The score of toxic_scores for a column of texts: only texts go to the workers, and only scores come back."""
    held = SparkSession.active().sparkContext.broadcast(field)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[int, float] = {}
        for column in columns:
            found = [np.zeros(0)]
            for lo in range(0, len(column), ROWS):
                raw = [t or b"" for t in column.slice(lo, ROWS).cast(pa.binary()).to_pylist()]
                found += [_likelihoods(*x, held.value) for x in _scored(raw, held.value, memo)]
            yield pa.array(np.concatenate(found))

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(columns)

    return F.arrow_udf(score, "double")(F.col(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = train(docs.filter(crc32_mod("doc_id", 5) != 0), labels)
    return toxic_scores(docs.select("doc_id", "text"), field).select(
        "doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )
