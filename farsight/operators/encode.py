"""Batch text and span embeddings with encoders by name, and the embedding bank."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.functions import text as X
from farsight.functions.workers import tidy

#: An encoder maker returns a function from texts to rows of float vectors; it runs once per Python worker and task.
Encoder = Callable[[list[str]], np.ndarray]
#: Words that a hashing encoder keeps.
MEMO = 200_000
_ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, maker: Callable[[], Encoder], *aliases: str) -> None:
    for n in (name, *aliases):
        _ENCODERS[n.strip().lower()] = maker


def encoder(name: str) -> Callable[[], Encoder]:
    key = name.strip().lower()
    if key not in _ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; there are {', '.join(sorted(_ENCODERS))}")
    return _ENCODERS[key]


def hashing_encoder(width: int = 64) -> Encoder:
    """Signed hashed word counts: the first 15 digits of a word's md5 give its entry, the next one its sign. Words met before are looked up, MEMO at most."""
    memo: dict[str, int] = {}

    def place(word: str) -> int:
        digits = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        if len(memo) >= MEMO:
            memo.clear()
        memo[word] = at = 2 * (int(digits[:15], 16) % width) + (digits[15] >= "8")
        return at

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            at = [memo[w] if w in memo else place(w) for w in t.lower().split()]
            n = np.bincount(np.array(at, np.int64), minlength=2 * width)
            out[i] = n[1::2] - n[::2]
        return out

    return encode


register_encoder("hashing", hashing_encoder, "default")


def embed(df: DataFrame, text: str, name: str = "hashing", batch: int = 64) -> DataFrame:
    """df with `embedding`, a unit vector of floats, of each text; null counts as empty (M1)."""
    make = encoder(name)

    names = [c for c in df.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):  # only a few rows at a time are Python's
                part = whole.slice(at, batch)
                rows = encode([t or "" for t in part.column(text).to_pylist()])
                unit = [(r / (float(np.linalg.norm(r)) or 1.0)).astype(np.float32) for r in rows]
                ends = np.cumsum([0, *map(len, unit)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(unit)))], [*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "embedding")
    return df.drop("embedding").mapInArrow(tidy(run), schema + ", embedding array<float>")


def extend_bank(bank: DataFrame, texts: DataFrame, name: str = "hashing", on_dim_change: str = "fail") -> DataFrame:
    """bank(qid, text, embedding) with texts(qid, text) whose qid it lacks; each distinct text is encoded once (K9).

    If the new vectors are of another width, `fail` raises and `reset` encodes everything anew."""
    if on_dim_change not in ("fail", "reset"):
        raise ValueError("on_dim_change is fail or reset")
    missing = texts.join(bank.select("qid"), "qid", "left_anti")
    vectors = embed(missing.select("text").distinct(), "text", name)
    new = missing.join(vectors, "text").select("qid", "text", "embedding")
    old, got = bank.select(F.size("embedding")).first(), new.select(F.size("embedding")).first()
    if old and got and old[0] != got[0]:
        if on_dim_change == "fail":
            raise ValueError(f"the bank's vectors have {old[0]} entries, new ones {got[0]}")
        return embed(bank.select("qid", "text").unionByName(missing.select("qid", "text")), "text", name)
    return bank.select("qid", "text", "embedding").unionByName(new)


def text_key(text: Column | str) -> Column:
    """Two 64-bit hashes of a text: what a text-keyed bank is dealt and joined by. Texts themselves decide."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def text_bank(spark: SparkSession) -> DataFrame:
    """An empty text-keyed bank(key, text, qid, embedding)."""
    return spark.createDataFrame([], "key struct<a: bigint, b: bigint>, text string, qid string, embedding array<float>")


def extend_text_bank(bank: DataFrame, requests: DataFrame, name: str = "hashing") -> DataFrame:
    """bank(key, text, qid, embedding) with the texts of requests(pos, text, qid) that it lacks.

    Each different text is encoded once, whatever ids ask for it, and keeps the id of its first request by pos, '' for none. Null texts are no texts. Vectors of another width than the bank's fail. An id may ask
    for a new text, which the bank then has too."""
    asked = requests.filter("text is not null").groupBy("text").agg(F.min_by("qid", "pos").alias("qid")).withColumn("key", text_key("text"))
    known = bank.select("key", F.col("text").alias("__known"))
    missing = asked.join(known, (asked["key"] == known["key"]) & (F.col("text") == F.col("__known")), "left_anti")
    new = embed(missing.select("key", "text", F.coalesce("qid", F.lit("")).alias("qid")), "text", name)
    old, got = bank.select(F.size("embedding")).first(), new.select(F.size("embedding")).first() if not bank.isEmpty() else None
    if old and got and old[0] != got[0]:
        raise ValueError(f"the bank's vectors have {old[0]} entries, new ones {got[0]}")
    columns = ["key", "text", "qid", "embedding"]
    return bank.select(*columns).unionByName(new.select(*columns))


def answered(requests: DataFrame, bank: DataFrame) -> DataFrame:
    """requests with the embedding of each one's text, in any number of repeats; pos still gives their order (K9b). A text that the bank lacks fails the job."""
    rows = requests.withColumn("__key", text_key("text"))
    held = bank.select(F.col("key").alias("__bank"), F.col("text").alias("__text"), F.col("embedding").alias("__v"))
    found = rows.join(held, (F.col("__key") == F.col("__bank")) & (F.col("text") == F.col("__text")), "left")
    lost = F.raise_error(F.concat(F.lit("not in the bank: "), F.coalesce(F.left("text", F.lit(50)), F.lit("null")))).cast("array<float>")
    return found.withColumn("embedding", F.coalesce("__v", lost)).select(*requests.columns, "embedding")


_WORD = "[^\\x20\\x09-\\x0D]"
_WORDS = re.compile(_WORD + "+")


class TokenOffsets:
    """Table function text -> (idx, start, end, token): words with their offsets, for SQL (G5). `tokens` does the same in the JVM."""

    def eval(self, text: str):
        for idx, m in enumerate(_WORDS.finditer(text or "")):
            yield idx, m.start(), m.end(), m[0]


def register_token_offsets(spark: SparkSession, name: str = "token_offsets") -> None:
    """Makes the table function known to SQL: SELECT ... FROM docs, LATERAL token_offsets(text)."""
    spark.udtf.register(name, F.udtf(TokenOffsets, returnType="idx int, start int, end int, token string"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, end, token): words with their offsets, from lengths alone."""
    parts = F.split("text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])", -1)
    rows = docs.select("doc_id", F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), X.strip(p).alias("token"))).alias("p"))
    # running sums by chunks: a list that grew word by word would be copied as often as the text has words
    sums = lambda values, start: F.aggregate(values, F.array(start), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    chunk = lambda c: F.slice(F.col("n"), c * CHUNK + 1, F.lit(CHUNK))
    rows = rows.select("doc_id", "p", F.transform("p", lambda x: x["n"]).alias("n")).withColumn("c", F.sequence(F.lit(0), F.floor((F.size("n") - 1) / CHUNK).cast("int")))
    rows = rows.withColumn("h", sums(F.transform("c", lambda c: F.aggregate(chunk(c), F.lit(0), lambda s, n: s + n)), F.lit(0)))
    starts = F.flatten(F.transform("c", lambda c: F.slice(sums(chunk(c), F.get(F.col("h"), c)), F.lit(1), F.size(chunk(c)))))
    rows = rows.withColumn("s", starts).select("doc_id", F.posexplode(F.arrays_zip("p", "s")).alias("idx", "x")).filter("x.p is not null and x.p.token <> ''")
    return rows.select("doc_id", "idx", F.col("x.s").alias("start"), (F.col("x.s") + F.length("x.p.token")).alias("end"), F.col("x.p.token").alias("token"))


#: Words whose offsets are summed up together.
CHUNK = 256
#: Characters of a bucket of offsets.
BUCKET = 64


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = BUCKET) -> DataFrame:
    """Rows of left(key, start, end, ...) and right(key, c0, c1, ...) whose half-open ranges share a place, once each.

    Ranges are dealt into buckets of `width` places and meet there, so a long text with many ranges is many join keys, not all pairs of its ranges. Two that meet in
    several buckets count in the one where the later of them starts. Empty ranges overlap nothing."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    one = left.filter("start < end").withColumn("__b", buckets("start", "end"))
    two = right.filter("c0 < c1").withColumn("__b", buckets("c0", "c1"))
    met = one.join(two, [key, "__b"]).filter("start < c1 and c0 < end")
    return met.filter(F.col("__b") == F.floor(F.greatest("start", "c0") / width)).drop("__b")


def phrase_spans(docs: DataFrame, phrase: str = "phrase", nth: int = 1) -> DataFrame:
    """(doc_id, c0, c1) of an occurrence of docs(doc_id, text, phrase)'s phrase in any case, of the last if there are fewer; documents without it are left out."""
    found = docs.withColumn("c0", X.occurrence(F.col("text"), F.col(phrase), nth)).filter("c0 is not null")
    return found.select("doc_id", "c0", (F.col("c0") + F.length(phrase)).alias("c1"))


def span_tokens(docs: DataFrame, phrase: str = "phrase", nth: int = 1) -> DataFrame:
    """Tokens of docs(doc_id, text, phrase) that overlap an occurrence of the phrase."""
    spans = phrase_spans(docs, phrase, nth)
    return overlapping(tokens(docs.join(spans.select("doc_id"), "doc_id", "left_semi")), spans).drop("c0", "c1")


def span_windows(docs: DataFrame, phrase: str = "phrase", nth: int = 1, limit: int = 512, context: int = 0) -> DataFrame:
    """(doc_id, first, last, start, tokens): tokens of a window around a phrase, numbered from `start` in the text; first to last (exclusive) of the text's are the phrase's.

    The window has `limit` tokens at most, or the phrase's and `context` on each side, moved to lie within the text; only its tokens are kept. A window shorter than the phrase holds the phrase's first tokens."""
    words = lambda text: F.regexp_count(text, F.lit(_WORD + "+"))
    # tokens that end by c0 are those of the text before it, but one that goes on there; those that start before c1 are those of the text before that: no text is taken apart into rows
    has = docs.filter(F.col("doc_id").isNotNull() & (F.length(phrase) > 0) & F.contains(F.lower("text"), F.lower(phrase)))
    spans = has.select("doc_id", "text", F.length(phrase).alias("width"), X.occurrence(F.col("text"), F.col(phrase), nth).alias("c0"))
    goes_on = (F.col("c0") > 0) & F.substr("text", F.col("c0"), F.lit(2)).rlike(f"^{_WORD}{{2}}")
    sizes = spans.select("doc_id", "text", (words(F.left("text", F.col("c0"))) - goes_on.cast("int")).alias("first"), words(F.left("text", F.col("c0") + F.col("width"))).alias("last"), words("text").alias("size"))
    start, end = X.token_window(F.col("first"), F.col("last"), F.col("size"), limit, context)
    windows = sizes.filter("first < last").select("doc_id", "text", "first", "last", start.alias("start"), end.alias("end"))
    every = F.regexp_extract_all("text", F.lit(_WORD + "+"), F.lit(0))
    return windows.select("doc_id", "first", "last", "start", F.slice(every, F.col("start") + 1, F.col("end") - F.col("start")).alias("tokens"))


#: A maker of a function from windows of tokens to a row of floats for each token of each; it sees the whole window.
TokenEncoder = Callable[[list[list[str]]], list[np.ndarray]]
_TOKEN_ENCODERS: dict[str, Callable[[], TokenEncoder]] = {}


def register_token_encoder(name: str, maker: Callable[[], TokenEncoder]) -> None:
    _TOKEN_ENCODERS[name.strip().lower()] = maker


def contextual(name: str, share: float = 0.5) -> Callable[[], TokenEncoder]:
    """A token encoder from an encoder of texts: a token's vector and a share of the mean of its window's."""

    def make() -> TokenEncoder:
        encode = encoder(name)()

        def run(windows: list[list[str]]) -> list[np.ndarray]:
            every = encode([t for w in windows for t in w])
            parts = np.split(every, np.cumsum([len(w) for w in windows])[:-1])
            return [p + share * p.mean(0) for p in parts]

        return run

    return make


def token_encoder(name: str) -> Callable[[], TokenEncoder]:
    """The token encoder of this name, or one made from the encoder of this name."""
    key = name.strip().lower()
    return _TOKEN_ENCODERS[key] if key in _TOKEN_ENCODERS else contextual(name)


def embed_spans(docs: DataFrame, name: str = "hashing", nth: int = 1, limit: int = 512, context: int = 0, batch: int = 16) -> DataFrame:
    """(doc_id, embedding): unit mean of the vectors that a phrase's tokens have within their window; a document without the phrase is left out (M2).

    The encoder gets whole windows, so each token's vector may depend on what is around it."""
    windows = span_windows(docs, nth=nth, limit=limit, context=context)
    make = token_encoder(name)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for frame in frames:
            held = [list(t) for t in frame["tokens"]]
            rows = [r for i in range(0, len(held), batch) for r in encode(held[i : i + batch])]
            means = [r[max(0, a - s) : b - s].mean(0) for r, a, b, s in zip(rows, frame["first"], frame["last"], frame["start"], strict=True)]
            norms = [float(np.linalg.norm(m)) or 1.0 for m in means]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "embedding": [m / n for m, n in zip(means, norms, strict=True)]})

    return windows.mapInPandas(run, f"doc_id {kind}, embedding array<double>")
