"""Removal of passages that an earlier document has, by seed and extend.

Seeds: each run of LENGTH words selects one of its K-word anchors (the least hash, leftmost), so two equal runs
select the same anchor. Anchors are joined across documents; one that two documents have is a seed. Extension: from a
seed, all runs that selected it are taken to the left and right, and a run is kept if a document with a
smaller id has it too. Overlapping runs merge into maximal repeats, which are removed.

Documents that repeat a whole word sequence are settled first, by its hash: all runs of a copy are in its first
document. Each run of batches of documents reports an anchor or a run once, with the list of its places, so that what
copies and common passages send to one task grows with the number of batches, not of documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.llm.common import documents, grams, hashed_words, lists, merged, shared_folder, signed, texts, tidy, together, written

#: Words of an anchor. Any K below the length gives the same result; it only sets how many anchors there are.
K = 5


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two, sizes = [], [], []
        for text in texts(batch):
            words = text.split()
            digest = xxhash.xxh3_128_digest(b" ".join(words))
            sizes.append(len(words))
            one.append(int.from_bytes(digest[:8], "little", signed=True))
            two.append(int.from_bytes(digest[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
            ["doc_id", "n_words", "h1", "h2"],
        )


def _selected(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes, and for each run of length words the place of the anchor that it selects."""
    anchors = grams(ids, K)
    width = length - K + 1
    if len(anchors) < width:
        return anchors, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(anchors, width)
    return anchors, np.arange(len(view)) + view.argmin(1)


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for group in together(batches):
        firsts: dict[bytes, tuple[int, np.ndarray]] = {}  # of equal word sequences the one with the smallest id
        for doc, words in (x for batch in group for x in zip(batch.column("doc_id").to_pylist(), hashed_words(texts(batch)), strict=True)):
            digest = xxhash.xxh3_128_digest(words.tobytes())
            known = firsts.get(digest)
            if known is None:
                anchors, at = _selected(words, length)
                firsts[digest] = doc, np.unique(anchors[at[np.flatnonzero(np.diff(at, prepend=-1))]]) if len(at) else np.zeros(0, np.uint64)
            elif doc < known[0]:
                firsts[digest] = doc, known[1]
        out = [np.zeros(0, np.uint64), *(chosen for _, chosen in firsts.values())]
        ids = [np.zeros(0, np.int64), *(np.full(len(chosen), doc, np.int64) for doc, chosen in firsts.values())]
        (anchor,), (doc_id,), more, (others,) = merged([np.concatenate(out)], [np.concatenate(ids)])
        yield pa.RecordBatch.from_arrays([signed(anchor), pa.array(doc_id), lists(more, pa.array(others))], ["anchor", "doc_id", "others"])


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All runs that selected a seed: a 96-bit key, of which 32 bits share a column with the place, and the document."""
    for group in together(batches):
        one, two, ids, places = [], [], [], []
        for seeds, doc, words in (x for batch in group for x in zip(batch.column("seeds"), batch.column("doc_id").to_pylist(), hashed_words(texts(batch)), strict=True)):
            anchors, at = _selected(words, length)
            found = np.flatnonzero(np.isin(anchors, seeds.values.to_numpy().view(np.uint64))[at])
            if len(found):
                one.append(grams(words, length)[found])
                two.append((grams(words, length, seed=7)[found] >> np.uint64(32)).astype(np.uint32))
                ids.append(np.full(len(found), doc, np.int64))
                places.append(found.astype(np.int32))
        if one:
            places, two = np.concatenate(places).astype(np.int64), np.concatenate(two)
            (h1, h2), (doc_id, at), more, (docs, places) = merged([np.concatenate(one), two], [np.concatenate(ids), places])
            others = lists(more, pa.StructArray.from_arrays([pa.array(docs), pa.array(places)], ["doc_id", "at"]))
            packed = pa.array((at << 32) | h2.astype(np.int64))
            yield pa.RecordBatch.from_arrays([signed(h1), packed, pa.array(doc_id), others], ["h1", "at_h2", "doc_id", "others"])


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal repeats, as half-open word ranges, covered by runs of length words at starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate(([0], cut + 1))]
    last = starts[np.concatenate((cut, [len(starts) - 1]))] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _cut(text: bytes, repeats: list[tuple[int, int]]) -> bytes:
    """The text without the given words; the white space before the first kept word and between kept words stays."""
    if not repeats:
        return text
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    parts, done = [], 0
    for a, b in repeats:
        parts.append(text[done : places[a][0]])
        done = places[b][0] if b < len(places) else len(text)
    return b"".join([*parts, text[done:]])


def _results(batches: Iterator[pa.RecordBatch], length: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, sha, kept_text, repeats = [], [], [], [], []
        starts = batch.column("starts")
        copies = batch.column("copy").to_pylist()
        for i, text in enumerate(texts(batch)):
            words = text.split()
            found = [] if len(words) < length else [(0, len(words))] if copies[i] else spans(starts[i].values.to_numpy(), length) if starts[i].is_valid else []
            kept, done = [], 0
            for a, b in found:
                kept += words[done:a]
                done = b
            kept += words[done:]
            sizes.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            kept_text.append(_cut(text, found))
            repeats.append([{"first": a, "last": b - 1} for a, b in found])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in carried), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                pa.array(kept_text, pa.binary()).cast(pa.string()),
                pa.array(repeats, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ],
            [*carried, "n_words", "n_removed", "kept_sha256", "kept_text", "repeats"],
        )


def repeated_substrings(docs: DataFrame, length: int = 13, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, repeats) for each row of docs(doc_id, text).

    A word goes if a run of `length` words that covers it also starts in a document with a smaller doc_id; runs are
    judged on the input. repeats lists the maximal repeats as first and last word. Words keep their case.
    kept_text is the text without them, with the white space between kept words. Null and empty texts have no words
    and an empty kept_text; texts shorter than length words lose none. A row with a null doc_id loses nothing, and no other does for it; rows that repeat a
    doc_id must repeat its text: they count as one document, and each gets its result. Other columns
    are ignored, or returned too with carry, where those with names of results are replaced. An empty table gives an empty one."""
    whole = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text", "repeats", "starts", "copy").withColumn("doc_id", F.col("doc_id").cast("long"))
    whole = whole if carry else whole.select("doc_id", "text")
    alone, whole = whole.filter("doc_id is null"), whole.filter("doc_id is not null")
    docs = whole.select("doc_id", "text")
    shared_folder(docs.sparkSession)
    keyed = written(docs.mapInArrow(tidy(_keys), "doc_id long, n_words long, h1 long, h2 long"))
    long_enough = keyed.filter(F.col("n_words") >= length)
    firsts = written(long_enough.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")))

    occurrences = docs.mapInArrow(tidy(lambda it: _anchors(it, length)), "anchor long, doc_id long, others array<long>")
    rows = F.lit(1) + F.coalesce(F.size("others"), F.lit(0))
    met = occurrences.withColumn("df", F.sum(rows).over(Window.partitionBy("anchor"))).filter("df > 1")
    met = met.select("anchor", F.explode(F.array_append(F.coalesce("others", F.array().cast("array<long>")), F.col("doc_id"))).alias("doc_id"))
    met = written(met.join(firsts.select("doc_id"), "doc_id", "left_semi"))
    seeds = met.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    seeded = written(met.join(seeds, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("seeds")))

    placed = whole.repartition("doc_id")  # one exchange of the texts for both joins
    runs = placed.join(seeded, "doc_id").select(*whole.columns, "seeds").mapInArrow(
        tidy(lambda it: _runs(it, length)), "h1 long, at_h2 long, doc_id long, others array<struct<doc_id:bigint,at:bigint>>"
    )
    own = F.expr("named_struct('doc_id', doc_id, 'at', shiftright(at_h2, 32))")
    every = F.array_append(F.coalesce("others", F.array().cast("array<struct<doc_id:bigint,at:bigint>>")), own)
    runs = runs.repartition("h1").select("h1", F.expr("at_h2 & 4294967295").alias("h2"), every.alias("every"))
    least = F.min(F.array_min(F.col("every.doc_id"))).over(Window.partitionBy("h1", "h2"))
    runs = runs.withColumn("lo", least).select("lo", F.explode("every").alias("x")).filter("x.doc_id > lo")
    marks = runs.groupBy(F.col("x.doc_id").alias("doc_id")).agg(F.collect_list(F.col("x.at").cast("int")).alias("starts"))
    later = long_enough.join(firsts, ["h1", "h2", "doc_id"], "left_anti").select("doc_id", F.lit(True).alias("copy"))
    decided = marks.join(later, "doc_id", "full").groupBy("doc_id").agg(F.first("starts").alias("starts"), F.first("copy").alias("copy"))
    carried = whole.columns if carry else ["doc_id"]
    added = T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string, repeats array<struct<first: int, last: int>>")
    schema = T.StructType([*(whole.schema[c] for c in carried), *added.fields])
    alone = alone.withColumns({"starts": F.lit(None).cast("array<int>"), "copy": F.lit(None).cast("boolean")})
    found, rest = (x.mapInArrow(tidy(lambda it: _results(it, length, carried)), schema) for x in (placed.join(decided, "doc_id", "left"), alone))
    return found.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(documents(spark, sf_dir), length=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM t),
f AS (SELECT doc_id, i, md5(array_to_string(k, ' ')) AS k FROM g WHERE len(k) = 13),
m AS (SELECT k, min(doc_id) AS d FROM f GROUP BY 1),
x AS (SELECT f.doc_id, f.i FROM f JOIN m ON f.k = m.k WHERE m.d < f.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS s, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
