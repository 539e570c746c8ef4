"""Phrases whose words occur together more often than apart, from counts of longest windows.

Each word of a piece heads a window of up to WORDS words: the columns after the first lead it by one to four words, and are empty past the end of the piece. Only
these longest windows are counted, by language. Spark's ROLLUP then sums them over successively shorter prefixes, which gives the number of
occurrences of every phrase at once: each occurrence heads one window. No shorter phrases are listed or counted by themselves.

A window may end early where no longer prefix of it can be frequent. A first pass counts pairs of neighbouring words in a table of a bounded
number of slots by hash, a second one the longer prefixes of what is left of the windows; a slot that stays under the threshold proves that each of its phrases does, and so every
phrase with them. Counts of all frequent phrases stay exact whatever the size of the tables; full tables only leave more windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import documents, hashed, numbered, runs, texts, tidy, written

#: Words of the longest phrase, bytes of texts that are worked on together, about, and windows of a task that are held.
WORDS, RUN, MERGE = 5, 8 << 20, 1_500_000
#: Slots of the table: one for so many bytes of input (as Spark sees its size), between these bounds. A slot takes a byte and counts to FULL.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 20, 1 << 26
FULL = 255
#: Slots in a row of the shuffle, which is compressed, as a task fills few of them.
CHUNK, CODEC = 1 << 15, pa.Codec("zstd", 1)
COLUMNS = [f"w{i}" for i in range(1, WORDS + 1)]
_PART = np.zeros(256, bool)
_PART[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _PART.copy()
_APART[[0x20, 0x09]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of some texts in lower case: the number of each among the different ones, whether the next word follows in its piece, and how many each text has."""

    def __init__(self, raw: list[bytes]):
        data = np.frombuffer(b"\n".join([t.lower() for t in raw]) + b"\n", np.uint8)  # bytes: A-Z only; a line break ends a piece
        apart = _APART[data]
        edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[::2], edges[1::2]
        self.code, self.different = numbered(data, starts, ends)
        piece = np.cumsum(_PART[data], dtype=np.int32)[starts]
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        begin = np.cumsum([0, *(len(t) + 1 for t in raw)])
        self.sizes = np.diff(np.searchsorted(starts, begin))

    def keys(self, lang: bytes) -> np.ndarray:
        return hashed(self.different) ^ np.uint64(xxhash.xxh3_64_intdigest(lang, 1))


def _joined(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    out = hashes * _MIX
    out ^= (out >> np.uint64(29)) + keys
    return out * _MIX


def _reached(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the slots of phrases have reached the threshold."""
    return bits[_slot(hashes, len(bits))]


def _unpacked(held) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """Words of runs of texts of a language."""
    lang, raw = batch.column("lang").dictionary_encode(), texts(batch)
    for k, name in enumerate(lang.dictionary.to_pylist()):
        own = [raw[i] for i in np.flatnonzero(lang.indices.to_numpy() == k).tolist()]
        for lo, hi in runs([len(t) for t in own], RUN):
            words = Words(own[lo:hi])
            if len(words.code):
                yield name, words


def _pairs(words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of words with the next one of their piece."""
    first = np.flatnonzero(words.joined)
    return first, _joined(keys[words.code[first]], keys[words.code[first + 1]])


def _follows(words: Words, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """After which words the next one may belong to the same frequent phrase, with WORDS more at the end."""
    first, hashes = _pairs(words, keys)
    follows = np.zeros(len(words.code) + WORDS, bool)
    follows[first[_reached(hashes, bits)]] = True
    return follows


def _longer(words: Words, keys: np.ndarray, follows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Heads and hashes of phrases of 3 words, of 4 and so on whose pairs may all be frequent."""
    at = np.flatnonzero(follows)
    hashes = _joined(keys[words.code[at]], keys[words.code[at + 1]])
    for k in range(2, WORDS):
        on = follows[at + k - 1]
        at, hashes = at[on], hashes[on]
        hashes = _joined(hashes, keys[words.code[at + k]])
        yield at, hashes


def _slots(batches: Iterator[pa.RecordBatch], slots: int, chunk: int, held=None) -> Iterator[pa.RecordBatch]:
    """(chunk, counts) by slot of a task's pairs, and (lang, n) with the number of its words; or, where held has the bits of these, of longer phrases."""
    names = ["chunk", "counts", "lang", "n"]
    table, total = np.zeros(slots, np.uint8), {}
    bits = None if held is None else _unpacked(held)

    def add(hashes: np.ndarray) -> None:
        at = _slot(hashes, slots)
        at.sort()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        times = np.diff(np.append(first, len(at)))
        table[at[first]] = np.minimum(table[at[first]] + times, FULL)

    for batch in batches:
        for lang, words in _by_language(batch):
            keys = words.keys(lang.encode())
            if bits is None:
                total[lang] = total.get(lang, 0) + len(words.code)
                add(_pairs(words, keys)[1])
            else:
                for _, hashes in _longer(words, keys, _follows(words, keys, bits)):
                    add(hashes)
    chunks = np.flatnonzero(table.reshape(-1, chunk).any(1))
    if len(chunks):
        rows = [CODEC.compress(table[k * chunk : (k + 1) * chunk], asbytes=True) for k in chunks.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], names)
    if total:
        n = len(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names)


def _added(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """(chunk, bits): rows come sorted by chunk; which of its slots reach the threshold."""
    now, sums = None, np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= min(least, FULL)).tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            found = np.frombuffer(CODEC.decompress(counts, size), np.uint8).astype(np.int64)
            if chunk == now:
                sums += found
            else:
                if now is not None:
                    yield out()
                now, sums = chunk, found
    if now is not None:
        yield out()


def _windows(batches: Iterator[pa.RecordBatch], short, long) -> Iterator[pa.RecordBatch]:
    """(lang, w1 ... w5, n): a task's different longest windows, with their number. Empty words follow the last of a short window."""
    bits, deep = _unpacked(short), _unpacked(long)
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        found = pa.concat_tables(held).group_by(["lang", *COLUMNS], use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns(["lang", *COLUMNS, "n"]).combine_chunks()

    for batch in batches:
        for lang, words in _by_language(batch):
            keys = words.keys(lang.encode())
            follows = _follows(words, keys, bits)
            code = np.concatenate((words.code.astype(np.int32) + 1, np.zeros(WORDS, np.int32)))  # 0 for none
            reach = np.ones(len(code), np.int8)  # words of each head's window
            reach[follows] = 2
            for k, (at, hashes) in enumerate(_longer(words, keys, follows), 3):
                reach[at[(reach[at] == k - 1) & _reached(hashes, deep)]] = k
            n = len(words.code)
            columns = [pa.array(np.where(reach[:n] > k, code[k : n + k], 0)) for k in range(WORDS)]
            counted = pa.table(columns, COLUMNS).group_by(COLUMNS, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            spelled = pa.concat_arrays([pa.array([b""], pa.binary()), words.different]).cast(pa.string())
            held.append(pa.table([pa.array([lang] * len(counted), pa.string()), *(spelled.take(counted.column(c).combine_chunks()) for c in COLUMNS), counted.column("count_all")], ["lang", *COLUMNS, "n"]))
            if sum(map(len, held)) > MERGE:
                held = [merged()]
                if 2 * len(held[0]) > MERGE:
                    yield from held.pop().to_batches(50_000)
    if held:
        yield from merged().to_batches(50_000)


def _bits(seen: DataFrame, slots: int, chunk: int, least: int):
    """Broadcast bits of the slots that reach the threshold over all tasks: MOST_SLOTS / 8 bytes at most, 8 MB."""
    dealt = seen.filter("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    size = chunk // 8
    bits = bytearray(slots // 8)
    for row in dealt.mapInArrow(tidy(lambda it: _added(it, least, chunk)), "chunk int, bits binary").collect():
        bits[row["chunk"] * size : (row["chunk"] + 1) * size] = row["bits"]
    return seen.sparkSession.sparkContext.broadcast(bytes(bits))


def _size(docs: DataFrame) -> int:
    """Bytes of the input as Spark's plan has them; they only set the size of the table of slots."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words of docs(text, lang) that occur `least` times, and (lang, n) with the number of words."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (_size(docs) // SLOT_BYTES).bit_length()))
    chunk, schema = min(CHUNK, slots), "chunk int, counts binary, lang string, n long"
    seen = written(docs.mapInArrow(tidy(lambda it: _slots(it, slots, chunk)), schema))
    totals = seen.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    short = _bits(seen, slots, chunk, least)
    long = _bits(docs.mapInArrow(tidy(lambda it: _slots(it, slots, chunk, short)), schema), slots, chunk, least)
    windows = docs.mapInArrow(tidy(lambda it: _windows(it, short, long)), f"lang string, {', '.join(f'{c} string' for c in COLUMNS)}, n long")
    longest = windows.groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))
    prefixes = longest.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"))
    last = F.coalesce(*reversed(COLUMNS))  # what is rolled up is null, what a short window lacks is empty
    words = F.size(F.filter(F.array(*COLUMNS), lambda w: w.isNotNull()))
    frequent = prefixes.filter((F.col("f") >= least) & F.col("w1").isNotNull() & (last != ""))
    return frequent.select("lang", F.concat_ws(" ", *COLUMNS).alias("phrase"), words.alias("words"), "f"), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of docs(text, lang).

    A-Z are lower-cased; pieces end at .,;:!? and line breaks, words at spaces and tabs. n is the number of words of the language, f that of a phrase's occurrences within pieces, overlaps included. Candidates are
    phrases of 2 to 5 words with a = f(phrase) >= least. A cut after k words gives l and r, the f of both sides, and floor(1000 * a * n / (l * r)), exactly; the least counts, the smallest k of equals. A candidate within a longer
    one with as many occurrences goes. Ranks go by score, then a, highest first, then phrase in the order of its bytes. A null text has no words, a null lang is `und`; repeated rows count each.
    Other columns are ignored; an empty table gives an empty one."""
    found, totals = phrase_counts(docs, least)
    found = written(found)
    longer = found.filter("words >= 2")
    parts = F.split("phrase", " ")
    cut = longer.select("lang", "phrase", F.col("f").alias("a"), parts.alias("p"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = F.array_join(F.slice("p", F.lit(1), F.col("k")), " "), F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), " ")
    cut = cut.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    product = F.lit(1000).cast("decimal(4,0)") * wide("a", 16) * wide("n", 18)
    scored = cut.join(totals, "lang").withColumn("score", F.call_function("div", product, wide("l", 19) * wide("r", 19)))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    # the phrases within a candidate that lack its first or last word: shorter ones lie within these, which are as frequent at least
    inner = F.array(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1))
    inside = longer.filter("words >= 3").select("lang", F.explode(inner).alias("p"), "f")
    inside = inside.groupBy("lang", F.array_join("p", " ").alias("phrase")).agg(F.max("f").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("most is null or most < a")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=100, top=2000)


ORACLE = r"""
WITH p AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY 1),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM (
    SELECT lang, k.k, unnest(list_transform(range(1, len(ws) - k.k + 2), lambda i: array_to_string(ws[i:i + k.k - 1], ' '))) AS phrase FROM w, range(1, 6) k(k) WHERE len(ws) >= k.k)
    GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, k.k, (1000 * c.a * n.n) // (l.f * r.f) AS score FROM c JOIN range(1, 5) k(k) ON k.k < c.k JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT x.lang, x.phrase FROM (SELECT lang, a, unnest(list_transform(range(1, k - m.m + 2), lambda j: array_to_string(ws[j:j + m.m - 1], ' '))) AS phrase
    FROM c, range(2, 5) m(m) WHERE m.m < c.k) x JOIN c ON c.lang = x.lang AND c.phrase = x.phrase WHERE 100 * x.a >= 100 * c.a),
g AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM g WHERE rank <= 2000
"""
