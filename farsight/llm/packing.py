"""Best-fit packing of tokenized documents into sequences of fixed length.

Only the histogram of piece lengths (at most `size` rows) reaches the driver. There a configuration linear program over
classes of lengths is solved by multiplicative weights: each round prices the classes by how little of them is covered, a
knapsack dynamic program finds the best pattern for these prices, and its weight grows. The fractional solution is
rounded down to whole patterns; each takes the longest pieces left of its classes and best fits for the room that
remains, and what is left over is packed best-fit by decreasing length, all on counts. Pieces are then numbered
within their length (salted, so that a common length is dealt to many tasks) and looked up in the list of patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import documents, gathered, runs, texts, tidy, written
from farsight.llm.token_counts import plain, plain_words, tokenizer

#: Distinct words whose token ids a task keeps for its next texts, and bytes of texts that are tokenized together, about.
MEMO, RUN = 200_000, 1 << 20
#: Rows of a batch that are Python objects at a time.
ROWS = 1000
#: Classes of lengths in the linear program, and its rounds.
CLASSES, ROUNDS, STEP = 128, 1500, 0.1
#: Pieces numbered by one task at most, about.
NUMBERED = 100_000

_SIZES: dict[str, np.ndarray] = {}


def _encoded(t, parts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, "<u4") for e in t.encode_batch_fast(parts, add_special_tokens=False)]


class _Ids:
    """Token ids of texts, as arrays of little-endian unsigned 32-bit numbers.

    In plain texts a word is tokenized alone as within the text, with the space or line break before it, so each different word of a run of
    texts is tokenized once, and what a task has met is kept, by its bytes. Texts with other white space are tokenized whole."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer, self.special = tokenizer(path)
        self.marks: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, "<u4")
        self.start, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        """Adds words with what goes before them, which are tokenized in few texts and told apart by the bytes of their tokens. A line break is a token, which a text's first word lacks."""
        lead = np.array([0 if p[0] not in b" \n" else 1 if p[0] == 0x20 else 2 for p in parts])
        found, start, many = [self.flat], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        held = len(self.flat)
        for between, here in ((" ", np.flatnonzero(lead == 1)), ("\n", np.flatnonzero(lead != 1))):
            for lo in range(0, len(here), 5000):
                part = here[lo : lo + 5000]
                texts_ = [parts[i][int(lead[i] > 0) :].decode("utf-8") for i in part.tolist()]
                (ids,) = _encoded(self.tokenizer, [between + between.join(texts_)])
                ends = np.cumsum([len(w.encode()) + 1 for w in texts_])
                cuts = np.searchsorted(np.cumsum(_sizes(self.path)[ids]), ends) + 1
                first = np.concatenate(([0], cuts[:-1])) + (lead[part] == 0)
                start[part], many[part] = held + first, cuts - first
                found.append(ids)
                held += len(ids)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.flat, self.start, self.many = np.concatenate(found), np.concatenate((self.start, start)), np.concatenate((self.many, many))

    def of_marks(self, marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [m for m in marks if m not in self.marks]
        self.marks.update(zip(new, _encoded(self.tokenizer, new), strict=True))
        found = [self.marks[m] for m in marks]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)

    def of_texts(self, raw: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(raw)
        decoded = [t.decode("utf-8") for t in raw]
        even = [plain(t, self.special) for t in decoded]
        whole = [i for i, e in enumerate(even) if not e]
        for i, ids in zip(whole, _encoded(self.tokenizer, [decoded[i] for i in whole]), strict=True):
            out[i] = ids
        rest = [i for i, e in enumerate(even) if e]
        if not rest:
            return out
        words = plain_words([raw[i] for i in rest])
        if len(self.known) + len(words.parts) > MEMO or len(self.marks) > MEMO:
            self.forget()
            self.marks.clear()
        new = [p for p in words.parts if p not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, words.parts), np.int64, count=len(words.parts))[words.code]
        ends, sizes = self.of_marks(words.marks)
        # words and their marks by turns
        flat = np.concatenate((self.flat, ends))
        start, many = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
        start[:, 0], many[:, 0] = self.start[at], self.many[at]
        marked = words.mark >= 0
        start[marked, 1], many[marked, 1] = (len(self.flat) + np.cumsum(sizes) - sizes)[words.mark[marked]], sizes[words.mark[marked]]
        ids = gathered(flat, start.ravel(), many.ravel())
        cuts = np.cumsum(many.sum(1))[np.cumsum(words.sizes)[:-1] - 1]
        for i, part in zip(rest, np.split(ids, cuts), strict=True):
            out[i] = part
        return out


def _sizes(path: str) -> np.ndarray:
    """Bytes of each token: the byte-level alphabet has a character for each byte."""
    if path not in _SIZES:
        vocab = tokenizer(path)[0].get_vocab()
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        out[list(vocab.values())] = [len(k) for k in vocab]
        _SIZES[path] = out
    return _SIZES[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    tail, encoder = np.array([end], "<u4"), _Ids(path)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
        rows: tuple[list, ...] = ([], [], [], [], [])
        raw, docs = texts(batch), batch.column("doc_id").to_pylist()
        for lo, hi in runs([len(t) for t in raw], RUN):
            for doc, ids in zip(docs[lo:hi], encoder.of_texts(raw[lo:hi]), strict=True):
                ids = memoryview(np.append(ids, tail)).cast("B")
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    to = at + (n - at - 1) % size + 1  # the first may be shorter
                    for column, x in zip(rows, (doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                        column.append(x)
                    at, piece = to, piece + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_pattern(prices: np.ndarray, units: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each item that make the dearest filling: an unbounded knapsack by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = units <= c
        if fits.any():
            value = np.where(fits, prices + best[np.maximum(c - units, 0)], -1.0)
            i = int(value.argmax())
            if value[i] > best[c - 1]:
                best[c], choice[c] = value[i], i
                continue
        best[c] = best[c - 1]
    out, c = np.zeros(len(units), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= units[choice[c]]
    return out


def configuration_lp(units: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """Patterns and weights whose coverage stays within the demand, nearly even over the items."""
    covered, found = np.zeros(len(units)), {}
    for _ in range(rounds):
        weights = np.exp(-(covered - covered.min()) / step) / demand
        pattern = best_pattern(weights, units, capacity)
        used = pattern > 0
        amount = float((step * demand[used] / pattern[used]).min())
        covered[used] += amount * pattern[used] / demand[used]
        key = pattern.tobytes()
        found[key] = (pattern, found.get(key, (pattern, 0.0))[1] + amount)
        if covered.min() > 8:
            break
    scale = 1 / max(covered.max(), 1e-12)
    return [(p, x * scale) for p, x in found.values()]


def packing_plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence with their counts, number of such sequences), using up the histogram."""
    left = np.zeros(size + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    plan: list[tuple[dict[int, int], int]] = []

    def fill(lengths: dict[int, int], most: int) -> int:
        """Completes lengths by best fits and takes as many such sequences as there are, up to most."""
        lengths = dict(lengths)
        room = size - sum(n * k for n, k in lengths.items())
        while room > 0:
            fits = np.flatnonzero(left[1 : room + 1]) + 1
            fits = [n for n in fits[::-1] if left[n] > lengths.get(int(n), 0)]
            if not fits:
                break
            n = int(fits[0])
            lengths[n] = lengths.get(n, 0) + 1
            room -= n
        times = min(most, *(int(left[n]) // k for n, k in lengths.items()))
        for n, k in lengths.items():
            left[n] -= k * times
        plan.append((lengths, times))
        return times

    if left[size]:
        fill({size: 1}, int(left[size]))
    width = -(-size // CLASSES)
    of = -(-np.arange(size + 1) // width)
    demand = np.bincount(of, weights=left, minlength=CLASSES + 1)
    units = np.flatnonzero(demand)
    if len(units):
        for pattern, x in sorted(configuration_lp(units, demand[units], size // width), key=lambda p: -p[1]):
            copies = int(x)
            while copies > 0:
                lengths: dict[int, int] = {}
                for u, k in zip(units[pattern > 0][::-1], pattern[pattern > 0][::-1], strict=True):
                    for _ in range(int(k)):
                        here = [n for n in range(u * width, (u - 1) * width, -1) if n <= size and left[n] > lengths.get(n, 0)]
                        if here:
                            lengths[here[0]] = lengths.get(here[0], 0) + 1
                if not lengths:
                    break
                copies -= fill(lengths, copies)
    while left.any():
        n = int(np.flatnonzero(left)[-1])
        fill({n: 1}, int(left[n]))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, pieces a sequence, first sequence and offset of each pattern that has the length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n, k in lengths.items():
            out.setdefault(n, []).append((rank.get(n, 0), k, sequence, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def _placed(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    slots = held.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            first, k, start, place = slots[int(n)]
            at = np.searchsorted(first, rank[rows], side="right") - 1
            inside = rank[rows] - first[at]
            sequence[rows] = start[at] + inside // k[at]
            offset[rows] = place[at] + inside % k[at] * n
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs(doc_id, text).

    A document is its token ids by the tokenizers file at path, then the id `end`; a null or empty text is `end` alone. Documents
    over `size` ids are cut into pieces of `size`, of which the first may be shorter; every row is packed, repeated
    rows too. Equal lengths are interchangeable: ties are broken by id and piece. Other columns are ignored, doc_id
    may be null, and an empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(docs.mapInArrow(tidy(lambda it: _pieces(it, path, size, end)), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    held = docs.sparkSession.sparkContext.broadcast(_slots(packing_plan(histogram, size)))
    salts = max(8, -(-max(histogram.values(), default=1) // NUMBERED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(within))
        .join(starts, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    )
    return ranked.mapInArrow(tidy(lambda it: _placed(it, held)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=0)
