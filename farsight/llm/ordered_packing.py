"""Packing that keeps the order of documents: windows cut by dynamic programming.

The documents of a task follow each other as they are read, in blocks of bounded size, so nothing is shuffled. A block is one run of token ids, which is
cut into windows of at most `size` ids. Cuts may lie at the end of a document, for nothing, at the end of a sentence within a document, for a
small truncation penalty, or elsewhere, for a larger one, at places so close that a window always fits. A window costs its padding, which is
none at a power of two, and a little for itself. The cheapest cuts come from one pass over the possible ones: what a window costs
that starts at j and ends at i is cost(j) + place(j) - place(i) and constants, so the best start within reach is the head of a monotone queue;
starts a power of two before i are looked up by their place."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm.common import documents, numbered, runs, texts, tidy, words_of
from farsight.llm.token_counts import stems, tokenizer

#: Bytes of texts that are tokenized together, about, distinct words whose ids a task keeps, and token ids of a block, about.
RUN, MEMO, BLOCK = 4 << 20, 1_000_000, 1 << 21
#: What a cut within a document costs, in padded ids: at the end of a sentence, elsewhere; and what a window costs by itself.
SENTENCE, INSIDE, WINDOW = 24, 96, 4
#: Sentences' ends of which the last is a possible cut lie within so many ids.
NEAR = 16
#: Ids between two possible cuts at most, and the shortest window that is made for its length's sake but at the end of a block.
STEP, LEAST = 512, 256
#: Words of which the tokenizer keeps the number of bytes, whose ids can be told apart where they are tokenized together.
_EVEN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\xbf])+")
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b"\"')]}")] = True
#: Full stops of scripts that don't part words by spaces, as the three bytes of their UTF-8.
_WIDE_STOPS = [list("。".encode()), list("！".encode()), list("？".encode())]


#: What a Python worker has met, from task to task.
_KEPT: dict[str, WordIds] = {}


class WordIds:
    """Token ids of texts whose tokenizer drops white space: each different word between white space is tokenized once and kept, by its bytes."""

    def __init__(self, path: str):
        self.tokenizer, _ = tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]  # the byte-level alphabet has a character for each byte
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.offsets = np.zeros(0, "<u4"), np.zeros(1, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words among the known ones."""
        if len(self.known) > MEMO:
            self.forget()
        at = list(map(self.known.get, words))
        new = [w for w, k in zip(words, at, strict=True) if k is None]
        if not new:
            return np.array(at, np.int32)
        even = [w for w in new if _EVEN.fullmatch(w) and b"<|" not in w]
        for lo in range(0, len(even), 5000):
            part = even[lo : lo + 5000]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            self.add(part, ids, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w) for w in part])) + 1)
        if len(even) < len(new):
            met = set(even)
            rest = [w for w in new if w not in met]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in rest], add_special_tokens=False)]
            self.add(rest, np.array([i for x in found for i in x], "<u4"), np.cumsum([len(x) for x in found]))
        return np.array(list(map(self.known.__getitem__, words)), np.int32)

    def add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.offsets = np.concatenate((self.offsets, (ends + len(self.flat)).astype(np.int32)))
        self.flat = np.concatenate((self.flat, ids))

    def of_texts(self, raw: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, each with `end` last, the number of ids of each, and at which ids, counted over all texts, a sentence has ended."""
        words = words_of([_lowered(t) for t in raw])
        cut, stem = stems(words.data, words.starts, words.ends)  # marks after a letter are apart: no token spans the two
        code, different = numbered(words.data, np.insert(words.starts, cut + 1, stem), np.insert(words.ends, cut, stem))
        number = self.numbers(different.to_pylist())[code]
        stops = np.insert(_stops(words.data, words.starts, words.ends), cut, False)
        after = np.cumsum(words.sizes)
        after += np.searchsorted(cut, after)
        number = np.insert(number, after, len(self.offsets) - 1)  # an `end` after each text's parts
        flat, offsets = np.append(self.flat, np.array([end], "<u4")), np.append(self.offsets, np.int32(len(self.flat) + 1))
        known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        ids = known.take(pa.array(number)).values.to_numpy()
        ends = np.cumsum(np.diff(offsets)[number], dtype=np.int64)
        lengths = np.diff(ends[after + np.arange(len(after))], prepend=0)
        return ids, lengths, ends[np.insert(stops, after, False)]


def _lowered(text: bytes) -> bytes:
    """The text with A-Z in lower case, as the tokenizer has it, so that fewer words are different; as it is where that could change ids: by a special string or a combining mark after a letter."""
    return text if any(x in text for x in (b"<|", b"\xcc", b"\xcd")) else text.lower()


def _stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a sentence ends with each word: by a stop, perhaps with closing marks after it, or by a line break."""
    solid = np.maximum.accumulate(np.where(_CLOSING[data], 0, np.arange(len(data), dtype=np.int32)))[ends - 1]
    last = data[solid]
    stop = (_STOP[last] & (solid >= starts)) | (data[ends] == 0x0A)
    wide = np.flatnonzero((last >= 0x80) & (solid - starts >= 2))
    for one, two, three in _WIDE_STOPS:
        at = solid[wide]
        stop[wide] |= (last[wide] == three) & (data[at - 1] == two) & (data[at - 2] == one)
    return stop


def possible_cuts(lengths: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a block of documents of these lengths may be cut, ascending from 0 to its end, and the penalty of each.

    Documents' ends, sentences' ends, places so close that no gap is wider than step, and what lies a power of two before the block's end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    stops = stops[np.diff(stops // NEAR, append=-1) != 0]  # the last of those that are near each other
    known = np.union1d(np.concatenate(([0], ends)), stops)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > step)
    more = (gaps[wide] - 1) // step
    inner = np.repeat(known[wide], more) + step * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    tail = total - (1 << np.arange(0, 12))
    places = np.union1d(known, np.concatenate((inner, tail[tail > 0])))
    penalty = np.full(len(places), INSIDE)
    penalty[np.isin(places, stops)] = SENTENCE
    penalty[np.isin(places, np.concatenate(([0], ends)))] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """Those of the ascending places, first and last included, whose windows of at most size cost least in padding and penalties.

    A window is padded to size unless its length is a power of two. No gap between neighbours may be wider than size."""
    # starts a power of two before each place, in lists one after another
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(len(places))
    late = int(np.searchsorted(places, places[-1] - size))
    at, back = [], []
    power = 1
    while power < size:
        ends = np.arange(1 if power >= LEAST else max(1, late), len(places))
        found = number[np.maximum(places[ends] - power, 0)]
        hit = (found >= 0) & (places[ends] >= power)
        at.append(ends[hit])
        back.append(found[hit])
        power *= 2
    exact: dict[int, list[int]] = {}
    for i, k in zip(np.concatenate(at).tolist(), np.concatenate(back).tolist(), strict=True):
        exact.setdefault(i, []).append(k)
    place, low = places.tolist(), (places - size).tolist()
    cost, start = [0], [0]
    # the queue: cost + place, and place and number, ascending from head
    keys, where, which, head = [0], [0], [0], 0
    for i, (here, least, extra) in enumerate(zip(place, low, (penalty + WINDOW).tolist(), strict=True)):
        if not i:
            continue
        while where[head] < least:
            head += 1
        best, j = keys[head] - least, which[head]
        if i in exact:
            for k in exact[i]:
                if cost[k] < best:
                    best, j = cost[k], k
        best += extra
        cost.append(best)
        start.append(j)
        best += here
        while len(keys) > head and keys[-1] >= best:
            keys.pop()
            where.pop()
            which.pop()
        keys.append(best)
        where.append(here)
        which.append(i)
    chosen, i = [len(place) - 1], len(place) - 1
    while i > 0:
        i = start[i]
        chosen.append(i)
    return places[chosen[::-1]]


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _windows(docs: list[int | None], ids: np.ndarray, lengths: np.ndarray, stops: np.ndarray, size: int, first: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block whose sequences are numbered from first, and the next number."""
    cuts = best_cuts(*possible_cuts(lengths, stops), size)
    ends = np.cumsum(lengths)
    edges = np.union1d(cuts, np.concatenate(([0], ends)))
    left, right = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, left, side="right")
    sequence = np.searchsorted(cuts, left, side="right") - 1
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    columns = [
        pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(left - (ends - lengths)[doc]), pa.array(right - left), pa.array(sums, pa.int64()),
        pa.array(lengths[doc]), pa.array(first + sequence), pa.array(left - cuts[sequence]),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES), first + len(cuts) - 1


def _packed(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    encoder, number = _KEPT[path], TaskContext.get().partitionId() << 32
    docs: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, lengths, stops = zip(*held, strict=True)
        before = np.cumsum([0, *map(len, ids)])
        return np.concatenate(ids), np.concatenate(lengths), np.concatenate([s + b for s, b in zip(stops, before, strict=False)])

    for batch in batches:
        raw, names = texts(batch), batch.column("doc_id").to_pylist()
        for lo, hi in runs([len(t) for t in raw], RUN):
            docs += names[lo:hi]
            held.append(encoder.of_texts(raw[lo:hi], end))
            count += len(held[-1][0])
            if count >= BLOCK:
                rows, number = _windows(docs, *block(), size, number)
                yield rows
                docs, held, count = [], [], 0
    if docs:
        yield _windows(docs, *block(), size, number)[0]


def pack_in_order(docs: DataFrame, path: str, size: int = 4096, end: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of docs(doc_id, text).

    A document is its token ids by the tokenizers file at path, which must drop white space, then the id `end`; a null or empty text is `end` alone. Documents
    stand in the order in which Spark reads them; a sequence is a run of them. Every row is packed, repeated rows and such with a null doc_id too. Sequences
    are numbered by task, so that another split of the input gives other numbers and, at the ends of blocks, other cuts. Other columns are ignored; an empty
    table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidy(lambda it: _packed(it, path, size, end)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_in_order(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=4096, end=2)
