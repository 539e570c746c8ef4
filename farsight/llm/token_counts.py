"""Token counts of whole texts from counts per distinct pre-token.

A pre-token here is a word with the space or line break before it, as far as no token can reach over its ends: the tokenizer splits
before a single space that a word follows, and around a single line break. Other shapes (runs of white space, special strings) are joined with
their neighbours into one longer pre-token. Documents are worked on in blocks of bounded size. A block gives a row for each of its distinct
pre-tokens, and for each document a row with the frequencies of its pre-tokens, by their numbers in the block. Pre-tokens are
dealt and sorted, each is counted once, and its number of pieces goes back to the blocks that have it, in one row with others of the
block, where they are joined to the documents' frequencies and summed. No ids are kept.

Pre-tokens that are common in a sample of documents are counted beforehand and broadcast, a table of bounded size:
blocks sum theirs at once, and only the others are dealt. The sample decides which way a pre-token goes, not the result."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm.common import documents, numbered, sample, texts, tidy, words_of, written

#: A block ends at so many documents or bytes; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 20_000, 12 << 20
#: Common pre-tokens that are broadcast at most, their bytes at most, and the documents that they are sought in.
COMMON, COMMON_BYTES, COMMON_DOCS = 60_000, 64, 3_000
#: Rows of pre-tokens whose numbers of pieces go back together, by block.
GATHERED = 1 << 20
#: Marks that are tokenized apart from a letter before them.
MARKS = ".,;:!?|#*$%&"
#: Bytes that part the words of plain texts, and what goes before a word that begins a text or follows one of them.
PARTS = np.zeros(256, bool)
PARTS[[0x20, 0x0A]] = True
LEADS = (b"", b" ", b"\n")
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

SCHEMA = "block long, part string, code int, doc_id long, n_bytes long, known long, freq binary"
NAMES = ["block", "part", "code", "doc_id", "n_bytes", "known", "freq"]
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        special = [str(x.content) for x in t.get_added_tokens_decoder().values()]
        _TOKENIZERS[path] = (t, special)
    return _TOKENIZERS[path]


def plain(text: str, special: list[str]) -> bool:
    """Whether single spaces and line breaks between words are all the white space, and no special string is there."""
    return len(text.split()) == text.count(" ") + text.count("\n") + 1 and not any(s in text for s in special)


def pre_tokens(text: str, special: list[str]) -> list[str]:
    """Parts of text that are tokenized alone as they are within it."""
    parts = text.split(" ")
    parts[1:] = map(" ".__add__, parts[1:])
    if plain(text, special):
        return parts
    joined, odd_before = [], False
    for i, part in enumerate(parts):
        word = part[1:] if i else part
        odd = not word or word[0].isspace() or word[-1].isspace() or any(x in text for x in special)
        if joined and (odd_before or odd):
            joined[-1] += part
        else:
            joined.append(part)
        odd_before = odd
    return [p for p in joined if p]


@dataclass
class PlainWords:
    """Words of plain texts, in order, without the marks after a last letter, which are apart: no token spans the two.

    code and mark (-1: none) number the different ones, sizes are the words of each text. parts are the different words with what goes before them."""

    code: np.ndarray
    mark: np.ndarray
    sizes: np.ndarray
    parts: list[bytes]
    marks: list[str]


def stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that end in marks after a letter, and where the marks of each begin."""
    solid = np.arange(len(data), dtype=np.int32)
    solid[_MARK[data]] = -1
    np.maximum.accumulate(solid, out=solid)
    stem = np.maximum(solid[ends - 1] + 1, starts)
    one, two = data[stem - 1], data[stem - 2]
    letter = _LETTER[one] | ((stem - 2 >= starts) & (one >= 0x80) & (two >= 0xC3) & (two <= 0xC8) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))))
    cut = np.flatnonzero((stem > starts) & (stem < ends) & letter)
    return cut, stem[cut]


def plain_words(raw: list[bytes]) -> PlainWords:
    words = words_of(raw, PARTS)
    data, starts, ends = words.data, words.starts, words.ends
    lead = 1 + (data[starts - 1] == 0x0A)
    lead[words.first()[:-1][words.sizes > 0]] = 0
    cut, stem = stems(data, starts, ends)
    mark, marks = np.full(len(starts), -1), []
    if len(cut):
        mark[cut], different = numbered(data, stem, ends[cut])
        marks = [m.decode() for m in different.to_pylist()]
    last = ends.copy()
    last[cut] = stem
    code, different = numbered(data, starts, last)
    code = 3 * code + lead
    met = np.zeros(3 * len(different), bool)
    met[code] = True
    names = different.to_pylist()
    parts = [LEADS[i % 3] + names[i // 3] for i in np.flatnonzero(met).tolist()]
    return PlainWords((np.cumsum(met) - 1)[code], mark, words.sizes, parts, marks)


class _Block:
    """Documents of a block with the frequencies of their pre-tokens."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.raw: list[bytes] = []
        self.held = 0

    def add(self, doc: int | None, text: bytes) -> bool:
        """Whether the block is full."""
        self.docs.append(doc)
        self.raw.append(text)
        self.held += len(text)
        return len(self.docs) >= BLOCK_DOCS or self.held >= BLOCK_BYTES

    def frequencies(self, special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pre-tokens, and by document and pre-token: their numbers, and how often."""
        codes: dict[str, int] = {}
        even, odd, docs, found = [], [], [], []
        for i, text in enumerate(self.raw):
            if text:
                (even if plain(text.decode("utf-8"), special) else odd).append(i)
        for i in odd:
            parts = pre_tokens(self.raw[i].decode("utf-8"), special)
            found.append(np.fromiter((codes.setdefault(p, len(codes)) for p in parts), np.int64, count=len(parts)))
            docs.append(np.full(len(parts), i))
        if even:
            words = plain_words([self.raw[i] for i in even])
            base = np.array([codes.setdefault(p.decode("utf-8"), len(codes)) for p in words.parts])
            ends = np.array([codes.setdefault(m, len(codes)) for m in words.marks], np.int64)
            doc = np.repeat(np.array(even), words.sizes)
            marked = words.mark >= 0
            found += [base[words.code], ends[words.mark[marked]]]
            docs += [doc, doc[marked]]
        if not codes:
            none = np.zeros(0, np.int64)
            return [], none, none, none
        keys, counts = np.unique(np.concatenate(docs) * len(codes) + np.concatenate(found), return_counts=True)
        return list(codes), keys // len(codes), keys % len(codes), counts

    def rows(self, block: int, special: list[str], common: dict[str, int]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with the pieces of its common pre-tokens and the others' frequencies, then a row for each of the others."""
        parts, doc, code, count = self.frequencies(special)
        pieces = np.fromiter((common.get(p, 0) for p in parts), np.int64, count=len(parts))
        known = np.bincount(doc, pieces[code] * count, len(self.docs)).astype(np.int64)
        rare = pieces[code] == 0
        doc, code, count = doc[rare], code[rare], count[rare]
        # numbers and frequencies as pairs of 32-bit numbers, in bytes: Spark measures each row that it passes on, and lists take long
        starts = (8 * np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(self.docs)))))).astype(np.int32)
        n = len(self.docs)
        pairs = np.stack((code, count), 1).astype("<i4").tobytes()
        kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(pairs)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(self.docs, pa.int64()), pa.array([len(t) for t in self.raw], pa.int64()), pa.array(known), kept],
            NAMES,
        )
        names = pa.array(parts, pa.string())
        rest = np.flatnonzero(pieces == 0)
        for lo in range(0, len(rest), 50_000):
            here = rest[lo : lo + 50_000]
            n = len(here)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), names.take(pa.array(here)), pa.array(here.astype(np.int32)), *none], NAMES)


def _frequencies(batches: Iterator[pa.RecordBatch], path: str, common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    special = tokenizer(path)[1]
    number, block = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if block.add(doc, text):
                yield from block.rows(number, special, common)
                number, block = number + 1, _Block()
    if block.docs:
        yield from block.rows(number, special, common)


def _pieces(t, parts: list[str]) -> list[int]:
    return [len(e.ids) for e in t.encode_batch_fast(parts, add_special_tokens=False)]


def _listed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = batch.column("part")
        yield pa.RecordBatch.from_arrays([part, pa.array(_pieces(tokenizer(path)[0], part.to_pylist()), pa.int32())], ["part", "pieces"])


def common_pieces(docs: DataFrame, path: str) -> dict[str, int]:
    """Pieces of the pre-tokens that most blocks of a sample have, by documents of the sample: at most COMMON short ones."""
    met = sample(docs, COMMON_DOCS, "pieces|", "text").mapInArrow(tidy(lambda it: _in_documents(it, path)), "part string, df long")
    met = met.filter(F.octet_length("part") <= COMMON_BYTES).groupBy("part").agg(F.sum("df").alias("df"))
    top = met.filter("df > 1").orderBy(F.desc("df"), "part").limit(COMMON).select("part")
    return {r["part"]: r["pieces"] for r in top.mapInArrow(tidy(lambda it: _listed(it, path)), "part string, pieces int").collect()}


def _in_documents(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a batch, and how many of its documents have each."""
    for batch in batches:
        block = _Block()
        for text in texts(batch):
            block.add(None, text)
        parts, _, code, _ = block.frequencies(tokenizer(path)[1])
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.bincount(code, minlength=len(parts)))], ["part", "df"])


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, the low bytes of all before the higher ones, which are mostly zero and compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _by_block(block: np.ndarray, code: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """A row for each block: the differences of its pre-tokens' numbers, in order, then their pieces."""
    order = np.lexsort((code, block))
    block, code, pieces = block[order], code[order], pieces[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    steps = np.diff(code, prepend=0)
    steps[cuts] = code[cuts]
    ends = np.append(cuts[1:], len(block))
    packed = [_packed(np.concatenate((steps[a:b], pieces[a:b]))) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(packed, pa.binary())], ["block", "pieces"])


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(block, pieces): rows come sorted by pre-token, each is counted once for all blocks that have it; what GATHERED rows say to a block is one row."""
    t, _ = tokenizer(path)
    last, pieces = None, 0
    held, rows = [], 0
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        parts, at = part.dictionary.to_pylist(), part.indices.to_numpy()
        known = parts[:1] == [last]
        n = np.array([pieces] * known + _pieces(t, parts[known:]), np.int32)
        last, pieces = (parts[-1], int(n[-1])) if parts else (last, pieces)
        held.append((np.array(batch.column("block")), np.array(batch.column("code")), n[at]))  # copies, as the batch's texts would stay too
        rows += len(at)
        if rows >= GATHERED:
            yield _by_block(*map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0
    if rows:
        yield _by_block(*map(np.concatenate, zip(*held, strict=True)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, numbers of pieces before documents; those of one block are held."""
    now, pieces = None, np.zeros(0, np.int64)
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
        doc_id, n_bytes, tokens = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if block[a] != now:
                now, pieces = block[a], np.zeros(0, np.int64)
            part = batch.slice(a, b - a)
            first = len(part) - part.column("pieces").null_count
            if first:
                found = [_unpacked(x.as_buffer()).reshape(2, -1) for x in part.column("pieces").slice(0, first)]
                code, many = np.concatenate([np.cumsum(x) for x, _ in found]), np.concatenate([x for _, x in found])
                more = int(code.max()) + 1 - len(pieces)
                pieces = np.append(pieces, np.zeros(max(0, more), np.int64))
                pieces[code] = many
                part = part.slice(first)
            if len(part):
                freq = part.column("freq")
                offsets = np.frombuffer(freq.buffers()[1], np.int32)[freq.offset : freq.offset + len(freq) + 1]
                sizes = np.diff(offsets) // 8
                pairs = np.frombuffer(freq.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<i4").reshape(-1, 2)
                each = pieces[pairs[:, 0]] * pairs[:, 1]
                sums = np.concatenate(([0], np.cumsum(each)))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                tokens.append(sums[ends[1:]] - sums[ends[:-1]] + part.column("known").to_numpy())
                doc_id.append(part.column("doc_id"))
                n_bytes.append(part.column("n_bytes"))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(doc_id), pa.concat_arrays(n_bytes), pa.array(np.concatenate(tokens))], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text), by the tokenizers file at path.

    A null or empty text has 0 bytes and 0 tokens. Special strings in texts count as the tokenizer's one token, no other
    special tokens are added. Every row has its own count, also where a doc_id is null or repeats with another text.
    Other columns are ignored; an empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = docs.sparkSession.sparkContext.broadcast(common_pieces(docs, path))
    # a table: both branches below read it, and a block keeps its number whatever is lost
    blocks = written(docs.mapInArrow(tidy(lambda it: _frequencies(it, path, held.value)), SCHEMA))
    parts = blocks.filter("part is not null").select("part", "block", "code").repartition("part").sortWithinPartitions("part")
    pieces = parts.mapInArrow(tidy(lambda it: _counted(it, path)), "block long, pieces binary")
    rows = pieces.unionByName(blocks.filter("part is null").select("block", "doc_id", "n_bytes", "known", "freq"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions(F.expr("2 * block + if(pieces is null, 1, 0)"))  # by one number: Spark sorts these without comparing rows
    sums = rows.mapInArrow(tidy(_summed), "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
