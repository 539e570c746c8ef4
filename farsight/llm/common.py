"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.functions.workers import tidy

#: Words are maximal runs of anything but space and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
BREAK = "[\\x20\\x09-\\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


#: Whether a byte parts words.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of texts whose words are hashed together, about.
RUN_BYTES = 1 << 18

def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The bytes of each span of data; spans are in order and don't overlap."""
    if not len(starts):
        return pa.array([], pa.binary())
    begin = int(starts[0])
    edges = np.zeros(int(ends[-1]) - begin + 1, np.int8)
    edges[starts - begin] += 1
    edges[ends - begin] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[begin : int(ends[-1])][inside])])


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """The number of each span among the different ones, and these, told apart by their bytes."""
    found = spelled(data, starts, ends).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What flat has from each start, so much, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def hashed(words: pa.BinaryArray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, count=len(words))


def runs(sizes: list[int], most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of the given sizes, in order; a range ends once it has so many bytes."""
    at = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


#: Rows and bytes of the batches whose rows are merged together: as much as Spark's defaults put into one.
TOGETHER, TOGETHER_BYTES = 10_000, 64 << 20


def together(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER, most: int = TOGETHER_BYTES) -> Iterator[Iterator[pa.RecordBatch]]:
    """Batches in groups of about so many rows or bytes, however small a batch is. A group is read as it comes, and must be read before the next one."""
    batches = iter(batches)

    def group(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        count = held = 0
        while batch is not None:
            count, held = count + batch.num_rows, held + batch.nbytes
            yield batch
            batch = next(batches, None) if count < rows and held < most else None

    for first in batches:
        yield group(first)


@dataclass
class Words:
    """Words of some texts, one text after another: their bytes in data from starts to ends, and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray

    def numbered(self) -> tuple[np.ndarray, pa.BinaryArray]:
        return numbered(self.data, self.starts, self.ends)

    def hashes(self) -> np.ndarray:
        code, different = self.numbered()
        return hashed(different)[code]

    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.sizes)))


def words_of(raw: list[bytes], breaks: np.ndarray = BREAKS) -> Words:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    parts = breaks[data]
    edges = np.flatnonzero(parts[1:] != parts[:-1]) + 1
    if not parts[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
    return Words(data, starts, ends, np.diff(np.searchsorted(starts, begin)))


def hashed_words(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order; only one run of texts is worked on at a time."""
    for a, b in runs([len(t) for t in raw]):
        words = words_of(raw[a:b])
        yield from np.split(words.hashes(), words.first()[1:-1])


def grams(ids: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k neighbours in ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
    for j in range(k):
        out ^= ids[j : j + n]
        out *= _MIX
        out ^= out >> _SHIFT
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Rows by key: keys and values of a key's first row, how many others it has, and their values in that order.

    What a batch knows of a common key is then one row of the shuffle. Rows keep their order, in which
    neighbours are alike and compress."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = order[new]
    more = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
    back = np.argsort(first, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[back] = np.arange(len(first))
    rest = order[~new]
    rest = rest[np.argsort(np.repeat(rank, more), kind="stable")]
    return [k[first[back]] for k in keys], [v[first[back]] for v in values], more[back], [v[rest] for v in values]


def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of the given sizes, null if empty."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values, mask=pa.array(sizes == 0))


#: Bits of the table that tells which ids may be among others, whatever their number: 2**18 rows of 64 bits at most are broadcast.
ID_BITS = 1 << 24


def parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, ...) whose id may be among ids(doc_id), and those whose id isn't.

    A table of hashed ids tells them apart where they are read, so that the others need no shuffle to be told. Where ids are
    many for it, more rows than needed are in the first part; an exact join must follow there."""
    slot = F.expr(f"xxhash64(cast(doc_id as bigint)) & {ID_BITS - 1}L")
    marks = ids.select(slot.alias("__slot")).select(F.expr("__slot >> 6").alias("__word"), F.expr("shiftleft(1L, int(__slot & 63))").alias("__bit"))
    marks = F.broadcast(written(marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))))
    told = rows.withColumn("__slot", slot).withColumn("__word", F.expr("__slot >> 6")).join(marks, "__word", "left")
    may = F.expr("coalesce(__bits, 0L) & shiftleft(1L, int(__slot & 63))") != 0
    return tuple(told.filter(x).drop("__slot", "__word", "__bits") for x in (may, ~may))


def crc32_mod(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k: the fixed folds of the held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


#: Bytes of a text that a sample takes at most, and of all its texts; longer ones are left out of samples, not of results.
SAMPLE_BYTES, SAMPLE_TOTAL = 1 << 16, 1 << 25


def bounded(rows: DataFrame, n: int, *order: str, group: str | None = None) -> DataFrame:
    """The first n rows(text, ...) in this order, or as many as have SAMPLE_TOTAL bytes of text. With a group column each group is cut at the same share of its rows, so that none is lost."""
    share = F.lit(0.0)
    if group:
        own = Window.partitionBy(group)
        share = F.row_number().over(own.orderBy(*order)) / F.count("*").over(own)
    first = rows.withColumn("share", share).orderBy("share", *order).limit(n)
    held = F.sum(F.octet_length("text")).over(Window.orderBy("share", *order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("held", F.coalesce(held, F.lit(0))).filter(F.col("held") <= SAMPLE_TOTAL).drop("held", "share")


def sample(docs: DataFrame, n: int, salt: str, *columns: str, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most n rows of docs(doc_id, text) with texts of at most max_bytes, in an order by hash of doc_id, with the hash as `h`.

    Ids and hashes are ordered first; rows are counted again at the end, as ids may repeat."""
    h = F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    ids = short.select("doc_id", h.alias("h")).distinct().orderBy("h").limit(n)
    return bounded(short.select("doc_id", *columns).join(F.broadcast(ids), "doc_id"), n, "h", *columns)


def fitted(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """What fit makes of a bounded sample, which goes to one task; only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))])], ["model"])

    found = rows.coalesce(1).mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder in the warehouse, which must not lie on one machine of a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and warehouse.partition(":")[0] in (warehouse, "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"{warehouse}/_farsight"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


#: Lists that note the folders of tables written meanwhile.
_NOTED: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that no lost executor makes it run again. It stays, as what is made of it may be read later; `noted` tells where it is."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/farsight/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _NOTED[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables that `written` makes meanwhile."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.remove(paths)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, in any store. Whatever was made of their tables must have been written by now."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
