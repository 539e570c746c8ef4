"""Ranks of items among neutrals by similarity to a tag."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.functions.workers import tidy
from farsight.sources.shared import cut

#: Bytes of a block's vectors, pairs of a part of a tile, about, and ranges of similarity.
BLOCK_BYTES, TILE_PAIRS, LEVELS = 16 << 20, 1 << 20, 256


def capped(neutrals: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """First n - 1 neutrals of each (qid, tag) in an order by hash, before any vector is looked up."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", "tag", "neutral"))
    place = F.row_number().over(Window.partitionBy("qid", "tag").orderBy(h, "neutral"))
    return neutrals.withColumn("pos", place).filter(F.col("pos") < n)


def tag_similarities(pairs: DataFrame, bank: DataFrame, digits: int = 9) -> DataFrame:
    """pairs(tag, other, ...) whose two ids have vectors, with sim in place of these, by matrix products of tiles.

    Ids of any type are dealt into blocks by hash, so large that the vectors of two blocks fit in a task. A tile is a block of tags and one of others; it gets each
    vector that a pair of it needs once, however many pairs need it, and its pairs without vectors. A tile with many pairs, as a common tag makes, is cut into parts by
    the hash of the other id. A task holds the vectors of one part; its pairs stream by."""
    known = bank.select(F.col("qid").alias("id"), F.transform("embedding", lambda x: x.cast("float")).alias("v")).filter("v is not null")
    n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-4 * n * (width or 1) // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = cut(pairs.withColumns({"__t": block("tag"), "__o": block("other")}))  # small without vectors, and read four times
    parts = dealt.groupBy("__t", "__o").agg(F.ceil(F.count("*") / F.lit(TILE_PAIRS)).cast("int").alias("__parts"))  # blocks^2 rows
    dealt = dealt.join(parts, ["__t", "__o"]).withColumn("__p", F.pmod(F.xxhash64("other", F.lit(7)), F.col("__parts")).cast("int")).drop("__parts")
    place = ["__t", "__o", "__p"]
    needed = [dealt.select(*place, F.lit(kind).alias("__k"), F.col(c).alias("id")).distinct() for kind, c in ((0, "tag"), (1, "other"))]
    vectors = needed[0].unionByName(needed[1]).join(known, "id").select(*place, "__k", F.col("id").alias("tag"), F.lit(None).cast(pairs.schema["other"].dataType).alias("other"), "v")
    extra = [c for c in pairs.columns if c not in ("tag", "other")]
    rows = dealt.withColumns({"__k": F.lit(2), "__x": F.struct(*(extra or [F.lit(0).alias("none")])), "v": F.lit(None).cast("array<float>")})
    rows = rows.select(*place, "__k", "tag", "other", "__x", "v").unionByName(vectors, allowMissingColumns=True)
    rows = rows.repartition(*place).sortWithinPartitions(*place, "__k")
    out = T.StructType([rows.schema["tag"], rows.schema["other"], rows.schema["__x"], T.StructField("sim", T.DoubleType())])
    sims = rows.mapInArrow(tidy(lambda it: _tiles(it, digits)), out)
    return sims.select(*(F.col(f"__x.{c}") if c in extra else c for c in pairs.columns), "sim")


class _Side:
    """Ids of one side of a tile and their vectors, as they came: 32 bits an entry, and an index of ids without an object for each where they are numbers."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray]):
        self.index = pd.Index(np.concatenate(ids) if ids else [])
        self.vectors = np.concatenate(vectors) if vectors else np.zeros((0, 0), np.float32)
        last = ~self.index.duplicated("last")
        if not last.all():
            self.index, self.vectors = self.index[last], self.vectors[last]

    @staticmethod
    def values(ids: pa.Array) -> np.ndarray:
        if pa.types.is_integer(ids.type):
            return ids.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.empty(len(ids), object)
        out[:] = ids.to_pylist()
        return out

    def places(self, ids: pa.Array) -> np.ndarray:
        """The number of each id's vector, -1 if there is none."""
        if not len(self.index):
            return np.full(len(ids), -1)
        at = self.index.get_indexer(pd.Index(self.values(ids)))
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, at)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.float64)


def _tiles(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile: vectors of tags, vectors of others, then pairs."""
    now = None
    ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # by side
    vectors: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    sides: list[_Side] = []
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in ("__t", "__o", "__p", "__k")], 1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            if a == b:
                continue
            *tile, kind = place[a].tolist()
            if tile != now:
                now, ids, vectors, sides = tile, ([], []), ([], []), []
            part = batch.slice(a, b - a)
            if kind < 2:
                ids[kind].append(_Side.values(part.column("tag")).copy())
                vectors[kind].append(part.column("v").flatten().to_numpy().reshape(b - a, -1).copy())
                continue
            if not sides:
                sides = [_Side(*side) for side in zip(ids, vectors, strict=True)]
                ids, vectors = ([], []), ([], [])
            at = [side.places(part.column(c)) for c, side in zip(("tag", "other"), sides, strict=True)]
            good = np.flatnonzero((at[0] >= 0) & (at[1] >= 0))
            one, two = at[0][good], at[1][good]
            tags, code = np.unique(one, return_inverse=True)
            if len(good) * 4 >= len(tags) * len(sides[1].vectors) > 0:  # most entries of the product are wanted
                sim = (sides[0].rows(tags) @ sides[1].vectors.astype(np.float64).T)[code, two]
            else:
                sim = np.einsum("ij,ij->i", sides[0].rows(one), sides[1].rows(two)) if len(good) else np.zeros(0)
            kept = part.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("tag"), kept.column("other"), kept.column("__x"), pa.array(np.round(sim, digits) + 0.0)], ["tag", "other", "__x", "sim"])


def ranks(edges: DataFrame, neutrals: DataFrame, bank: DataFrame, orders: list[int]) -> DataFrame:
    """(qid, tag, n, rank, sample_size) for edges(qid, tag), neutrals(tag, neutral, pos) and every n of orders.

    rank is 1 + the neutrals among the first n - 1 that are more like the tag than the item is; sample_size is 1 + those
    found. A tag's similarities are computed once and serve all its items and all orders. Pairs
    without a vector are left out; neutrals without one are skipped."""
    sims = tag_similarities(neutrals.filter(F.col("pos") < max(orders)).select("tag", F.col("neutral").alias("other"), "pos"), bank)
    own = tag_similarities(edges.select("tag", F.col("qid").alias("other")), bank).select("tag", F.col("other").alias("qid"), F.col("sim").alias("s0"))
    lists = sims.groupBy("tag").agg(F.collect_list(F.struct("pos", "sim")).alias("sims"))  # max(orders) - 1 entries at most
    joined = own.join(lists, "tag", "left").withColumn("n", F.explode(F.array(*map(F.lit, orders))))
    sims = F.coalesce("sims", F.array().cast("array<struct<pos:int,sim:double>>"))
    near = F.filter(sims, lambda s: s["pos"] < F.col("n"))
    return joined.select(
        "qid", "tag", "n",
        (F.size(F.filter(near, lambda s: s["sim"] > F.col("s0"))) + 1).alias("rank"),
        (F.size(near) + 1).alias("sample_size"),
    )


def sweep(edges: DataFrame, neutrals: DataFrame, banks: dict[str, DataFrame], orders: list[int]) -> DataFrame:
    """ranks for every retriever's bank and every order, with `retriever` (W4). Each retriever's similarities are computed once for all orders; edges and neutrals are written once and serve all retrievers."""
    edges, neutrals = cut(edges), cut(neutrals.filter(F.col("pos") < max(orders)))
    found = [ranks(edges, neutrals, bank, orders).select(F.lit(name).alias("retriever"), "*") for name, bank in banks.items()]
    return reduce(DataFrame.unionByName, found)


def by_first(results: DataFrame, value: str, first: int) -> DataFrame:
    """results(retriever, n, ...) with `place`: of the retriever by its value at the first order, highest first, missing last, then by name (P3). There is a row for each retriever in the order."""
    names = results.groupBy("retriever").agg(F.max(F.when(F.col("n") == first, F.col(value))).alias("v"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "retriever"))
    return results.join(F.broadcast(names.select("retriever", place.alias("place"))), "retriever")


def block_ranks(edges: DataFrame, neutrals: DataFrame, bank: DataFrame, n: int) -> DataFrame:
    """(qid, tag, rank, sample_size) for one order, by counts of greater similarities that are merged (M3).

    A tag's items and neutrals meet by similarity alone: each item's place among its tag's neutrals comes from counts over both, dealt into ranges of similarity, so that
    neither a common tag's items nor its neutrals are one row or one task. Ids are of any type."""
    others = tag_similarities(neutrals.filter(F.col("pos") < n).select("tag", F.col("neutral").alias("other")), bank).select("tag", "sim")
    own = tag_similarities(edges.select("tag", F.col("qid").alias("other")), bank).select("tag", F.col("other").alias("qid"), "sim")
    level = F.floor((1 - F.col("sim")) * LEVELS / 2)  # the most similar first; any vectors, unit ones spread best
    others, own = others.withColumn("r", level), own.withColumn("r", level)
    counts = others.groupBy("tag", "r", "sim").agg(F.count("*").alias("c"))
    by_range = counts.groupBy("tag", "r").agg(F.sum("c").alias("c"))
    ranges = own.select("tag", "r").distinct().join(by_range.select("tag", F.col("r").alias("s"), "c"), "tag", "left")  # LEVELS ranges at most of each side
    above = ranges.groupBy("tag", "r").agg(F.coalesce(F.sum(F.when(F.col("s") < F.col("r"), F.col("c"))), F.lit(0)).alias("above"), F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    values = own.select("tag", "r", "sim").distinct().join(counts.select("tag", "r", F.col("sim").alias("x"), "c"), ["tag", "r"], "left")
    inside = values.groupBy("tag", "r", "sim").agg(F.coalesce(F.sum(F.when(F.col("x") > F.col("sim"), F.col("c"))), F.lit(0)).alias("inside"))
    placed = inside.join(above, ["tag", "r"]).select("tag", "sim", (F.col("inside") + F.col("above") + 1).cast("int").alias("rank"), (F.col("all") + 1).cast("int").alias("sample_size"))
    return own.join(placed, ["tag", "sim"]).select("qid", "tag", "rank", "sample_size")


def wide(ranked: DataFrame) -> DataFrame:
    """Export form: for each qid and order the list of ranks by tag (the long table keeps the tags)."""
    orders = [r["n"] for r in ranked.select("n").distinct().orderBy("n").collect()]
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == n, F.struct("tag", "rank")))), lambda x: x["rank"]).alias(f"rank_among_unrelevant_tags_{n}") for n in orders]
    return ranked.groupBy("qid").agg(*lists)
