"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents in a permuted order, cut into blocks of words. Its target is a quota of blocks: whole passes over the stream, and
of one more pass as many blocks as are missing, the last of them cut. In each pass the blocks have a permuted order of their own,
a bijection worked out block by block. A tree over the output shards splits the quotas exactly: at each
node the share of the left half is one draw from the multivariate hypergeometric distribution over sources. A
shard draws disjoint ranges of the permuted blocks, and its rows are shuffled within it.
Places in a stream come from sums per (source, hash prefix), so that no task holds a source."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import BREAK, WORD, documents

WEIGHTS = (5, 2, 1)
#: Times its own size that a source is used at most.
REPEATS = 3
#: Words of a block at least; blocks of a mix, about: exact draws are made from less than a thousand million.
BLOCK_WORDS, BLOCKS = 1024, 1 << 29
#: Shards at least, and words of a shard, about.
SHARDS, SHARD_WORDS = 16, 1 << 26
#: Documents of a source's hash prefix, about.
PART = 1 << 16
#: What is known of a source before its documents are placed.
PLAN = pa.schema([
    ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("blocks", pa.int64()), ("salt", pa.string()),
    ("turns", pa.list_(pa.list_(pa.int64()))), ("quota", pa.int64()), ("cut", pa.int64()), ("bounds", pa.list_(pa.int64())),
])
#: Rounds in which the permutation of blocks swaps pairs.
ROUNDS = 4


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; a share stops at repeats times its size, the excess is shared again."""
    total, out = sum(sizes), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    capped, weight = 0, sum(weights)
    for at, i in enumerate(order):
        level = (total - capped) / weight
        if repeats * sizes[i] > level * weights[i]:
            for j in order[at:]:
                out[j] = level * weights[j]
            break
        out[i] = float(repeats * sizes[i])
        capped, weight = capped + repeats * sizes[i], weight - weights[i]
    return out


def split_quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns sum to blocks, rows differ by one at most."""
    out = np.zeros((shards, len(blocks)), np.int64)
    rng = np.random.Generator(np.random.Philox(seed))

    def split(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        share = int(quota.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(quota, share, method="marginals")
        split(lo, mid, left)
        split(mid, hi, quota - left)

    if blocks:
        split(0, shards, np.array(blocks, np.int64))
    return out


def block_size(words: int, least: int) -> int:
    """Words of a block: `least`, or as many as keep the mix within BLOCKS blocks."""
    return max(least, -(-words // BLOCKS))


def keys(seed: int, source: int, turn: int, n: int) -> list[int]:
    """Numbers that make the permutation of n blocks for one pass of a source: factor, shift, and what each round's pairs add up to."""
    draw = lambda name: int(hashlib.md5(f"{seed}|{source}|{turn}|{name}".encode()).hexdigest()[:15], 16) % max(n, 1)
    factor = max(draw("factor"), 1)
    while math.gcd(factor, n) > 1:
        factor += 1
    return [factor, draw("shift"), *(draw(f"round {i}") for i in range(1, ROUNDS + 1))]


def place(block: int, n: int, salt: str, turn: int, k: list[int]) -> int:
    """Place of a block in the order of a pass: a bijection of 0 to n - 1. PLACE is the same in SQL."""
    x = (k[0] * block + k[1]) % n
    for i in range(1, ROUNDS + 1):
        y = (k[1 + i] - x) % n
        if ord(hashlib.md5(f"{salt}|{turn}|{i}|{max(x, y)}".encode()).hexdigest()[0]) % 2:
            x = y
    return x


PLACE = f"""aggregate(sequence(1, {ROUNDS}), pmod(turns[r][0] * j + turns[r][1], blocks), (x, i) -> if(
    ascii(md5(concat_ws('|', salt, r, i, greatest(x, pmod(turns[r][1 + i] - x, blocks))))) % 2 = 1, pmod(turns[r][1 + i] - x, blocks), x))"""


def quota(size: int, whole: int, block: int, last_place: int) -> tuple[int, int]:
    """Blocks that give `whole` words of a stream of `size` words, and how many words of the last drawn; last_place is that of the short block in the pass drawn in part."""
    n = -(-size // block)
    full, rest = divmod(whole, size) if size else (0, 0)
    if not rest:
        return full * n, block
    lacks = n * block - size
    words = lambda k: k * block - (lacks if last_place < k else 0)
    q = -(-rest // block)
    q += words(q) < rest
    return full * n + q, rest - words(q - 1)


def place_hash(seed: int = 1) -> Column:
    """Place of a row in its source's order, by its id and text."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int | None = None, seed: int = 1, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws, h) for each row of docs(doc_id, source, text).

    size is the number of words (null: 0), target the words due to the source, taken the words of the document in the mix,
    repeats counted: from 0 to 3 times its size. draws lists (pass, first word, words, shard, order): words drawn
    from the text, the shard that drew them and their place there; h finds the text. Sources by code point, null last, have the given weights in turn. Each source's taken
    words are its target, rounded. One row per source is collected (names and sums). Documents without words
    have no draws; rows with equal id and text have one place in the order, one after another. Null ids and sources are values like others, other columns are
    ignored, an empty table gives an empty one. shards is SHARDS, or more for a mix of many words."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    narrow = docs.select("doc_id", "source", size.alias("size"), place_hash(seed).alias("h"))
    digits = 3
    while docs.count() > PART * 16**digits and digits < 8:
        digits += 1
    narrow = narrow.withColumn("part", F.substring("h", 1, digits))
    parts = narrow.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sums = parts.groupBy("source").agg(F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [int(r["words"]) for r in sums]
    due = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    whole = [min(round(t), REPEATS * s) for t, s in zip(due, sizes, strict=True)]
    block_words = block_size(sum(whole), block_words)
    shards = shards or max(SHARDS, -(-sum(whole) // SHARD_WORDS))
    rows, drawn = [], []
    for i, (r, s, t, w) in enumerate(zip(sums, sizes, due, whole, strict=True)):
        n, salt = -(-s // block_words), f"{seed}|{i}"
        turns = [keys(seed, i, turn, n) for turn in range(REPEATS)]
        part = w // s if s else 0
        last = place(n - 1, n, salt, part, turns[part]) if n and part < REPEATS else n
        q, cut = quota(s, w, block_words, last)
        drawn.append(q)
        rows.append([r["source"], s, t, n, salt, turns, q, cut])
    bounds = np.concatenate((np.zeros((1, len(rows)), np.int64), np.cumsum(split_quotas(drawn, shards, seed), axis=0)))
    columns = [*zip(*((*row, bounds[:, i].tolist()) for i, row in enumerate(rows)), strict=True)] or [[]] * len(PLAN)
    plan = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, PLAN, strict=True)], PLAN))  # rows of Python would start workers, which stay
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("n")
    placed = placed.join(starts.alias("s"), F.expr("n.source <=> s.source and n.part = s.part")).select("n.*", F.expr("s.before + n.inside").alias("o"))
    placed = placed.alias("n").join(plan.withColumnRenamed("source", "__source"), F.expr("source <=> __source"))
    of_blocks = f"""
      transform(sequence(o div {block_words}, (o + size - 1) div {block_words}), j -> named_struct('pass', r, 'j', j, 'at', r * blocks + {PLACE}))"""
    found = F.when(F.col("size") > 0, F.expr(f"filter(flatten(transform(sequence(0, {REPEATS - 1}), r -> {of_blocks})), x -> x.at < quota)"))
    # down the splitting tree to the shard whose range has the block
    shard = f"""aggregate(sequence(1, {max(1, math.ceil(math.log2(max(shards, 2))))}), named_struct('lo', 0, 'hi', {shards}), (s, i) -> if(
        x.at >= bounds[(s.lo + s.hi) div 2], named_struct('lo', int((s.lo + s.hi) div 2), 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2))), s -> s.lo)"""
    end = f"least(o + size, if(x.at = quota - 1, x.j * {block_words} + cut, (x.j + 1) * {block_words}))"
    draws = F.expr(f"""
      filter(transform(found, x -> named_struct('pass', x.pass, 'first', greatest(x.j * {block_words} - o, 0L), 'words', {end} - greatest(x.j * {block_words}, o),
        'shard', {shard}, 'order', xxhash64(salt, x.at, {seed}))), d -> d.words > 0)""")
    none = F.array().cast("array<struct<pass: int, first: bigint, words: bigint, shard: int, order: bigint>>")
    placed = placed.withColumn("found", found).withColumn("draws", F.coalesce(draws, none)).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "draws", "h")


def drawn_texts(docs: DataFrame, mixed: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs, once for each pass and shard that draws from them, with the drawn words in their order. Shards are written one after another within tasks, each shuffled."""
    taken = mixed.filter("taken > 0").groupBy(F.col("h").alias("__h"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    taken = taken.agg(F.collect_list(F.transform("draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), d["first"].alias("first"), d["words"].alias("words"), d["order"].alias("order")))).alias("__copies"))
    taken = taken.select("*", F.posexplode("__copies").alias("__copy", "__draws")).drop("__copies")
    taken = taken.withColumn("__x", F.explode(F.expr("array_distinct(transform(__draws, d -> named_struct('pass', d.pass, 'shard', d.shard)))")))
    own = F.expr("array_sort(transform(filter(__draws, d -> d.pass = __x.pass and d.shard = __x.shard), d -> named_struct('first', int(d.first), 'words', int(d.words), 'order', d.order)))")
    taken = taken.select("__h", "__source", "__size", "__x", own.alias("__own"))
    once = docs.withColumn("__k", place_hash(seed)).withColumn("__nth", F.row_number().over(Window.partitionBy("__k", "source").orderBy("__k"))).filter("__nth = 1")
    rows = once.join(taken, F.expr("__k = __h and source <=> __source"))
    words = F.filter(F.split("text", BREAK), lambda w: w != "")
    drawn = F.expr("flatten(transform(__own, d -> slice(__words, d.first + 1, d.words)))")
    whole = F.expr("aggregate(__own, 0L, (a, d) -> a + d.words)") >= F.col("__size")
    rows = rows.withColumn("__words", F.when(~whole, words))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(drawn, " "))
    rows = rows.withColumn("text", text).withColumn("__order", F.expr("__own[0].order"))
    return rows.repartition("__x.shard").sortWithinPartitions("__x.shard", "__order", "__k").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "draws")
