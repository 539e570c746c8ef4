"""Reproducible neutral samples: ids that aren't related to a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farsight.functions.order import ordered
from farsight.sources.shared import cut


def draw(target: str, j: str, seed: int, size: str) -> str:
    """Number of the j-th draw for a target of any type, below size: 48 bits of a hash."""
    return f"cast(conv(substr(md5(concat_ws('|', '{seed}', {target}, {j})), 1, 12), 16, 10) as bigint) % {size}"


def neutral_sample(targets: DataFrame, nodes: DataFrame, related: DataFrame, order: int, seed: int = 1, draws: int = 3) -> DataFrame:
    """(target, neutral, pos): up to `order` different nodes for each of targets(target), none of them itself or in related(target, node). Ids are of any type.

    Each target makes draws * order numbered draws from the dense index of nodes; unsuitable and repeated ones are
    dropped and the first `order` stay. Draws and related ids meet in one grouping, and each target then is one row with what it found, written once. Targets still short of
    min(order, |nodes| - |related| - 1) go on along the index from their draw 0, over as many nodes as they lack and have to leave out."""
    idx = ordered(nodes)
    size = idx.count()
    if not size:
        return targets.select("target", F.col("target").alias("neutral"), F.lit(1).alias("pos")).limit(0)
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # ids are small, their draws are not
    asked = targets.select("target").filter("target is not null").repartition(tasks, "target").distinct()
    drawn = asked.select("target", F.explode(F.sequence(F.lit(1), F.lit(draws * order))).alias("j"))
    drawn = drawn.withColumn("idx", F.expr(draw("target", "j", seed, str(size)))).join(idx, "idx").select("target", "node", "j", F.lit(0).alias("out"))
    known = related.select(F.col("target").cast(asked.schema["target"].dataType).alias("target"), F.col("node").alias("__n")).filter("target is not null")
    known = known.join(idx, F.col("__n") == F.col("node")).select("target", "node").unionByName(asked.join(idx, F.col("target") == F.col("node")).select("target", "node"))
    met = drawn.unionByName(known.select("target", "node", F.lit(None).cast("int").alias("j"), F.lit(1).alias("out"))).groupBy("target", "node").agg(F.min("j").alias("j"), F.max("out").alias("out"))
    found = F.array_sort(F.collect_list(F.when((F.col("out") == 0), F.struct("j", "node"))))  # draws * order at most
    by = met.groupBy("target").agg(F.sum("out").alias("out"), F.count("j").alias("asked"), found.alias("found")).filter("asked > 0")
    by = cut(by.select("target", "out", F.transform(F.slice("found", 1, order), lambda x: x["node"]).alias("found")))
    first = by.select("target", F.posexplode("found").alias("pos", "neutral")).select("target", "neutral", (F.col("pos") + 1).alias("pos"))
    short = by.withColumn("have", F.size("found")).withColumn("want", F.least(F.lit(order), F.lit(size) - F.col("out"))).filter("have < want")
    if short.isEmpty():
        return first
    steps = F.sequence(F.lit(0), F.least(F.lit(size), F.col("want") + F.col("out")).cast("int") - 1)
    rest = short.withColumn("k", F.explode(steps)).withColumn("idx", (F.expr(draw("target", "0", seed, str(size))) + F.col("k")) % size).join(idx, "idx").filter("node <> target")
    rest = rest.filter(~F.array_contains("found", F.col("node"))).join(related.select("target", "node"), ["target", "node"], "left_anti")
    rest = rest.withColumn("i", F.row_number().over(Window.partitionBy("target").orderBy("k"))).filter("have + i <= want")
    return first.unionByName(rest.select("target", F.col("node").alias("neutral"), (F.col("have") + F.col("i")).cast("int").alias("pos")))


def sample_ids(ids: DataFrame, n: int, seed: int = 1, key: str = "id") -> DataFrame:
    """n different ids in an order by hash."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return ids.select(key).distinct().withColumn("h", h).orderBy("h", key).limit(n).select(key)
