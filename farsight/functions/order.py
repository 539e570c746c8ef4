"""Dense numbers in the order of ids of any type, and first rows in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.sources.shared import cut

#: Ids that one task numbers, about, and the most ranges.
RANGE, RANGES = 100_000, 4096


def range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most value, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s, _):
        after = F.get(F.lit(bounds), middle(s)) <= value
        return F.when(s["lo"] >= s["hi"], s).when(after, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s["lo"])


def ordered(nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, idx): distinct ids that aren't null, numbered from 0 in their order.

    Many ids are dealt to tasks by range, where they are numbered as they stand sorted, and written once, so that the counts that tell where each range starts are those of the same ranges."""
    ids = nodes.select(F.col(node).alias("node")).filter("node is not null").distinct()
    ranges = min(RANGES, ids.count() // RANGE)
    if ranges < 2:
        return ids.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("idx"))
    at = F.monotonically_increasing_id()  # the task's number, then the row's place in it
    ids = cut(ids.repartitionByRange(ranges, "node").sortWithinPartitions("node").withColumn("at", at)).select("node", F.shiftright("at", 33).alias("r"), F.col("at").bitwiseAND((1 << 33) - 1).alias("n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    counts = ids.groupBy("r").count().select("r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return ids.join(F.broadcast(counts), "r").select("node", (F.col("before") + F.col("n")).alias("idx"))


def placed(df: DataFrame, hash_: str, key: str, group: list[str]) -> DataFrame:
    """df with `__r`: the place from 1 of each row in its group, in the order of a hash column of hexadecimal digits, then of key.

    Places come from counts per hash prefix, so that no task orders a group."""
    rows = df.withColumn("__p", F.substring(hash_, 1, 3))
    counts = rows.groupBy(*group, "__p").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__b"))
    same = " and ".join(["__p = __q", *(f"`{g}` <=> __g{i}" for i, g in enumerate(group))])
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*group, "__p").orderBy(hash_, key)))
    return ranked.join(starts, F.expr(same)).withColumn("__r", F.col("__b") + F.col("__i")).select(*df.columns, "__r")
