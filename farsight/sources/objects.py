"""Large JSON objects read by many tasks.

A file with one object, id -> record, is read as text that ends at each closing brace, so Spark splits it by bytes in any store that it reads. What a part means depends on
what is before it: whether it starts inside a string, and how deep. Each part is summed up by how many quotes it has and by how its braces
change the depth from either start; sums per split, carried over the splits, then running sums within each give every part its start.
Records end where the depth comes back to one; their parts are put together and parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key in its quotes and what it stands for.
_ENTRY = r'(?s)^("(?:[^"\\]|\\.)*+")\s*:\s*(.*)$'


def _change(text: Column) -> Column:
    """Closing braces and brackets taken from opening ones, in text without strings."""
    return F.length(F.regexp_replace(text, "[^{\\[]", "")) - F.length(F.regexp_replace(text, "[^}\\]]", ""))


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, pos, part): the text of files up to each closing brace, without it; split and pos give its order in the file."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("part"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) for each entry of the JSON object in each file: value is the entry's JSON, an object. Keys and strings hold any characters; an empty object has no entries.

    What follows the last brace counts as if one closed it, which is below the object and changes nothing."""
    parts = parts_of(spark, path)
    plain = F.regexp_replace("part", r"\\.", "")
    # from a start outside of strings, and from one inside: what is before the first quote then is in the string
    out, inside = F.regexp_replace(plain, '"[^"]*("|$)', ""), F.regexp_replace(F.regexp_replace(plain, '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    odd = (quotes % 2).cast("int")
    sums = parts.select("file", "split", "pos", "part", odd.alias("odd"), _change(out).alias("d0"), _change(inside).alias("d1"))
    running = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("odd").over(running), F.lit(0)) % 2)
    # the depth that a part adds if its split starts outside of a string, and inside of one
    for s in (0, 1):
        start = (F.col("before") + s) % 2
        change = F.when(start == 0, F.col("d0")).otherwise(F.col("d1")) - F.when((start + F.col("odd")) % 2 == 0, 1).otherwise(0)  # the brace itself, outside of strings
        sums = sums.withColumn(f"c{s}", change)
    per_split = sums.groupBy("file", "split").agg((F.sum("odd") % 2).alias("odd"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))  # a row for each split
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_split.withColumn("s", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("c", F.when(F.col("s") == 0, F.col("c0")).otherwise(F.col("c1")))
    starts = starts.select("file", "split", "s", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("depth"))
    known = sums.join(starts, ["file", "split"]).withColumn("c", F.when(F.col("s") == 0, F.col("c0")).otherwise(F.col("c1")))
    upto = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("depth", F.col("depth") + F.sum("c").over(upto))
    after = (F.col("s") + F.col("before") + F.col("odd")) % 2
    ends = known.withColumn("end", ((after == 0) & (F.col("depth") == 1)).cast("int"))
    # a record is the parts after one end up to the next
    per_split = ends.groupBy("file", "split").agg(F.sum("end").alias("n"))
    first = per_split.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    records = ends.withColumn("n", F.coalesce(F.sum("end").over(running), F.lit(0))).join(first, ["file", "split"]).withColumn("record", F.col("first") + F.col("n"))
    whole = records.groupBy("file", "record").agg(F.max("end").alias("done"), F.array_sort(F.collect_list(F.struct("split", "pos", "part"))).alias("p"))  # the parts of one record
    text = F.concat(F.array_join(F.transform("p", lambda x: x["part"]), "}"), F.lit("}"))
    entry = F.regexp_replace(text, r"^\s*[{,]\s*", "")
    pair = [F.regexp_extract(entry, _ENTRY, i) for i in (1, 2)]
    key = F.from_json(F.concat(F.lit('{"k":'), pair[0], F.lit("}")), "k string")["k"]
    return whole.filter("done = 1").select("file", key.alias("key"), pair[1].alias("value"))


def read_relation_map(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One JSON object id -> record of the given schema, as a row for each record; qid is the record's own or else its key."""
    entries = read_entries(spark, path)
    r = F.from_json("value", T.StructType.fromDDL(record), {"mode": "FAILFAST"})
    return entries.select("key", r.alias("r")).select(F.coalesce("r.qid", "key").alias("qid"), *(F.col(f"r.{c}") for c in T.StructType.fromDDL(record).names if c != "qid"))
