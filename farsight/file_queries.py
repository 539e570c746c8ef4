"""Registered queries that go through files: readers, sinks, published tables and streams, on rows of the given tables, and their SQL.

Each writes its rows to a folder of its own in the shared place and reads them back as the feature does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.functions import vectors as V
from farsight.operators import clean, encode, sampling
from farsight.sources import tables, versions
from farsight.sources.shared import scratch
from farsight.streaming import incremental


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- readers and sinks ----------------------------------------------------------------------------------------------


def item_lines(spark, d):
    """Items as lines, one half as gzip, the other appended plain; read back by glob and dealt anew."""
    path = scratch(spark)
    items = table(spark, d, "part").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_name").alias("label"), F.split("p_name", " ").alias("related_tags"), "p_partkey")
    tables.write_json_lines(items.filter("p_partkey % 2 = 0").drop("p_partkey"), path, gzip=True)
    tables.write_json_lines(items.filter("p_partkey % 2 = 1").drop("p_partkey"), path, append=True)
    return tables.read_json_lines(spark, path, tables.ITEM_V1, glob="*.json*", spread=8).select("qid", "label", F.array_join("related_tags", "|").alias("tags"))


def skipped_lines(spark, d):
    """Lines of which every seventh is broken: how many are read and how many are bad."""
    path = scratch(spark)
    good = F.to_json(F.struct(F.concat(F.lit("Q"), "o_orderkey").alias("qid"), F.col("o_orderpriority").alias("label")))
    table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('{"qid": '), "o_orderpriority")).otherwise(good).alias("value")).write.text(path)
    read = tables.read_json_lines(spark, path, "qid string, label string", strict=False).agg(F.count("qid").alias("good"))
    return read.join(tables.bad_lines(spark, path, "qid string, label string"))


def first_lines(spark, d):
    """First event of each type in the order of files and lines."""
    path = scratch(spark)
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    tables.write_in_order(e, path)
    read = tables.read_json_lines(spark, path, "label string, id long", with_file=True)
    return clean.keep_first_canonical(read).select("label", F.col("id").alias("event_id"))


def relation_map(spark, d):
    """Objects of some hundred suppliers each, a file each, read by many tasks."""
    path = scratch(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, d, "supplier").join(n, "s_nationkey")
    tag = F.struct(F.concat(F.lit("N"), "s_nationkey").alias("qid"), F.col("n_name").alias("label"))
    record = F.struct(F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Q"), "s_suppkey")).alias("qid"), F.concat_ws('"} {', "s_name", "n_name").alias("label"), F.array(tag).alias("related_tags"))
    entry = F.struct(F.concat(F.lit("K"), "s_suppkey"), record)
    s.groupBy(F.floor(F.col("s_suppkey") / 300).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.partitionBy("file").text(path)
    return tables.read_relation_map(spark, f"{path}/*").select("qid", "label", F.array_join(F.transform("related_tags", lambda t: F.concat_ws("=", t["qid"], t["label"])), ",").alias("tags"))


def turn_pairs(spark, d):
    path = scratch(spark)
    c = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("label"), F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise("  ").alias("context"))
    tables.write_json_lines(c, path)
    return tables.read_pairs(spark, path).select("label", F.md5("context").alias("context"))


def bank_file(spark, d):
    path = scratch(spark)
    table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("t"), "vec_id").alias("text"), V.doubles("embedding").alias("embedding")).write.parquet(path)
    return tables.read_bank(spark, path).select("qid", "text", F.size("embedding").cast("long").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


def rank_files(spark, d):
    """Ranks of two orders, one of them at the legacy place only."""
    new, old = scratch(spark), scratch(spark)
    li = table(spark, d, "lineitem").select(F.concat(F.lit("Q"), "l_partkey").alias("qid"), F.concat(F.lit("S"), "l_suppkey").alias("tag"), F.col("l_linenumber").cast("int").alias("rank"), F.lit(50).alias("sample_size"), "l_orderkey")
    li.filter("l_orderkey % 3 = 0").drop("l_orderkey").write.parquet(f"{new}/retriever=x/n=10")
    li.filter("l_orderkey % 3 = 1").drop("l_orderkey").write.parquet(f"{old}/retriever=x/n=10")
    li.filter("l_orderkey % 3 = 2").drop("l_orderkey").write.parquet(f"{old}/retriever=x/n=20")
    r = tables.read_ranks(spark, [new, old], [("x", 10), ("x", 20)])
    return r.groupBy("n", "tag").agg(F.count("*").alias("rows"), F.sum("rank").alias("ranks")).select(F.col("n").cast("long").alias("n"), "tag", "rows", "ranks")


def page_file(spark, d):
    """The fourth page of a hundred customers' orders."""
    path = scratch(spark)
    tables.write_pages(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 25, path)
    return tables.read_page(spark, path, "o_custkey", 3)


def next_rows(spark, d):
    """The 20 customers after the fiftieth."""
    return tables.after_key(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 20)


def split_files(spark, d):
    """Runs of 200 orders as splits, those with an error apart."""
    path = scratch(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "late").alias("_error"))
    tables.write_splits(sampling.range_splits(o, "o_orderkey", 200), path)
    items, failed = spark.read.schema("o_orderkey long, split long").json(f"{path}/items"), spark.read.schema("o_orderkey long").json(f"{path}/failed")
    return items.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")).join(failed.agg(F.count("*").alias("failed")))


def page_cache(spark, d):
    path = scratch(spark)
    docs = table(spark, d, "documents")
    tables.write_cache(docs.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("text")).otherwise(" \n").alias("wikipedia_first_paragraph")), path)
    return spark.read.schema("doc_id long, wikipedia_first_paragraph string").json(path).select("doc_id", F.md5("wikipedia_first_paragraph").alias("paragraph"))


def bank_growth(spark, d):
    """A bank of every third document's text that gets the others'."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text")
    bank = encode.embed(docs.filter("qid % 3 = 0"), "text").select("qid", "text", "embedding")
    grown = encode.extend_bank(bank, docs)
    return grown.select("qid", F.md5("text").alias("text"), F.size("embedding").cast("long").alias("width"))


# --- published tables -----------------------------------------------------------------------------------------------


def published_tables(spark, d):
    """Three versions of two tables; readers get both of the last one."""
    root = scratch(spark)
    for times in (1, 2, 3):
        s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * times).cast("long").alias("v"))
        versions.publish(spark, root, {"items": s, "counts": s.groupBy("v").agg(F.count("*").alias("n"))})
    items, counts = (versions.read_table(spark, root, name) for name in ("items", "counts"))
    return items.join(counts, "v").select("s_suppkey", "v", "n")


def compacted_splits(spark, d):
    """Splits that come in two lots, merged after each."""
    parts, root = scratch(spark), scratch(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    for lot in (0, 1):
        c.filter(f"c_custkey % 2 = {lot}").write.json(f"{parts}/{lot}")
        versions.compact(spark, parts, root, "c_custkey long, c_name string")
    return versions.read_table(spark, root, "items")


# --- streams --------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, df: DataFrame, columns: str) -> DataFrame:
    path = scratch(spark)
    df.repartition(6).write.json(path)
    return incremental.read_stream(spark, path, columns, files=2)


def streamed_ids(spark, d):
    """Users of events as a set, over several batches and two runs."""
    sink, checkpoint = scratch(spark), scratch(spark)
    stream = _stream(spark, table(spark, d, "events").select(F.when(F.col("event_id") % 50 > 0, F.col("user_id")).alias("qid")), "qid long")
    for _ in range(2):
        incremental.into_set(stream, sink, checkpoint).awaitTermination()
    return incremental.committed(spark, sink, stream.schema).select("qid")


def streamed_labels(spark, d):
    """Names of customers as their orders arrive, each looked up once, without those that a seed cache has."""
    sink, checkpoint = scratch(spark), scratch(spark)
    names = table(spark, d, "customer").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("label"))
    stream = _stream(spark, table(spark, d, "orders").select(F.col("o_custkey").alias("qid")), names.select("qid").schema.simpleString()[7:-1].replace(":", " "))
    incremental.label_missing(stream, names, sink, checkpoint, seed=names.filter("qid % 7 = 0")).awaitTermination()
    return incremental.committed(spark, sink, names.schema).select("qid", "label")


def streamed_scores(spark, d):
    sink, checkpoint = scratch(spark), scratch(spark)
    stream = _stream(spark, table(spark, d, "events").select("event_id", "value"), "event_id long, value double")
    incremental.scored(stream, lambda s: s.select("event_id", F.round(V.sigmoid(F.col("value") / 50 - 1), 6).alias("score")), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


QUERIES = {
    f.__name__: f
    for f in (
        item_lines, skipped_lines, first_lines, relation_map, turn_pairs, bank_file, rank_files, page_file, next_rows, split_files, page_cache, bank_growth, published_tables, compacted_splits,
        streamed_ids, streamed_labels, streamed_scores,
    )
}

ORACLES = {
    "item_lines": "SELECT 'Q' || p_partkey AS qid, p_name AS label, replace(p_name, ' ', '|') AS tags FROM part",
    "skipped_lines": "SELECT count(*) FILTER (o_orderkey % 7 > 0) AS good, count(*) FILTER (o_orderkey % 7 = 0) AS bad FROM orders",
    "first_lines": "SELECT event_type AS label, min(event_id) AS event_id FROM events GROUP BY 1",
    "relation_map": """SELECT CASE WHEN s_suppkey % 3 > 0 THEN 'Q' ELSE 'K' END || s_suppkey AS qid, s_name || '"} {' || n_name AS label, 'N' || s_nationkey || '=' || n_name AS tags FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "turn_pairs": "SELECT conv_id || '/' || turn AS label, md5(text) AS context FROM conversations WHERE turn % 3 > 0 AND trim(text) <> ''",
    "bank_file": "SELECT vec_id AS qid, 't' || vec_id AS text, len(embedding)::BIGINT AS width, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings",
    "rank_files": """SELECT CASE l_orderkey % 3 WHEN 0 THEN 10 ELSE 20 END::BIGINT AS n, 'S' || l_suppkey AS tag, count(*) AS rows, sum(l_linenumber)::BIGINT AS ranks FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY 1, 2""",
    "page_file": "SELECT o_custkey, o_orderkey FROM (SELECT *, dense_rank() OVER (ORDER BY o_custkey) AS r FROM orders) WHERE (r - 1) // 25 = 3",
    "next_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 20",
    "split_files": """WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS split FROM orders)
        SELECT split, count(*) AS n, min(o_orderkey) AS first, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS failed FROM o WHERE o_orderkey % 11 > 0 GROUP BY 1""",
    "page_cache": "SELECT doc_id, md5(text) AS paragraph FROM documents WHERE doc_id % 4 > 0 AND trim(text) <> ''",
    "bank_growth": "SELECT doc_id AS qid, md5(text) AS text, 64::BIGINT AS width FROM documents",
    "published_tables": "SELECT s_suppkey, (3 * s_nationkey)::BIGINT AS v, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier",
    "compacted_splits": "SELECT c_custkey, c_name FROM customer",
    "streamed_ids": "SELECT DISTINCT user_id AS qid FROM events WHERE event_id % 50 > 0",
    "streamed_labels": "SELECT c_custkey AS qid, c_name AS label FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "streamed_scores": "SELECT event_id, round(1 / (1 + exp(-(value::DOUBLE / 50 - 1))), 6) AS score FROM events",
}
