"""Sources and sinks for item, page, claim and rank files."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.functions import text as X
from farsight.functions.order import ordered
from farsight.sources import objects, versions

ITEM_V1 = "qid string, label string, related_tags array<string>, _error string"
ITEM_V2 = "qid string, label string, related_tags array<struct<qid: string, label: string, one_hop_related_tags: array<struct<qid: string, label: string>>>>"
FINAL_ITEM = "qid string, label string, related_tags array<struct<qid: string, label: string>>"
PAGE = "tag string, qid string, label string, wikipedia_lang string, wikipedia_title string, wikipedia_first_paragraph string"


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, glob: str | None = None, with_file: bool = False, spread: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip by extension. strict: a bad line fails the job, else it is skipped.

    with_file adds `file` and `pos`: pos holds the byte at which the line's split starts and the line's place in it, so that it orders a file's lines however Spark deals the splits. spread deals the rows
    to so many tasks, as a gzip file, which can't be split, is read by one."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).json(path)
    if with_file:
        pos = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
        df = df.select("*", F.col("_metadata.file_path").alias("file"), pos.alias("pos"))
    return df.repartition(spread) if spread else df


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with the number of lines that aren't objects of the schema."""
    full = T.StructType.fromDDL(schema).add("_bad", "string")
    lines = spark.read.text(path).filter(X.strip("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.agg(F.count_if(F.col("r").isNull() | F.col("r._bad").isNotNull()).alias("bad"))


def read_relation_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object id -> record, as a row for each record, read by as many tasks as the file has splits."""
    return objects.read_relation_map(spark, path, FINAL_ITEM)


def read_bank(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """The embedding bank(qid, text, embedding); missing columns fail, or give an empty bank with on_error='reset' (S6)."""
    df = spark.read.parquet(path)
    if {"qid", "text", "embedding"} - set(df.columns):
        if on_error == "reset":
            return spark.createDataFrame([], "qid string, text string, embedding array<float>")
        raise ValueError("the bank lacks qid, text or embedding")
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))


def read_ranks(spark: SparkSession, paths: str | list[str], combos: list[tuple[str, int]]) -> DataFrame:
    """Rank rows of the asked (retriever, n) from tables with folders `retriever=` and `n=`: each combo from the first path that has it, the others being legacy places.

    A combo that no path has is warned of and gives no rows."""
    found = []
    for retriever, n in combos:
        places = [f"{p}/retriever={retriever}/n={n}" for p in ([paths] if isinstance(paths, str) else paths)]
        place = next((p for p in places if versions.exists(spark, p)), None)
        if place is None:
            warnings.warn(f"no ranks of {retriever}, {n}: tried {', '.join(places)}", stacklevel=2)
        else:
            found.append(spark.read.parquet(place).withColumns({"retriever": F.lit(retriever), "n": F.lit(n)}))
    if not found:
        return spark.createDataFrame([], "qid string, tag string, rank int, sample_size int, retriever string, n int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_pairs(spark: SparkSession, path: str, label: str = "label", context: str = "context") -> DataFrame:
    """Label and context pairs as strings, without blank contexts; none at all is an error."""
    df = spark.read.json(path)
    df = df.withColumn(label, F.col(label).cast("string")).withColumn(context, F.col(context).cast("string")).filter(X.strip(context) != "")
    if df.isEmpty():
        raise ValueError("there are no pairs")
    return df


def page_bounds(df: DataFrame, key: str, size: int) -> DataFrame:
    """(page, first, last, rows): the range of keys of each page of `size` different keys in their order, from 0. Null keys are on no page.

    Keys are numbered by counts per range, so no task orders them all."""
    idx = ordered(df, key).select(F.col("node").alias(key), F.floor(F.col("idx") / size).alias("page"))
    return df.join(idx, key).groupBy("page").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))


def write_pages(df: DataFrame, key: str, size: int, path: str) -> None:
    """df in the order of key, and the bounds of its pages, for read_page (S9, P1). Written once; each page is then a scan of what its range needs."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    page_bounds(df.select(key), key, size).coalesce(1).write.mode("overwrite").parquet(f"{path}/pages")


def read_page(spark: SparkSession, path: str, key: str, number: int) -> DataFrame:
    """Page `number` (from 0), unordered: a filter on key that reaches the files. A page that isn't there is empty."""
    rows = spark.read.parquet(f"{path}/rows")
    bounds = spark.read.parquet(f"{path}/pages").filter(F.col("page") == number).select("first", "last").first()
    return rows.filter(F.col(key).between(bounds["first"], bounds["last"])) if bounds else rows.limit(0)


def page_of(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of the rows in order, for a single look; write_pages serves many."""
    return df.orderBy(order).offset(number * size).limit(size)


def after_key(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next rows after a key."""
    return (df if last is None else df.filter(F.col(key) > last)).orderBy(key).limit(size)


def write_json_lines(df: DataFrame, path: str, gzip: bool = False, append: bool = False) -> None:
    """JSON lines (K1, K2)."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", error: str = "_error") -> None:
    """Rows by split, rows with an error apart (K5). A split's rows are written by one task, so that there are as many files as splits, not as many as splits times tasks."""
    df.filter(F.col(error).isNull()).repartition(split).write.mode("overwrite").partitionBy(split).json(f"{path}/items")
    df.filter(F.col(error).isNotNull()).write.mode("overwrite").json(f"{path}/failed")


def write_cache(df: DataFrame, path: str, text: str = "wikipedia_first_paragraph") -> None:
    """Only rows with a paragraph (K7)."""
    df.filter(X.strip(text) != "").write.mode("overwrite").json(path)


def scan_report(items: DataFrame, score, ranks: str = "ranks") -> DataFrame:
    """(qid, label, risk_score, ranks); items without ranks get NaN."""
    return items.select("qid", "label", F.when(F.size(ranks) > 0, score(F.col(ranks))).otherwise(float("nan")).alias("risk_score"), ranks)


def write_in_order(df: DataFrame, path: str, pos: str = "pos") -> None:
    """JSON lines in the order of pos, within files and from file to file, without the column."""
    df.repartitionByRange(pos).sortWithinPartitions(pos).drop(pos).write.mode("overwrite").json(path)
