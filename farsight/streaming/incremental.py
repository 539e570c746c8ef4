"""Incremental work as Structured Streaming (R1 to R5), with sinks that a replayed batch doesn't change.

A batch writes its rows under its own number and then a commit record; readers take only batches with a record. A batch that is run again, as its
first run died before the stream's checkpoint knew of it, overwrites its own rows and sees only what batches before it have committed, so it writes the same again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from farsight.operators.graph import insert_or_ignore, unlabeled
from farsight.sources import versions

COMMIT = "batch long, rows long"


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def distinct_ids(stream: DataFrame, key: str = "qid") -> DataFrame:
    """First row of each key, with the keys as state."""
    return stream.filter(F.col(key).isNotNull()).dropDuplicates([key])


def distinct_within(stream: DataFrame, time: str, delay: str, key: str = "qid") -> DataFrame:
    """First row of each key as far as rows that repeat it are no further apart in time than delay; keys older than that leave the state, which stays bounded."""
    return stream.filter(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows) of the committed batches of a sink."""
    if not versions.exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{path}/_commits/*")


def committed(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of a sink's committed batches, of those before a number if given, with their `batch`."""
    known = commits(spark, path).select("batch").distinct()
    known = known if before is None else known.filter(F.col("batch") < before)
    full = StructType([*schema.fields]).add("batch", LongType())
    rows = spark.read.schema(full).option("basePath", path).parquet(f"{path}/batch=*") if versions.exists(spark, path) and known.count() else spark.createDataFrame([], full)
    return rows.join(F.broadcast(known), "batch", "left_semi")  # a row a batch


def write_batch(df: DataFrame, path: str, number: int) -> None:
    """df as batch `number` of the sink at path, in place of what an earlier run of the batch has left, and its commit record."""
    spark = df.sparkSession
    where = f"{path}/batch={number}"
    df.write.mode("overwrite").parquet(where)
    rows = spark.read.schema(df.schema).parquet(where).count()
    spark.createDataFrame([(number, rows)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/_commits/{number}")


def to_sink(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Runs work(batch, number) for each batch and writes what it gives as that batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_batch(work(batch, number), path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_set(stream: DataFrame, path: str, checkpoint: str, key: str = "qid") -> StreamingQuery:
    """Adds the keys that the set at path lacks, without keeping them as state (R1, K3). Read the set by `committed`."""
    schema = stream.select(key).schema

    def new(batch: DataFrame, number: int) -> DataFrame:
        old = committed(batch.sparkSession, path, schema, before=number).drop("batch")
        return insert_or_ignore(old, batch.select(key).filter(F.col(key).isNotNull()), key)

    return to_sink(stream, path, checkpoint, new)


def label_missing(seen: DataFrame, names: DataFrame, path: str, checkpoint: str, key: str = "qid", seed: DataFrame | None = None) -> StreamingQuery:
    """Looks up labels of arriving ids that have none yet, neither in the sink nor in a seed cache, batch by batch (R2 to R4). A restart goes on after the last batch. Read the labels by `committed`."""
    schema = names.select(key, "label").schema

    def new(batch: DataFrame, number: int) -> DataFrame:
        done = committed(batch.sparkSession, path, schema, before=number).drop("batch")
        done = done.select(key) if seed is None else done.select(key).unionByName(seed.select(key))
        todo = unlabeled(batch.select(key).filter(F.col(key).isNotNull()).distinct(), done, key)
        return todo.join(names.select(key, "label"), key)

    return to_sink(seen, path, checkpoint, new)


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores rows as they arrive, without state."""
    return score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, path: str, schema: StructType, root: str) -> int:
    """A sink's committed rows as one published table `rows` at root, so that readers and later joins read few files."""
    return versions.publish(spark, root, {"rows": committed(spark, path, schema).drop("batch")})
