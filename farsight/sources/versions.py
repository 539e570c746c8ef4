"""Tables that are published together: versions with a commit record, which readers resolve.

A version is a folder. Its commit record is written last, as one small file that is there or isn't; readers take the newest version that has one. Whatever fails before
leaves the old version readable, and a version without a record is never read. What is no longer needed goes after the commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "version long, tables array<string>"


def _fs(spark: SparkSession, path: str):
    """The store of a path, whatever Spark can read, and the path in it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def current(spark: SparkSession, root: str) -> int | None:
    """The newest committed version."""
    if not exists(spark, f"{root}/_commits"):
        return None
    return spark.read.schema(RECORD).json(f"{root}/_commits/*").agg(F.max("version")).first()[0]


def begin(spark: SparkSession, root: str) -> str:
    """The folder of the next version. A version that was left without a commit is overwritten."""
    return f"{root}/v={(current(spark, root) or 0) + 1}"


def commit(spark: SparkSession, root: str, tables: list[str]) -> int:
    """Makes the version after the current one, already written, the one that readers take."""
    version = (current(spark, root) or 0) + 1
    record = spark.createDataFrame([(version, sorted(tables))], RECORD).coalesce(1)
    record.write.mode("overwrite").json(f"{root}/_commits/{version}")
    return version


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest committed version, or of an older one that isn't pruned."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/v={version}/{name}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 1) -> int:
    """Writes all tables as one version, commits it, and drops versions older than the last `keep` before it.

    Tables may be read from the current version."""
    folder = begin(spark, root)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    version = commit(spark, root, list(tables))
    prune(spark, root, keep)
    return version


def prune(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Drops versions before the current one but the last `keep` of them; their records go first, so that none is resolved without its data."""
    now = current(spark, root) or 0
    committed = spark.read.schema(RECORD).json(f"{root}/_commits/*").select("version").distinct().orderBy("version").collect()
    old = [r["version"] for r in committed if r["version"] < now - keep]
    for v in old:
        remove(spark, f"{root}/_commits/{v}")
        remove(spark, f"{root}/v={v}")
    return old


def compact(spark: SparkSession, parts: str, root: str, schema: str, name: str = "items", prune_parts: bool = True) -> int:
    """JSON splits merged with the current version's table into a new version; the splits that were read go after its commit.

    The splits are listed first: such as arrive meanwhile are neither read nor dropped. Consumed splits that are still there, as a run died after its commit, are told by their files, which the version
    notes, and aren't merged again."""
    files = sorted(r[0] for r in spark.read.text(f"{parts}/*").select("_metadata.file_path").distinct().collect()) if exists(spark, parts) else []
    done = set()
    version = current(spark, root)
    if version is not None:
        done = {r["file"] for r in read_table(spark, root, "_consumed").collect()}
    new = [f for f in files if f not in done]
    items = [spark.read.schema(schema).json(new)] if new else []
    items += [read_table(spark, root, name)] if version is not None else []
    if not items:
        raise ValueError(f"there are no splits in {parts}")
    if new:
        whole = items[0] if len(items) == 1 else items[1].unionByName(items[0])
        folder = begin(spark, root)
        whole.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_consumed")
        version = commit(spark, root, [name])
    if prune_parts:
        for f in files:
            remove(spark, f)
    return version
