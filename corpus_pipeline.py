"""Documents to packed training sequences: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm import jaccard, mixing, packing, substring, toxicity
from farsight.llm.common import crc32_mod, drop, noted, parted, shared_folder, written

#: Bytes of rows that go to a Python worker at once, about. Spark's 64 MB would be there several times for each core of an executor: as it is filled, read and worked on.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def _small_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES for the session, as a stage's last rows are made when they are written; `run` puts back what was set before."""
    spark.conf.set(BATCH_CONF, BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic. The field learns from labels of ids in four of five folds.

    Null and empty texts are scored as texts without words, repeated rows and such with null ids each alike; an empty table stays empty. Columns of any name stay as they are."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = toxicity.train(docs.filter(crc32_mod("doc_id", 5) != 0), labels)
    return docs.filter(toxicity.toxic_score("text", field) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document with the smallest id.

    Rows without words or without an id stay, as they are like no other; all rows of an id stay or go together; columns of any name stay as they are."""
    _small_batches(spark)
    found = jaccard.near_duplicates(docs, words=5, num=80, den=100)
    later = written(found.filter("doc_id <> component_id").select("doc_id").distinct())
    maybe, first = parted(docs.filter("doc_id is not null"), later)  # texts of the first ones needn't be shuffled
    rest = maybe.join(later.withColumnRenamed("doc_id", "__later"), F.col("doc_id") == F.col("__later"), "left_anti")
    return first.unionByName(rest).unionByName(docs.filter("doc_id is null"))  # without an id nothing is a duplicate


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that an earlier document has; documents that lose all words go.

    Null and empty texts and rows without an id stay as they are; rows that repeat an id with its text get the same result. Columns but text and n_chars, of any name, stay as they are."""
    _small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *others).alias("__row"))
    found = substring.repeated_substrings(held, length=13, carry=True)
    return (
        found.filter("n_removed = 0 or n_removed < n_words")
        .withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
        .select("doc_id", "text", "__row.*")
        .withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
        .select(*docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time that a shard draws from a document, with the words drawn, shuffled within the shard.

    Documents without words aren't drawn. Null ids and sources are values like others; columns but text and n_chars, of any name, stay as they are."""
    drawn = mixing.drawn_texts(docs, mixing.mixture(docs))
    return drawn.withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text goes among sequences of 2048 tokens. A null or empty text is its end mark alone; every row is packed, repeated ones too."""
    import public_tokenizers

    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the field of the first stage nor the program of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself, and the documents that it has read, go once its own are written."""
    docs, before, batches = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], spark.conf.get(BATCH_CONF)
    try:
        for name, stage in STAGES:
            path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
            with noted() as tables:
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            drop(spark, *tables, *before)
            before = [path]
    finally:
        spark.conf.set(BATCH_CONF, batches)
    return docs
