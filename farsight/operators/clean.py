"""Cleaning, keep-rules and distinct sets on item and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farsight.functions import text as X


def keep_one(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """First row of each key in the given ascending order; aggregated before the shuffle, so that a common key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def keep_first_canonical(items: DataFrame, label: str = "label", order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """First row of each canonical label; blank labels go (A1)."""
    df = items.withColumn("canon", X.canonical_label(F.col(label))).filter("canon <> ''")
    return keep_one(df, ["canon"], *order)


def keep_first_with_tags(items: DataFrame, order: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """First row of each id, or canonical label if the id is blank, among rows that have tags left after cleaning (A2)."""
    df = items.withColumn("related_tags", X.clean_tags("related_tags")).filter(F.size("related_tags") > 0)
    df = df.withColumn("key", F.coalesce(F.concat(F.lit("i:"), X.first_of(F.col("qid"))), F.concat(F.lit("l:"), X.canonical_label(F.col("label")))))
    return keep_one(df, ["key"], *order).drop("key")


def keep_longest(pages: DataFrame, keys: list[str], text: str, *ties: str) -> DataFrame:
    """Row with the longest trimmed text of each key, the first of equals; blank texts go (A3)."""
    df = pages.withColumn("__t", X.strip(text)).filter("__t <> ''").withColumn("__l", F.length("__t"))
    return keep_one(df, keys, -F.col("__l"), *ties).withColumn(text, F.col("__t")).drop("__t", "__l")


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row of each key (A4); aggregated before the shuffle, so common keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def unique_tags(items: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct trimmed, non-blank tags over several list columns (A5)."""
    every = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns)))
    return items.select(F.explode(every).alias("tag")).select(X.strip("tag").alias("tag")).filter("tag <> ''").distinct()


def drop_keyword_tags(items: DataFrame, words: tuple[str, ...] = ("wikipedia", "wikidata")) -> DataFrame:
    """Items whose tags have none of the words in any text at any depth, with the number of tags removed."""
    values = lambda t: F.lower(F.regexp_replace(F.to_json(F.struct(t)), '"[^"\\\\]*":', ""))  # noqa: E731  without the names of fields
    keep = F.filter("related_tags", lambda t: ~F.coalesce(values(t).rlike("|".join(words)), F.lit(False)))
    return items.withColumn("removed", F.size("related_tags") - F.size(keep)).withColumn("related_tags", keep)


def not_processed(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a row in done that was checked or has a known outcome (F8)."""
    return items.join(done.filter("coalesce(wikipedia_checked, false) or wikipedia_exists is not null").select("qid"), "qid", "left_anti")


def fully_expanded(tags: str = "related_tags") -> Column:
    """Non-empty tags that all have a one-hop list."""
    return (F.size(tags) > 0) & F.forall(tags, lambda t: t["one_hop_related_tags"].isNotNull())


def enriched(items: DataFrame, pages: DataFrame, lang: str = "en") -> DataFrame:
    """All items with their page; a miss has checked, no page, an empty paragraph and default names."""
    found = pages.select("qid", F.col("wikipedia_title").alias("t"), F.col("wikipedia_lang").alias("l"), F.col("wikipedia_first_paragraph").alias("p"))
    joined = items.join(found, "qid", "left")
    return joined.select(
        *items.columns,
        F.lit(True).alias("wikipedia_checked"),
        F.col("p").isNotNull().alias("wikipedia_exists"),
        F.coalesce("l", F.lit(lang)).alias("wikipedia_lang"),
        F.coalesce("t", "label").alias("wikipedia_title"),
        F.coalesce("p", F.lit("")).alias("wikipedia_first_paragraph"),
    )


def cache_record(rows: DataFrame, lang: str = "en") -> DataFrame:
    """Page cache rows with defaults."""
    title = X.first_of(*(F.col(c) for c in ("wikipedia_title", "label", "tag", "qid")))
    return rows.select(
        X.page_key(F.col("qid"), F.col("tag")).alias("qid"), X.first_of(F.col("tag"), F.col("qid")).alias("tag"), F.coalesce(X.first_of(F.col("label")), title).alias("label"),
        F.coalesce(X.first_of(F.col("wikipedia_lang")), F.lit(lang)).alias("wikipedia_lang"), title.alias("wikipedia_title"), "wikipedia_first_paragraph",
    )


def validated(items: DataFrame, tags: str = "related_tags") -> DataFrame:
    """The items; one whose tags break the form of a finished item fails the job, with its id and what is wrong.

    A tag is there and has a label and a list of one-hop tags, each of which is there and has a label; ids may be missing but not blank."""
    named = lambda t: t.isNotNull() & t["label"].isNotNull()
    blank = lambda t: F.coalesce(X.strip(t["qid"]) == "", F.lit(False))
    hops = lambda t: F.coalesce(t["one_hop_related_tags"], F.array())
    fault = (
        F.when(F.col(tags).isNull(), "related_tags is missing")
        .when(~F.forall(tags, named), "a tag lacks its label")
        .when(F.exists(tags, blank), "a tag has a blank id")
        .when(~F.forall(tags, lambda t: t["one_hop_related_tags"].isNotNull()), "a tag lacks one_hop_related_tags")
        .when(~F.forall(tags, lambda t: F.forall(hops(t), named)), "a one-hop tag lacks its label")
        .when(F.exists(tags, lambda t: F.exists(hops(t), blank)), "a one-hop tag has a blank id")
    )
    return items.filter(F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(F.coalesce(F.col("qid"), F.lit("?")), F.lit(": "), fault)).cast("boolean")))


def with_text(ids: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with a non-blank paragraph, and one row with the number of those without."""
    texts = pages.filter(X.strip("text") != "").select("qid", "text")
    return ids.join(texts, "qid"), ids.join(texts, "qid", "left_anti").agg(F.count("*").alias("skipped"))
