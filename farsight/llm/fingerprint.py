"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

A paragraph is a line. A section ends with a paragraph whose hash says so, one in PARAGRAPHS, so that lines put in or taken out change only the section around them. A leaf is the hash of a clause of a paragraph, a paragraph's
digest is the hash of its leaves, a section's the hash of its paragraphs' digests, the root the hash of the
sections' digests. The fingerprint is the root and, after a colon, the leaves: `,` parts leaves, `/` paragraphs
and `;` sections, so that inner digests follow from it. Two trees are compared from the top: equal roots are equal texts; sections that both have are passed over; of the
others, paragraphs that both have are too; what is left locates the edits, without the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.functions.order import range_of
from farsight.llm.common import documents

PARAGRAPHS = 8
#: Documents in a range of ids, about, and the most ranges.
FAN, RANGES = 4096, 1 << 16


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty. Equal texts have equal fingerprints."""
    clauses = lambda p: F.split(p, "(?<=[.,!?|;:] )", -1)
    leaves = lambda p: F.array_join(F.transform(clauses(p), lambda s: F.lower(F.hex(F.xxhash64(s)))), ",")
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), leaves)
    return F.element_at(F.transform(F.array(paragraphs), _joined), 1)


def _joined(paragraphs: Column) -> Column:
    ends = lambda p: F.pmod(F.xxhash64(p), F.lit(PARAGRAPHS)) == 0
    last = F.size(paragraphs) - 1
    body = F.array_join(F.transform(paragraphs, lambda p, i: F.concat(p, F.when(i == last, "").when(ends(p), ";").otherwise("/"))), "")
    return F.element_at(F.transform(F.array(body), lambda s: F.concat(root(F.split(s, ";", -1)), F.lit(":"), s)), 1)


def section_digest(section: Column) -> Column:
    return F.md5(F.array_join(F.transform(F.split(section, "/", -1), lambda p: F.md5(p)), "/"))


def root(sections: Column) -> Column:
    return F.md5(F.array_join(F.transform(sections, section_digest), ";"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the roots are equal, else the share of leaves that both have (Dice), of different leaves."""
    one, two = (F.array_distinct(F.split(F.substring_index(x, ":", -1), "[,/;]", -1)) for x in (a, b))
    shared = 2.0 * F.size(F.array_intersect(one, two)) / (F.size(one) + F.size(two))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(shared)


def _sections(fingerprint: Column) -> Column:
    return F.split(F.substring_index(fingerprint, ":", -1), ";", -1)


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(s, "/", -1)))


def apart(a: Column, b: Column) -> Column:
    """The branches of a that b lacks, different ones: sections, and those paragraphs of theirs that the sections that only b has lack too. Both are empty if the roots are equal."""
    one, two = _sections(a), _sections(b)
    own, other = F.array_except(one, two), F.array_except(two, one)
    none = F.array().cast("array<string>")
    equal = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    left = F.array_except(_paragraphs(own), _paragraphs(other))
    return F.struct(F.when(equal, none).otherwise(own).alias("sections"), F.when(equal, none).otherwise(left).alias("paragraphs"))


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of a that b lacks, from their fingerprints: those that were changed or taken out; the other way round, those that were put in."""
    found = apart(a, b)
    every = F.transform(_paragraphs(_sections(a)), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.filter(every, lambda x: F.array_contains(found["paragraphs"], x["p"])), lambda x: x["i"])


def with_next(docs: DataFrame, column: str) -> DataFrame:
    """docs(doc_id, ...) with `next`, the column of the following row by doc_id, after the last of the first.

    Ids are cut into ranges at approximate quantiles, so that each has about FAN rows (more beyond RANGES ranges) wherever the ids lie. The first row of each range is also put
    at the end of the range before it, so one exchange of the rows serves: the list of first ids, a row for each range, is what joins them."""
    ranges = min(RANGES, docs.count() // FAN)
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))  # null ids come first
    which = range_of(place, sorted({int(x) for x in cuts}))
    ranged = docs.select(place.alias("place"), which.alias("r"))
    heads = ranged.groupBy("r").agg(F.min("place").alias("head"))
    before = F.coalesce(F.lag("r").over(Window.orderBy("r")), F.lit(-1))  # -1: the first follows the last
    last = heads.agg(F.max("r").alias("last"))
    heads = heads.withColumn("before", before).join(F.broadcast(last)).select(
        F.col("head").alias("__head"), F.when(F.col("before") < 0, F.col("last")).otherwise(F.col("before")).alias("__before")
    )
    rows = docs.withColumn("__r", which)
    rows = rows.join(F.broadcast(heads), place == F.col("__head"), "left")  # RANGES rows at most
    places = F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("late")), F.struct(F.col("__before").alias("r"), F.lit(1).alias("late")))
    rows = rows.withColumn("__x", F.explode(F.filter(places, lambda x: x["r"].isNotNull())))
    order = Window.partitionBy("__x.r").orderBy("__x.late", "doc_id", column)
    return rows.withColumn("next", F.lead(column).over(order)).filter("__x.late = 0").select(*docs.columns, "next")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, gone, new) for each row of docs(doc_id, text).

    The edited text has the last half of the code points (rounded down) replaced by as many from the start of the next document by doc_id
    (all, if it has fewer; after the last comes the first). A null text is empty. Rows that repeat a doc_id follow
    one another by text; rows with a null doc_id come first. gone and new count the different paragraphs that the edit takes out and puts in, found by descending both trees. Other columns are ignored; an empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(rows, "text").withColumn("n_chars", F.length("text").cast("long"))
    paired = paired.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("next_fingerprint", fingerprint(F.col("next")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.left(F.col("next"), half))
    paired = paired.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return paired.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size(apart(F.col("fingerprint"), F.col("edited_fingerprint"))["paragraphs"]).cast("long").alias("gone"),
        F.size(apart(F.col("edited_fingerprint"), F.col("fingerprint"))["paragraphs"]).cast("long").alias("new"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
