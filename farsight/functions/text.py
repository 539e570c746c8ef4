"""String expressions: labels, paragraphs, identifiers, pair texts and phrase positions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_ID = "^Q[1-9]\\d*$"
# Fixed values, in their given order: labels, endings, leads and marks by which rows are left out.
HOUSEKEEPING_LABELS = ["Wikimedia category", "Wikimedia template", "Wikimedia disambiguation page"]
STUB_ENDINGS = ["may refer to:", "is a given name and a surname.", "is a given name.", "is a surname."]
LEADS = [
    "may refer to",
    "may also refer to",
    "can refer to",
    "can also refer to",
    "may stand for",
    "may mean",
    "this category should only contain articles on species",
]
MARKS = [
    "disambiguation",
    "may refer to one of the following",
    "refer to one of the following",
    "this page lists articles",
    "this disambiguation page",
    "wikipedia does not have an article with this exact name",
    "this category should only contain articles on species",
]


# What strip() takes for white space, as a class that patterns in Spark and in SQL share.
BLANKS = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


_BLANK_CHARACTERS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column | str) -> Column:
    """Text without white space of any kind at its ends, from which it works."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(_BLANK_CHARACTERS))


#: Labels that a task normalises together.
LABELS = 256


def _canonical(labels: pa.Array) -> pa.Array:
    one = lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold().strip()
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([one(x.as_py()) for x in labels.slice(i, LABELS)], pa.string()) for i in range(0, len(labels), LABELS))])


def canonical_label(label: Column) -> Column:
    """Compatibility-normalised, case-folded and trimmed label, '' for null; ASCII labels stay in the JVM: the workers get null for them."""
    text = F.coalesce(label.cast("string"), F.lit(""))
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, F.lower(strip(text))).otherwise(F.arrow_udf(_canonical, T.StringType())(F.when(~plain, text)))


def iri_tail(iri: Column) -> Column:
    """What follows /entity/ or /prop/direct/, '' if neither is there."""
    return F.when(iri.contains("/entity/"), F.substring_index(iri, "/entity/", -1)).when(
        iri.contains("/prop/direct/"), F.substring_index(iri, "/prop/direct/", -1)
    ).otherwise("")


def property_iri(iri: Column) -> Column:
    return F.replace(iri, F.lit("/prop/direct/"), F.lit("/entity/"))


def value_type(value: Column, datatype: Column) -> Column:
    """wikibase-item for an IRI, else the literal's datatype."""
    return F.when(value.rlike("^https?://"), F.lit("wikibase-item")).otherwise(datatype)


def label_by_language(labels: Column, languages: list[str]) -> Column:
    """First label of a language -> label map in the order of languages, '' if there is none."""
    return F.coalesce(*(F.try_element_at(labels, F.lit(x)) for x in languages), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)\\b\\w+\\b"))


def first_paragraph(text: Column) -> Column:
    """Text up to the first blank line."""
    return strip(F.split(strip(text), "\n\n", 2)[0])


def pair_text(label: Column, context: Column) -> Column:
    """`label : context`, or the context alone if it has the label in any case."""
    name, text = strip(F.coalesce(label, F.lit(""))), strip(F.coalesce(context, F.lit("")))
    return F.when((name != "") & ~F.contains(F.lower(text), F.lower(name)), F.concat(name, F.lit(" : "), text)).otherwise(text)


def escape_literal(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def tag_name(*parts: Column) -> Column:
    """Non-empty parts joined by an underscore."""
    return F.concat_ws("_", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def length_and_suffix(text: Column, most: int, endings: list[str]) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    ends = F.lit(False)
    for e in endings:
        ends = ends | t.endswith(e)
    return (F.length(t) < most) & ends


def two_source_text(first: Column, second: Column, cut_first: bool = False) -> Column:
    """First source if it isn't blank, else the first paragraph of the second, else null."""
    one = F.nullif(strip(first), F.lit(""))
    return F.coalesce(first_paragraph(one) if cut_first else one, F.nullif(first_paragraph(second), F.lit("")))


def occurrence(text: Column, phrase: Column, nth: int = 1) -> Column:
    """Start (from 0) of the n-th occurrence of phrase in any case, of the last if there are fewer, null if none."""
    low, want = F.lower(text), F.lower(phrase)
    pieces = F.split(low, F.concat(F.lit("\\Q"), F.replace(want, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    at = F.least(F.lit(nth), F.size(pieces) - 1)
    before = F.aggregate(F.slice(pieces, 1, at), F.lit(0), lambda a, p: a + F.length(p))
    return F.when((F.length(want) > 0) & (F.size(pieces) > 1), before + (at - 1) * F.length(want))


def token_window(first: Column, last: Column, size: Column, limit: int, context: int = 0) -> tuple[Column, Column]:
    """First and last token (exclusive) of the window around a span, clamped to the text (X20). context 0 gives the span itself."""
    width = F.least(F.lit(limit), F.greatest(last - first, F.lit(1)) + 2 * context)
    middle = F.floor((first + last) / 2)
    start = F.greatest(F.lit(0), F.least(middle - F.floor(width / 2), size - width))
    start = F.when((start > first) | (start + width < F.least(last, first + width)), first).otherwise(start).cast("int")
    return start, F.least(start + width, size).cast("int")


def first_of(*columns: Column) -> Column:
    """First column that is neither null nor blank."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in columns))


def page_key(qid: Column, tag: Column) -> Column:
    """The qid if it is an id, else the tag if that is one, else null."""
    return F.coalesce(F.when(qid.rlike(NODE_ID), qid), F.when(tag.rlike(NODE_ID), tag))


def usable_label(label: Column) -> Column:
    """Label that says something: not blank, no id, no number and no name of the source (F1)."""
    t = strip(F.coalesce(label, F.lit("")))
    return (t != "") & ~t.rlike("^Q\\d+$") & ~t.rlike("^\\d+$") & ~F.lower(t).rlike("wikidata|wikipedia|wikimedia")


def clean_tags(tags: Column) -> Column:
    """Tags without ids, housekeeping labels, and names with `_`, `/` or `wiki` (F2)."""
    keep = lambda t: ~t.rlike("^Q\\d+$") & ~t.isin(HOUSEKEEPING_LABELS) & ~t.rlike("[_/]") & ~F.lower(t).contains("wiki")
    return F.filter(tags, keep)


def refers_to_itself(item: Column, value: Column, any_case: bool) -> Column:
    """Value that contains the item's label; an empty label is contained in nothing."""
    a, b = (F.lower(item), F.lower(value)) if any_case else (item, value)
    return (F.coalesce(a, F.lit("")) != "") & F.coalesce(F.contains(b, a), F.lit(False))


def stub_paragraph(text: Column) -> Column:
    """Short paragraph that ends as disambiguation and name pages do; an empty one is none."""
    return length_and_suffix(text, 60, STUB_ENDINGS)


def clean_paragraph(text: Column, min_words: int = 10) -> Column:
    """Paragraph with single spaces; null if empty, too short or a disambiguation."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))
    low = F.lower(t)
    bad = low.rlike("^(" + "|".join(LEADS) + ")") | F.left(low, F.lit(200)).rlike("|".join(MARKS))
    return F.when((t != "") & ~bad & (word_count(t) >= min_words), t)
