"""Main text of web pages by equivalence classes of tokens.

A token is a tag with its class, or a text, together with the path of elements around it. Over the pages of a host,
each token has an occurrence vector: how often each page has it. Tokens with equal vectors form a class; the vectors are compared by
a sum of page hashes times counts, so that no task ever holds a host's pages. A class is valid if enough of
the pages have it and it has a tag: its texts that lie within one of its own tags are constants of the template, for they come and go with
the element around them; a text with another vector than all tags around it is content, however many pages have it. Tags that stand once on each page that has them are the nodes of the
template, nested by their paths. Free text, which is no constant, adds to all nodes around it. The slot that is extracted is the deepest node with
most of the host's free text and all of its first-level headings; a node that is an article or main element comes first, if it has these. Navigation,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments by tag, role or class hold no free text. A page without the slot, or
of a host without a template, gives what its article or main element holds, else all free text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.llm.common import tidy, written

#: Share of a host's pages, and number, that must have a class for it to be valid.
SUPPORT, LEAST = 0.5, 4
#: Share of a host's free text that its slot has at least.
MOST = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[^>=]++)*+)>|[^<]+|<",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements by what HTML makes of them, and names that mark what isn't the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_OUT = frozenset("head nav header footer aside form button select option dialog menu object canvas audio video".split())
#: Parts of a name by which an element is no part of an article, if all its other parts are of the second kind: share-buttons, but not share-price.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices comment comments respond reply replies disqus footer header masthead share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay toolbar pagination pager search complementary contentinfo alert".split()
)
_GENERIC = frozenset("0 site page main top bottom left right global list section box wrapper container area bar links link buttons button icons form thread block inner outer widget item items post posts article articles content side secondary primary wide small sticky message text title slot unit zone".split())
#: A start tag of the key closes an open element of these names first.
_CLOSES = {t: frozenset({"p"}) for t in _BLOCK - {"body", "html", "head"}} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
_LIMITS = frozenset("ul ol dl table article section div body main nav aside header footer form blockquote".split())


def events(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """('open', label, path), ('close', label, path), ('break', tag, path) and ('text', text, path), the path being the labels of open elements."""
    stack: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(page):
        raw, tag = m[0], (m[2] or "").lower()
        if not tag:
            if raw[0] != "<" or raw == "<":
                yield "text", raw, tuple(s[1] for s in stack)
            continue
        if raw[1] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                while len(stack) > at:
                    label = stack.pop()[1]
                    yield "close", label, tuple(s[1] for s in stack)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                yield "break", tag, tuple(s[1] for s in stack)
            continue
        closes = _CLOSES.get(tag)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    while len(stack) > i:
                        label = stack.pop()[1]
                        yield "close", label, tuple(s[1] for s in stack)
                elif stack[i][0] in _LIMITS:
                    break
        names = re.sub(r"[0-9]+", "0", " ".join(x for found in _CLASS.findall(m[3] or "") for x in found if x))  # ids with numbers differ by page
        label = f"{tag}.{names}" if names else tag
        yield "open", label, tuple(s[1] for s in stack)
        stack.append((tag, label))


def _structure(path: tuple[str, ...]) -> str:
    """The path without inline elements."""
    return ">".join(p for p in path if p.partition(".")[0] in _BLOCK)


def _furniture(names: str) -> bool:
    """Whether one of an element's names says that it is no part of an article."""
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        if any(x in _FURNITURE for x in parts) and all(x in _FURNITURE or x in _GENERIC for x in parts):
            return True
    return False


def _outside(path: tuple[str, ...]) -> bool:
    return any(p.partition(".")[0] in _OUT or ("." in p and _furniture(p.partition(".")[2])) for p in path)


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def page_tokens(page: str) -> dict[tuple[int, bool, str], list[int]]:
    """Occurrences of each token of a page by (hash, whether it is a tag, where it is), and their free text and free headings."""
    out: dict[tuple[int, bool, str], list[int]] = {}
    for kind, value, path in events(page):
        if kind == "open" and value.partition(".")[0] in _BLOCK:
            place = _structure((*path, value))
            row = out.setdefault((_hash("tag", place), True, place), [0, 0, 0])
        elif kind == "text" and value.strip():
            value, place = _clean(value), _structure(path)
            row = out.setdefault((_hash("text", value, place), False, place), [0, 0, 0])
            if not _outside(path) and not any(p.partition(".")[0] == "a" for p in path):
                row[1] += len(value)
                row[2] += len(value) * any(p.partition(".")[0] == "h1" for p in path)
        else:
            continue
        row[0] += 1
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, tag, place, vector, pages, times, free, heading), summed over a batch."""
    names = ["host", "token", "tag", "place", "vector", "pages", "times", "free", "heading"]
    types = (pa.string(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 5)
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for page, host, html in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            h = _hash("page", str(page)) | 1
            for token, (n, free, heading) in page_tokens(html or "").items():
                row = sums.setdefault((host, *token), [0, 0, 0, 0, 0])
                row[0] = (row[0] + h * n) & 0xFFFFFFFFFFFFFFF
                for i, x in enumerate((1, n, free, heading), 1):
                    row[i] += x
        columns = [*([k[i] for k in sums] for i in range(4)), *([v[i] for v in sums.values()] for i in range(5))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _within(place: str, slot: str) -> bool:
    return place == slot or place.startswith(slot + ">")


def main_text(page: str, constants: set[int], slot: str | None) -> str:
    """What the slot of a page holds, or its article: one line for each block."""
    if not page:
        return ""
    parsed = list(events(page))
    tag = None
    if not slot or not any(k == "text" and v.strip() and not _outside(p) and _within(_structure(p), slot) for k, v, p in parsed):
        slot = None  # a page of another make
        for name in ("article", "main"):
            if any(k == "open" and v.partition(".")[0] == name and not _outside((*p, v)) for k, v, p in parsed):
                tag = name
                break
    for held in (constants, set()):  # a page of constants alone keeps them
        blocks: list[str] = []
        parts: list[str] = []

        def flush(parts: list[str] = parts, blocks: list[str] = blocks) -> None:
            text = _clean("".join(parts))
            if text:
                blocks.append(text)
            parts.clear()

        for kind, value, path in parsed:
            if kind in ("open", "close"):
                if value.partition(".")[0] in _BLOCK:
                    flush()
            elif kind == "break":
                if value == "hr":
                    flush()
                else:
                    parts.append(" ")
            elif not _outside(path):
                place = _structure(path)
                within = _within(place, slot) if slot else not tag or any(p.partition(".")[0] == tag for p in path)
                if within and (not value.strip() or _hash("text", _clean(value), place) not in held):
                    parts.append(value)
        flush()
        if blocks or not constants:
            break
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html, constants, slot in zip(*(batch.column(c).to_pylist() for c in ("html", "constants", "slot")), strict=True):
            found.append(main_text(html or "", set(constants or ()), slot))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """(host, constants, slot): texts of each host's valid classes, and the path of the template's node that holds the articles; null where there is none."""
    rows = pages.select("page_id", host().alias("host"), "html")
    seen = rows.mapInArrow(tidy(_occurrences), "host string, token long, tag boolean, place string, vector long, pages long, times long, free long, heading long")
    # sums are taken modulo 2**60, so that partial sums never overflow
    seen = seen.groupBy("host", "token", "tag", "place").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("v"), *(F.sum(c).alias(c) for c in ("pages", "times", "free", "heading")))
    # a table, as the joins below need it: the pages are parsed for it once
    seen = written(seen.withColumn("v", F.pmod("v", F.lit(1 << 60).cast("decimal(38,0)")).cast("long")))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    common = seen.join(sizes, "host").filter((F.col("pages") >= least) & (F.col("pages") >= support * F.col("n")))
    # tokens that half of a host's pages have are at most twice those of a page
    classes = common.groupBy("host", "v", "pages").agg(
        F.collect_list(F.when(F.col("tag"), F.struct("place", (F.col("times") == F.col("pages")).alias("once")))).alias("tags"),
        F.collect_list(F.when(~F.col("tag"), F.struct("token", "place"))).alias("texts"),
    ).filter("size(tags) > 0")
    inside = F.expr("filter(texts, t -> exists(tags, x -> t.place = x.place or startswith(t.place, concat(x.place, '>'))))")
    nested = written(classes.select("host", F.transform(inside, lambda t: t["token"]).alias("constants"), F.expr("transform(filter(tags, x -> x.once), x -> x.place)").alias("nodes")))
    constants = nested.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("constants"))).alias("constants"))
    nodes = nested.select("host", F.explode("nodes").alias("node"))
    free = seen.filter("free > 0").join(nested.select("host", F.explode("constants").alias("token")), ["host", "token"], "left_anti")
    free = free.groupBy("host", "place").agg(F.sum("free").alias("free"), F.sum("heading").alias("heading"))
    total = free.groupBy("host").agg(F.sum("free").alias("all_free"), F.sum("heading").alias("all_heading"))
    around = F.expr("transform(sequence(1, size(split(place, '>'))), i -> array_join(slice(split(place, '>'), 1, i), '>'))")
    masses = free.withColumn("node", F.explode(around)).groupBy("host", "node").agg(F.sum("free").alias("free"), F.sum("heading").alias("heading"))
    fit = masses.join(nodes, ["host", "node"]).join(total, "host").filter((F.col("free") > MOST * F.col("all_free")) & (F.col("heading") >= F.col("all_heading")))
    named = F.regexp_extract("node", "([^>.]*)[^>]*$", 1).isin("article", "main")
    slots = fit.groupBy("host").agg(F.max_by("node", F.struct(named, F.length("node"), "node")).alias("slot"))
    return sizes.select("host").join(constants, "host", "left").join(slots, "host", "left")


def extract(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html).

    A null or empty html, and a page whose article is empty, give an empty text. Character references are decoded, white space
    inside a block is one space, blocks are joined by a line break in page order; nothing is cut. A null
    url counts as a host of its own name ''; hosts with fewer than `least` pages have no template. Repeated rows keep their rows, other columns are ignored, an empty table gives an empty one."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host().alias("host"))
    # as a table its size is known, and Spark broadcasts it only if that is small
    return rows.join(written(templates(pages, support, least)), "host", "left").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
