"""Audit of how the sources of a language differ in their terms, from exact counts.

Terms are counted by runs of texts, whose documents stand by language and source. Their bytes are packed by length: up to 8 become one unsigned
64-bit number, up to 16 two, most significant byte first; these are radix-sorted and runs of equal ones counted in numpy. Longer terms go to buckets by
length, twice as wide from one to the next, that are sorted by bytes. A sort keeps the order of documents, so one pass over a
run of equal terms gives its number of occurrences and of documents by source. Spark adds up what the runs have found.

Documents per term decide which terms a language keeps. Shares are whole numbers of parts in a thousand million. The sources' distances are sums
over all kept terms of a language, worked out for all its sources by blocks of terms and added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import documents, gathered, runs, texts, tidy, words_of, written

#: Bytes of texts that are counted together, about, and entries of the blocks of terms by sources.
RUN, CELLS = 8 << 20, 1 << 20
#: Bytes that are no part of a term: all ASCII but letters.
APART = np.ones(256, bool)
APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PARTS = 1_000_000_000


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """Spans of at most 8 * words bytes, none of them 0, as so many unsigned 64-bit numbers, in the order of their bytes."""
    out = []
    for w in range(words):
        number = np.zeros(len(starts), np.uint64)
        for j in range(8 * w, 8 * w + 8):
            here = np.flatnonzero(sizes > j)
            if not len(here):
                break
            number[here] |= data[starts[here] + j].astype(np.uint64) << np.uint64(8 * (7 - j % 8))
        out.append(number)
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows by their 64-bit numbers, the first the most significant, 16 bits at a time from the last."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in (0, 16, 32, 48):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def byte_rows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Spans of at most width bytes, none of them 0, as byte strings of one width."""
    rows = np.zeros(len(starts) * width, np.uint8)
    first = np.cumsum(sizes) - sizes
    rows[np.repeat(np.arange(len(starts)) * width - first, sizes) + np.arange(int(sizes.sum()))] = gathered(data, starts, sizes)
    return rows.view(f"S{width}")


def counted_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of the term, its size, group, occurrences, documents) of each different term and group; the spans stand by group and document."""
    sizes = ends - starts
    width = 8
    while True:
        here = np.flatnonzero((sizes > (width // 2 if width > 8 else 0)) & (sizes <= width))
        if len(here):
            start, size = starts[here], sizes[here]
            keys = packed(data, start, size, width // 8) if width <= 16 else [byte_rows(data, start, size, width)]
            order = radix_order(keys) if width <= 16 else np.argsort(keys[0], kind="stable")
            place = here[order]
            new = np.ones(len(order), bool)
            new[1:] = group[place[1:]] != group[place[:-1]]
            for key in keys:
                new[1:] |= key[order[1:]] != key[order[:-1]]
            more = new.copy()
            more[1:] |= doc[place[1:]] != doc[place[:-1]]
            first = np.flatnonzero(new)
            yield starts[place[first]], sizes[place[first]], group[place[first]], np.diff(np.append(first, len(order))), np.add.reduceat(more.astype(np.int64), first)
        if not (sizes > width).any():
            return
        width *= 2


NAMES = ["lang", "source", "term", "n", "docs"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        numbers: dict[tuple[str, str], int] = {}
        group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(lang, source, strict=True)], np.int64)
        order = np.argsort(group, kind="stable")  # a run then has few groups
        raw, group = texts(batch), group[order]
        raw = [raw[i] for i in order.tolist()]
        langs, sources = (pa.array([g[i] for g in numbers], pa.string()) for i in (0, 1))
        for lo, hi in runs([len(t) for t in raw], RUN):
            terms = words_of([t.lower() for t in raw[lo:hi]], APART)  # bytes: A-Z only
            doc = np.repeat(np.arange(hi - lo), terms.sizes)
            for start, size, of, n, docs in counted_terms(terms.data, terms.starts, terms.ends, doc, group[lo:hi][doc]):
                spelled = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(gathered(terms.data, start, size))])
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), spelled, pa.array(n), pa.array(docs)], NAMES)


def shares(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(PARTS * (n + 5) / (total + 5 * kept)), exactly: in Python's numbers where 64 bits don't hold the product."""
    if len(n) and int(n.max()) + 5 > (1 << 62) // PARTS:
        n, total = n.astype(object), np.asarray(total).astype(object)
    return (1 + PARTS * (n + 5) // (total + 5 * kept)).astype(np.int64)


def share(n: Column, total: Column, kept: Column) -> Column:
    """shares as a column; kept must be over 0."""
    wide = lambda x: x.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * wide(n + 5), wide(total + 5 * kept))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the differences of shares, by language and two of its sources, over the terms of a task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        codes = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            rows = np.flatnonzero(codes.indices.to_numpy() == k)
            first = batch.slice(int(rows[0]), 1)
            kept, names = first.column("kept")[0].as_py(), first.column("sources").flatten()
            total = first.column("totals").flatten().to_numpy()
            base = shares(np.zeros(len(total), np.int64), total, kept)
            found = batch.column("found").take(pa.array(rows))
            size = np.diff(found.offsets.to_numpy())
            entry = found.flatten()
            source = pc.index_in(entry.field("source"), value_set=names).to_numpy()
            p = shares(entry.field("n").to_numpy(), total[source], kept)
            held = sums.setdefault(lang, np.zeros((len(total), len(total)), np.int64))
            ends = np.cumsum(size)
            step = max(1, CELLS // len(total))
            for lo in range(0, len(rows), step):
                hi = min(lo + step, len(rows))
                dense = np.tile(base, (hi - lo, 1))
                a, b = int(ends[lo] - size[lo]), int(ends[hi - 1])
                dense[np.repeat(np.arange(hi - lo), size[lo:hi]), source[a:b]] = p[a:b]
                for i in range(len(total) - 1):
                    held[i, i + 1 :] += np.abs(dense[:, i + 1 :] - dense[:, i : i + 1]).sum(0)
    for lang, held in sums.items():
        i, j = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[i, j])], ["lang", "i", "j", "value"])


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source); nulls in these are empty strings.

    A language keeps the terms that at least `least` of its documents have; a document is a row. A source's share p of a kept term is 1 + floor(10^9 * (count + 5) / (N + 5 * V)), with N the source's
    occurrences of the V kept terms; q is the language's. Part `pair`: each other source of the language, with the sum of the differences of their shares over all kept terms, 0 if
    there are none. Part `term`: kept terms that the source has more often than its language, by p - q, the first `top`. Ranks go by value, highest first, then by item in the order of its bytes.
    Repeated rows count each. Other columns are ignored; an empty table gives an empty one, a lone source no pairs."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = docs.mapInArrow(tidy(_counted), "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.collect_list(F.struct("source", "n"))  # an entry a source at most
    terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), entry.alias("found"))
    terms = written(terms.filter(F.col("docs") >= least).drop("docs"))
    totals = terms.select("lang", F.explode("found").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("every"))
    by_source = F.array_sort(F.collect_list(F.struct("source", "total")))
    langs = groups.groupBy("lang").agg(by_source.alias("s")).join(kept, "lang", "left")
    langs = written(langs.select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), "kept", "every"))

    sums = terms.select("lang", "found").join(langs.drop("every"), "lang").mapInArrow(tidy(_distances), "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    one = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source")).repartition("lang", "source")
    both = one.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    pairs = both.select("lang", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    sized = langs.select("lang", "kept", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", "kept", F.col("x.sources").alias("source"), F.col("x.totals").alias("total"))
    q = terms.join(langs.select("lang", "kept", "every"), "lang").withColumn("q", share(F.col("all"), F.col("every"), F.col("kept")))
    each = q.select("lang", "term", "q", F.explode("found").alias("x")).select("lang", "term", "q", "x.source", "x.n").join(sized, ["lang", "source"])
    over = each.withColumn("value", share(F.col("n"), F.col("total"), F.col("kept")) - F.col("q")).filter("value > 0")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = over.withColumn("rank", place).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(ranked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), least=30, top=50)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY 1),
c AS (SELECT x.lang, x.source, x.term, count(*)::HUGEINT AS c FROM x JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (s.n + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 5) // (l.n + 5 * l.v) AS q
    FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
