"""Entity-tag graph: claims, edges, expansion, coverage, closure and incremental id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.functions import text as X
from farsight.functions.order import ordered
from farsight.operators.clean import keep_last, keep_one
from farsight.sources.shared import cut


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not in old, one for each key (K3)."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """old with the last new row of each key in place of its own."""
    last = keep_last(new, keys, *order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def unlabeled(seen: DataFrame, labels: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Ids without a label, in order if limited."""
    rest = seen.join(labels.select(key), key, "left_anti")
    return rest if limit is None else rest.orderBy(key).limit(limit)


def table_counts(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """seen, labeled and their difference."""
    a, b = seen.agg(F.count("*").alias("seen")), labels.agg(F.count("*").alias("labeled"))
    return a.join(b).select("seen", "labeled", (F.col("seen") - F.col("labeled")).alias("unlabeled"))


def new_by_canonical_label(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose canonical label no earlier output has."""
    known = done.select(X.canonical_label(F.col("label")).alias("canon")).distinct()
    return items.withColumn("canon", X.canonical_label(F.col("label"))).join(known, "canon", "left_anti").drop("canon")


def missing_tags(tags: DataFrame, cache: DataFrame, key: str = "tag") -> DataFrame:
    """Tags that the cache lacks, sorted."""
    return tags.select(key).distinct().join(cache.select(key), key, "left_anti").orderBy(key)


def item_values(claims: DataFrame) -> DataFrame:
    """Claims whose value is an item with an id."""
    return claims.filter("value_type = 'wikibase-item' and trim(value_qid) <> ''")


def related_tags(claims: DataFrame, any_case: bool = True) -> DataFrame:
    """(qid, related_tags): item values, one for each value id in order, without those that name the item."""
    values = keep_one(item_values(claims).filter("value_qid <> qid"), ["qid", "value_qid"], "pos")
    values = values.filter(~X.refers_to_itself(F.col("item_label"), F.col("value_label"), any_case))
    return ordered_lists(values, "qid", "pos", F.struct(F.col("value_qid").alias("qid"), F.col("value_label").alias("label")), "related_tags")


def ordered_lists(df: DataFrame, key: str, pos: str, value, name: str) -> DataFrame:
    """Lists of values by key in the order of pos."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v"))))
    return df.groupBy(key).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def grouped_claims(claims: DataFrame) -> DataFrame:
    """Claims as a map from property to its label and distinct values."""
    distinct = keep_one(claims, ["qid", "pid", "value_qid", "value"], "pos")
    by = distinct.groupBy("qid", "pid").agg(
        F.min_by("property_label", "pos").alias("property_label"),
        F.array_sort(F.collect_list(F.struct("pos", "value_type", "value_qid", "value_label", "value", "datatype"))).alias("values"),
    )
    return by.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pid", F.struct("property_label", "values").alias("x"))))).alias("claims"))


def claim_union(*sources: DataFrame) -> DataFrame:
    """Union of statement, qualifier, reference and direct claims(qid, pid, value_qid, value, pos), distinct by item, property and value: an item's id or
    else the literal. Of equal claims the first source's first stays (U1)."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("__s", F.lit(i)) for i, s in enumerate(sources)))
    every = every.withColumn("__v", F.coalesce(F.concat(F.lit("i:"), F.nullif("value_qid", F.lit(""))), F.concat(F.lit("l:"), F.col("value").cast("string"))))
    return keep_one(every, ["qid", "pid", "__v"], "__s", "pos", "value_qid", "value").drop("__s", "__v")


def with_fallback(primary: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """primary, and rows of other for keys that primary lacks."""
    return primary.unionByName(other.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def resolve_labels(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """Tags with the smallest id that has exactly their label and language; unmatched keep null, blanks go."""
    ids = labels.groupBy("lang", "label").agg(F.min("qid").alias("qid"))
    return tags.filter(X.strip("label") != "").join(ids, ["lang", "label"], "left")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(dst, hops): the sorted different neighbours of every node that is a target and has some, once a node: edges refer to it by dst.

    Of repeated edges one is left before the lists are made, so that they and the work grow with the different edges, not with paths."""
    targets = edges.select("dst").distinct()
    steps = edges.select(F.col("src").alias("dst"), F.col("dst").alias("hop")).distinct()
    return steps.join(targets, "dst", "left_semi").groupBy("dst").agg(F.sort_array(F.collect_list("hop")).alias("hops"))


def one_hop(edges: DataFrame) -> DataFrame:
    """(src, dst, hops): each edge with the sorted neighbours of its target, [] if none (J7). For export: neighbour_lists has each list once."""
    lists = neighbour_lists(edges)
    none = F.array().cast(lists.schema["hops"].dataType)
    return edges.join(lists, "dst", "left").select("src", "dst", F.coalesce("hops", none).alias("hops"))


def unique_nodes(edges: DataFrame) -> DataFrame:
    """(node, label): nodes at depth 1 and 2 of edges(src, dst, label, pos) with their first label: near ones first, then by the place of the first edge, then of the second.

    Both steps follow the same edges, so a node two steps away is the target of an edge as well, and that near one decides; the second step adds no node and no label. Each node's first
    place is found for each of its labels, as numbers that add up in a hash table before the shuffle; only then do the few labels of a node meet."""
    first = edges.groupBy("dst", "label").agg(F.count("pos").alias("n"), F.count("*").alias("all"), F.min("pos").alias("pos"))
    first = first.withColumn("pos", F.when(F.col("n") == F.col("all"), F.col("pos")))  # a null place comes first
    return first.groupBy(F.col("dst").alias("node")).agg(F.min_by("label", F.struct("pos", "label")).alias("label"))


def normalised_tags(items: DataFrame) -> DataFrame:
    """(qid, pos, tag, label): tags distinct by id and without the item itself; tags that are only text are all kept."""
    tags = items.select(F.col("qid"), F.posexplode("related_tags").alias("pos", "t")).select("qid", "pos", F.col("t.qid").alias("tag"), F.col("t.label").alias("label"))
    named = keep_one(tags.filter("tag is not null and tag <> qid"), ["qid", "tag"], "pos")
    return named.unionByName(tags.filter("tag is null"))


def universe(edges: DataFrame) -> DataFrame:
    """All nodes: sources and targets."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def target_ids(items: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct item ids among nodes, or tag ids if no item is (A10)."""
    first = items.select("qid").distinct().join(nodes.select(F.col("node").alias("qid")), "qid", "left_semi")
    return first if not first.isEmpty() else tags.select("qid").distinct().join(nodes.select(F.col("node").alias("qid")), "qid", "left_semi")


def tag_statistics(items: DataFrame) -> DataFrame:
    """Items, tags, tags with and without an id, and one-hop tags."""
    t = items.select(F.explode_outer("related_tags").alias("t"))
    return items.agg(F.count("*").alias("items")).join(
        t.agg(
            F.count("t").alias("tags"),
            F.count_if(F.col("t.qid").isNotNull()).alias("with_id"),
            F.count_if(F.col("t").isNotNull() & F.col("t.qid").isNull()).alias("without_id"),
            F.coalesce(F.sum(F.when(F.col("t.one_hop_related_tags").isNotNull(), F.size("t.one_hop_related_tags"))), F.lit(0)).alias("one_hop"),
        )
    )


def full_coverage(pages: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Pages, and items that have none."""
    return pages.unionByName(items.join(pages.select(key), key, "left_anti"), allowMissingColumns=True)


def covered_edges(edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends have a page, and sources that keep none."""
    kept = edges.join(pages.select(F.col("node").alias("src")), "src", "left_semi").join(pages.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept, edges.select("src").distinct().join(kept.select("src"), "src", "left_anti")


def covered_list(lists: DataFrame, pages: DataFrame, key: str, values: str) -> DataFrame:
    """Lists with only the values that have a page, repeats and order kept; lists without any stay empty."""
    rows = lists.select(key, F.posexplode_outer(values).alias("p", "v"))
    flagged = rows.join(pages.select(F.col("node").alias("v"), F.lit(True).alias("hit")), "v", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("p", "v"))))
    return flagged.groupBy(key).agg(F.transform(found, lambda x: x["v"]).alias(values))


def relation_coverage(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return covered_edges(edges, pages)[0]


def coverage_flags(edges: DataFrame, pages: DataFrame, neutrals: DataFrame) -> DataFrame:
    """Each edge with whether it is kept: its tag has a page, and the tag or else the item has a neutral list."""
    flags = lambda df, col, name: df.select(F.col("node").alias(col)).distinct().withColumn(name, F.lit(True))
    df = edges.join(flags(pages, "dst", "tag_page"), "dst", "left").join(flags(neutrals, "dst", "tag_list"), "dst", "left").join(flags(neutrals, "src", "item_list"), "src", "left")
    page, own, item = (F.coalesce(c, F.lit(False)) for c in ("tag_page", "tag_list", "item_list"))
    return df.select("src", "dst", F.when(~page, "no_page").when(own, "tag_list").when(item, "item_list").otherwise("no_list").alias("outcome"))


def coverage_counters(flags: DataFrame) -> DataFrame:
    by = flags.groupBy("src").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("no_page", "tag_list", "item_list", "no_list")))
    kept = F.col("tag_list") + F.col("item_list")
    return by.agg(
        F.count("*").alias("items"), F.count_if(kept > 0).alias("items_kept"), F.count_if(kept == 0).alias("items_dropped"),
        F.sum("no_page").alias("tags_without_page"), F.sum("no_list").alias("tags_without_list"), F.sum("item_list").alias("tags_by_item_list"), F.sum(kept).alias("tags_kept"),
    )


def neutral_lists(edges: DataFrame, neutrals: DataFrame) -> DataFrame:
    """(src, dst, neutral, pos): the tag's list, else the item's."""
    own = edges.join(neutrals.select(F.col("node").alias("dst"), "neutral", "pos"), "dst")
    rest = edges.join(neutrals.select(F.col("node").alias("dst")), "dst", "left_anti")
    return own.select("src", "dst", "neutral", "pos").unionByName(rest.join(neutrals.select(F.col("node").alias("src"), "neutral", "pos"), "src").select("src", "dst", "neutral", "pos"))


def tag_pages(tags: DataFrame, pages: DataFrame) -> DataFrame:
    """Tags whose trimmed text is a page title; a blank tag is an error."""
    t = X.strip("tag")
    named = tags.select(F.when(t != "", t).otherwise(F.raise_error(F.lit("blank tag")).cast("string")).alias("tag"))
    return named.join(pages, F.col("tag") == F.col("title"))


def page_titles(ids: DataFrame, sitelinks: DataFrame, lang: str) -> DataFrame:
    """Page titles of ids in one language, without fallback."""
    return ids.join(sitelinks.filter(F.col("lang") == lang), "qid")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes from which a chain of edges(child, parent) of any length leads to a start node, and these (U4).

    Each round is checkpointed in the shared folder; cycles end by themselves, as a round only follows nodes that are new."""
    found = front = cut(start.select("node").distinct())
    while not front.isEmpty():
        parents = front.select(F.col("node").alias("parent"))
        front = cut(edges.join(parents, "parent", "left_semi").select(F.col("child").alias("node")).distinct().join(found, "node", "left_anti"))
        found = cut(found.union(front))
    return found


def merge_cache(old: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows without a key as they are; the first row of each key, refreshed from the cache; new keys last, in the order of their ids after the last place (K8)."""
    value = "wikipedia_first_paragraph"
    fresh = cache.select("qid", F.col(value).alias("fresh"))
    first = keep_one(old.filter("qid is not null"), ["qid"], "pos").join(fresh, "qid", "left").withColumn(value, F.coalesce("fresh", value)).drop("fresh")
    last = old.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))  # one row
    new = cache.join(old.select("qid"), "qid", "left_anti")
    new = new.join(ordered(new, "qid").withColumnRenamed("node", "qid"), "qid").join(F.broadcast(last)).withColumn("pos", F.col("last") + F.col("idx") + 1).drop("last", "idx")
    return old.filter("qid is null").unionByName(first).unionByName(new, allowMissingColumns=True)
