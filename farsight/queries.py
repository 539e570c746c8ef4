"""The registered queries of the library on the given tables, and their SQL.

Edges, neutrals and scores that the tables don't hold are derived from them in Spark, here and in the SQL alike."""

from __future__ import annotations

import re

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight import file_queries, item_queries
from farsight.functions import text as X
from farsight.functions import vectors as V
from farsight.functions.order import ordered, placed
from farsight.operators import clean, encode, graph, models, neutral, ranking, sampling, scores, stats
from farsight.sources.shared import cut

ORDERS = [10, 25, 50]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- retrieval ranks and scores -------------------------------------------------------------------------------------


def _ring(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bank; edges from each vector to the next four of its label; neutrals of each vector from other labels."""
    bank = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding", "label")
    numbered = placed(bank.select("qid", "label", F.md5(F.col("qid").cast("string")).alias("h")), "h", "qid", ["label"]).select("qid", "label", (F.col("__r") - 1).alias("i"))
    sizes = numbered.groupBy("label").agg(F.count("*").alias("size"))
    numbered = numbered.join(sizes, "label")
    steps = numbered.withColumn("k", F.explode(F.array(*map(F.lit, range(1, 5))))).withColumn("j", (F.col("i") + F.col("k")) % F.col("size"))
    edges = steps.join(numbered.select("label", F.col("i").alias("j"), F.col("qid").alias("tag")), ["label", "j"]).filter("qid <> tag")
    edges = edges.select("qid", "tag").distinct()
    idx = ordered(bank.select(F.col("qid").alias("node")))
    size = idx.count()
    drawn = bank.select(F.col("qid").alias("tag"), "label", F.explode(F.sequence(F.lit(1), F.lit(3 * max(ORDERS)))).alias("j"))
    drawn = drawn.withColumn("idx", F.expr(neutral.draw("tag", "j", 1, str(max(size, 1))))).join(idx, "idx")
    drawn = drawn.join(bank.select(F.col("qid").alias("node"), F.col("label").alias("other")), "node").filter("label <> other")
    first = drawn.groupBy("tag", "node").agg(F.min("j").alias("j"))
    pos = F.row_number().over(Window.partitionBy("tag").orderBy("j"))
    return bank, edges, first.select("tag", F.col("node").alias("neutral"), pos.alias("pos"))


_RING = f"""
WITH b AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS size,
    row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS total FROM embeddings),
edges AS (SELECT DISTINCT a.qid, t.qid AS tag FROM b a, range(1, 5) k(k), b t WHERE t.label = a.label AND t.i = (a.i + k.k) % a.size AND t.qid <> a.qid),
drawn AS (SELECT b.qid AS tag, b.label, j.j, ('0x' || substr(md5('1|' || b.qid || '|' || j.j), 1, 12))::BIGINT % b.total AS idx
    FROM b, range(1, {3 * max(ORDERS) + 1}) j(j)),
first AS (SELECT d.tag, n.qid AS neutral, min(d.j) AS j FROM drawn d JOIN b n ON n.idx = d.idx WHERE n.label <> d.label GROUP BY 1, 2),
neutrals AS (SELECT tag, neutral, row_number() OVER (PARTITION BY tag ORDER BY j) AS pos FROM first),
ns AS (SELECT n.tag, n.pos, round(list_dot_product(t.e, u.e), 9) AS sim FROM neutrals n JOIN b t ON t.qid = n.tag JOIN b u ON u.qid = n.neutral),
os AS (SELECT e.qid, e.tag, round(list_dot_product(t.e, u.e), 9) AS s0 FROM edges e JOIN b t ON t.qid = e.tag JOIN b u ON u.qid = e.qid),
ranks AS (SELECT os.qid, os.tag, o.n, (count(*) FILTER (ns.pos < o.n AND ns.sim > os.s0) + 1)::INT AS rank, (count(*) FILTER (ns.pos < o.n) + 1)::INT AS sample_size
    FROM os JOIN (VALUES {', '.join(f'({n})' for n in ORDERS)}) o(n) ON true LEFT JOIN ns ON ns.tag = os.tag GROUP BY 1, 2, 3)
"""


def _ranks(spark: SparkSession, d: str, orders: list[int] | None = None) -> DataFrame:
    bank, edges, neutrals = _ring(spark, d)
    return ranking.ranks(edges, neutrals, bank, orders or ORDERS)


def rps_by_item(spark, d):
    """Retrieval probability score of each item: share of its ranks under 10 among 49 neutrals."""
    r = _ranks(spark, d, [50]).groupBy("qid").agg(F.collect_list("rank").alias("r"))
    return r.select("qid", F.round(scores.below("r", 10), 9).alias("rps"), F.size("r").cast("long").alias("tags"))


def rank_table(spark, d):
    return _ranks(spark, d)


def block_rank_table(spark, d):
    bank, edges, neutrals = _ring(spark, d)
    return ranking.block_ranks(edges, neutrals, bank, 50)


def rps_sweep_high_low(spark, d):
    s = _ranks(spark, d).groupBy("qid", "n").agg(F.collect_list("rank").alias("r")).select("n", scores.below("r", 5).alias("score"))
    return scores.on_grid(scores.high_low(s), n=[*ORDERS, 100]).select("n", *(F.round(F.col(c).cast("double"), 9).alias(c) for c in ("high", "low", "ratio")))


def retriever_sweep(spark, d):
    """High scores by retriever (each half of the vectors serves as one) and order, with the retrievers' places at the first order."""
    bank, edges, neutrals = _ring(spark, d)
    half = lambda lo: bank.select("qid", F.slice("embedding", lo, 16).alias("embedding"))
    r = ranking.sweep(edges, neutrals, {"front": half(1), "back": half(17)}, ORDERS)
    s = r.groupBy("retriever", "qid", "n").agg(F.collect_list("rank").alias("r")).select("retriever", "n", scores.below("r", 5).alias("score"))
    found = ranking.by_first(scores.high_low(s, by=("retriever", "n")), "ratio", ORDERS[0])
    return found.select("retriever", "n", "high", "low", F.round("ratio", 9).alias("ratio"), F.col("place").cast("long").alias("place"))


def rank_risk_scores(spark, d):
    r = _ranks(spark, d, [50]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tag", "rank"))).alias("x")).select("qid", F.transform("x", lambda v: v["rank"]).alias("r"))
    named = {"worst": "worst_rank", "mean": "mean_rank", "p90": "percentile_rank", "combo": "minmax_combo", "logc": "dev_log_num_tags", "power": "dev_num_tags_inverse_power", "below": "portion_below_k", "top": "exists_in_top_k"}
    both = scores.combined(F.col("r"), ["worst_rank", "mean_rank"], [0.25, 0.75])
    return r.select("qid", *(F.round(scores.score(n)(F.col("r")).cast("double"), 6).alias(k) for k, n in named.items()), F.round(both, 6).alias("combined"))


def rank_export(spark, d):
    return ranking.wide(_ranks(spark, d)).select("qid", *(F.array_join(f"rank_among_unrelevant_tags_{n}", ",").alias(f"r{n}") for n in ORDERS))


def paired_cosine_score(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.paired_cosine(F.col("embedding")), 9).alias("score"))


def unit_vectors(spark, d):
    v = V.normalised(F.transform("embedding", lambda x: x.cast("double") * 3 + 1))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 9).alias("norm"), F.round(F.get(v, F.lit(5)), 9).alias("fifth"))


# --- cleaning and keep rules ----------------------------------------------------------------------------------------


def keep_first_canonical(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("label"), F.col("source").alias("file"), F.col("doc_id").alias("pos"))
    return clean.keep_first_canonical(docs).select("doc_id", F.md5("canon").alias("canon"))


def keep_longest_page(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", "text")
    return clean.keep_longest(docs, ["lang", "source"], "text", "doc_id").select("lang", "source", "doc_id")


def last_value_by_user(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return clean.keep_last(e, ["user_id"], "ts", "event_id").select("user_id", "event_type", "event_id")


def clean_paragraphs(spark, d):
    docs = table(spark, d, "documents")
    p = X.clean_paragraph(X.first_paragraph(F.col("text")))
    return docs.select("doc_id", F.md5(F.coalesce(p, F.lit("-"))).alias("paragraph"), X.stub_paragraph(F.col("text")).alias("stub"))


def usable_labels(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.filter(X.usable_label(F.col("p_name"))).withColumn("self", X.refers_to_itself(F.substring("p_name", 1, 4), F.col("p_name"), True))


def unique_words(spark, d):
    p = table(spark, d, "part").select(F.split("p_name", " ").alias("a"), F.array("p_brand").alias("b"))
    return clean.unique_tags(p, ["a", "b"])


def pair_texts(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(X.pair_text(F.col("role"), F.col("text"))).alias("pair"), X.tag_name(F.col("role"), F.lit(""), F.col("turn")).alias("name"))


def url_parts(spark, d):
    p = table(spark, d, "pages")
    iri = F.replace(F.col("url"), F.lit("/en/"), F.lit("/entity/"))
    return p.select("page_id", X.iri_tail(iri).alias("tail"), X.value_type(F.col("url"), F.lit("string")).alias("kind"), F.md5(X.escape_literal(F.col("html"))).alias("escaped"))


def phrase_places(spark, d):
    docs = table(spark, d, "documents")
    low = X.occurrence(F.col("text"), F.lit("the"), 3)
    first, last = X.token_window(F.coalesce(low, F.lit(0)), F.coalesce(low, F.lit(0)) + 3, F.greatest(F.length("text"), F.lit(3)), 512)
    return docs.select("doc_id", F.coalesce(low, F.lit(-1)).alias("at"), first.alias("w0"), last.alias("w1"))


# --- graph ----------------------------------------------------------------------------------------------------------


def _edges(spark, d):
    """Distinct part -> supplier edges with the first line as their place."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return e.agg(F.min("l_orderkey").cast("long").alias("pos"))


_EDGES = "WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_orderkey)::BIGINT AS pos FROM lineitem GROUP BY 1, 2)"


def relation_edges(spark, d):
    return graph.ordered_lists(_edges(spark, d), "src", "pos", F.col("dst"), "l").select("src", F.size("l").cast("long").alias("n"), F.array_join(F.array_sort("l"), ",").alias("tags"))


def one_hop(spark, d):
    n = table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("src"), (F.col("s_nationkey") + 20_000_000).cast("long").alias("dst"))
    e = _edges(spark, d).select("src", (F.col("dst") + 10_000_000).alias("dst")).unionByName(n)
    return graph.one_hop(e).select("src", "dst", F.array_join("hops", ",").alias("hops"))


def unique_nodes(spark, d):
    """Suppliers by the parity of the line that leads to them, nations by the supplier's balance: most nodes have two labels."""
    n = table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("src"), (F.col("s_nationkey") + 20_000_000).cast("long").alias("dst"), F.when(F.col("s_acctbal") > 0, "credit").otherwise("debit").alias("label"), F.col("s_suppkey").cast("long").alias("pos"))
    e = _edges(spark, d).select("src", (F.col("dst") + 10_000_000).alias("dst"), F.when(F.col("pos") % 2 == 0, "even").otherwise("odd").alias("label"), "pos").unionByName(n)
    return graph.unique_nodes(e)


def class_closure(spark, d):
    """Suppliers, nations and regions under the first two regions."""
    r = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    start = table(spark, d, "region").filter("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.closure(r.unionByName(s), start)


def _covered(spark, d):
    pages = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    parts = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node"))
    return _edges(spark, d).select("src", "dst"), pages, parts


def coverage_counters(spark, d):
    edges, pages, parts = _covered(spark, d)
    return graph.coverage_counters(graph.coverage_flags(edges, pages, parts))


def covered_edges(spark, d):
    edges, pages, parts = _covered(spark, d)
    kept = edges.join(pages.select(F.col("node").alias("dst")), "dst", "left_semi").join(parts.select(F.col("node").alias("src")), "src", "left_semi")
    return kept.select("src", "dst")


def covered_lists(spark, d):
    edges, pages, _ = _covered(spark, d)
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("v"))
    return graph.covered_list(lists, pages, "src", "v").select("src", F.array_join("v", ",").alias("v"))


def neutral_sample(spark, d):
    """Ten suppliers for each part that don't supply it."""
    e = _edges(spark, d)
    return neutral.neutral_sample(
        table(spark, d, "part").select(F.col("p_partkey").alias("target")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")),
        e.select(F.col("src").alias("target"), F.col("dst").alias("node")), 10,
    ).select("target", "neutral")


def unlabeled_ids(spark, d):
    done = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    seen = table(spark, d, "customer").select("c_custkey")
    return graph.unlabeled(seen, done, "c_custkey")


def id_counts(spark, d):
    seen, done = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey").distinct()
    return graph.table_counts(seen, done)


def upsert_labels(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("label"), "event_id", "value")
    old, new = e.filter("value < 50"), e.filter("value >= 50")
    base = clean.keep_last(old, ["user_id"], "event_id")
    return graph.upsert(base, new, ["user_id"], "event_id").select("user_id", "label")


def insert_ignore(spark, d):
    old = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey")
    return graph.insert_or_ignore(old, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- items built from the tables: tags of a part are its suppliers, labels are names --------------------------------


def _items(spark, d):
    """(qid, label, related_tags): parts with their suppliers in the order of lines, of which some lack an id."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("name"), "s_nationkey")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey", "l_linenumber").join(s, "dst")
    tag = F.struct(F.when(F.col("s_nationkey") > 2, F.concat(F.lit("Q"), "dst")).alias("qid"), F.col("name").alias("label"))
    lists = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "dst", tag.alias("t"))))
    lists = rows.groupBy("src").agg(F.transform(lists, lambda x: x["t"]).alias("related_tags"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("label"), "p_brand")
    return parts.join(lists, "src").select(F.concat(F.lit("Q"), "src").alias("qid"), "label", "p_brand", "related_tags")


_ITEMS = """WITH t AS (SELECT 'Q' || l_partkey AS qid, CASE WHEN s_nationkey > 2 THEN 'Q' || l_suppkey END AS tag, s_name AS label,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS pos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""


def normalised_tags(spark, d):
    n = graph.normalised_tags(_items(spark, d))
    return n.select("qid", F.col("pos").cast("long").alias("pos"), "tag", "label")


def tag_statistics(spark, d):
    items = _items(spark, d)
    hops = F.transform("related_tags", lambda t: F.struct(t["qid"].alias("qid"), t["label"].alias("label"), F.when(t["qid"].isNotNull(), F.array(t["label"], t["label"])).alias("one_hop_related_tags")))
    return graph.tag_statistics(items.withColumn("related_tags", hops))


def node_universe(spark, d):
    return graph.universe(_edges(spark, d).select("src", (F.col("dst") + 10_000_000).alias("dst")))


def target_ids(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("qid"))
    nodes = _edges(spark, d).select(F.col("src").alias("node")).filter("node % 3 = 0")
    return graph.target_ids(items, nodes, table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid")))


def fallback_ids(spark, d):
    """Ids of suppliers, as no item is among the nodes."""
    items = table(spark, d, "part").select((F.col("p_partkey") + 10_000_000).alias("qid"))
    nodes = _edges(spark, d).filter("dst % 3 = 0").select(F.col("dst").alias("node"))
    return graph.target_ids(items, nodes, table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid")))


def first_unlabeled(spark, d):
    """The first 30 customers without a large order."""
    done = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return graph.unlabeled(table(spark, d, "customer").select("c_custkey"), done, "c_custkey", 30)


def named_exactly(spark, d):
    """Parts whose name holds their brand's last letters as they are, and in any case."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.upper(F.substring("p_name", 2, 3)).alias("item"))
    return p.select("p_partkey", X.refers_to_itself(F.col("item"), F.col("p_name"), False).alias("exact"), X.refers_to_itself(F.col("item"), F.col("p_name"), True).alias("any_case"))


def first_with_tags(spark, d):
    """First part of each brand's label that has usable tags."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 7).cast("string").alias("k"), F.split("p_name", " ").alias("related_tags"), F.col("p_brand").alias("label"), F.lit(0).alias("file"), F.col("p_partkey").alias("pos"))
    return clean.keep_first_with_tags(p.withColumn("qid", F.when(F.col("k") == "0", F.lit(" ")).otherwise(F.col("k")))).select(F.col("pos").cast("long").alias("pos"), F.array_join("related_tags", " ").alias("tags"))


def enriched_items(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("label"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("wikipedia_title"), F.col("lang").alias("wikipedia_lang"), F.substring("text", 1, 20).alias("wikipedia_first_paragraph"))
    e = clean.enriched(items, pages)
    return e.select("qid", "label", "wikipedia_checked", "wikipedia_exists", "wikipedia_lang", "wikipedia_title", F.md5("wikipedia_first_paragraph").alias("paragraph"))


def cache_records(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Q"), "o_custkey")).otherwise(" ").alias("qid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Q"), "o_orderkey")).otherwise(F.col("o_orderpriority")).alias("tag"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("label"), F.lit("").alias("wikipedia_lang"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")).alias("wikipedia_title"),
        F.col("o_orderkey").alias("wikipedia_first_paragraph"),
    )
    return clean.cache_record(rows)


def merged_cache(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("Q"), "user_id")).alias("qid"), F.col("event_type").alias("wikipedia_first_paragraph"), F.col("event_id").cast("long").alias("pos"))
    cache = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("Q"), "c_custkey").alias("qid"), F.concat(F.lit("p"), "c_custkey").alias("wikipedia_first_paragraph"))
    return graph.merge_cache(e, cache).select("qid", "wikipedia_first_paragraph", F.col("pos").cast("long").alias("pos"))


def covered_relations(spark, d):
    """Edges whose two ends have a page, and how many sources keep none."""
    edges, pages, parts = _covered(spark, d)
    edges, every = edges.withColumn("dst", F.col("dst") + 10_000_000), parts.union(pages.select(F.col("node") + 10_000_000))
    kept, none = graph.covered_edges(edges, every)
    return kept.select("src", "dst").withColumn("none", F.lit(none.count()))


def full_coverage(spark, d):
    pages = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("page"))
    return graph.full_coverage(pages, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")), "key")


def neutral_lists(spark, d):
    e = _edges(spark, d).select("src", (F.col("dst") + 10_000_000).alias("dst"))
    tags = table(spark, d, "supplier").filter("s_nationkey < 12").select((F.col("s_suppkey") + 10_000_000).alias("node"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("pos"))
    items = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("node"), F.lit(1).alias("pos"))
    lists = tags.unionByName(items).withColumn("neutral", F.col("node") * 10 + F.col("pos"))
    return graph.neutral_lists(e, lists).select("src", "dst", "neutral", F.col("pos").cast("long").alias("pos"))


def claim_union(spark, d):
    """Claims of lines by supplier (items) and by ship mode (literals), united."""
    li = table(spark, d, "lineitem")
    items = li.select(F.col("l_partkey").alias("qid"), F.lit("P1").alias("pid"), F.concat(F.lit("Q"), "l_suppkey").alias("value_qid"), F.lit(None).cast("string").alias("value"), F.col("l_orderkey").alias("pos"))
    texts = li.select(F.col("l_partkey").alias("qid"), F.lit("P2").alias("pid"), F.lit(None).cast("string").alias("value_qid"), F.col("l_returnflag").alias("value"), F.col("l_orderkey").alias("pos"))
    return graph.claim_union(items, texts, items).select("qid", "pid", "value_qid", "value", F.col("pos").cast("long").alias("pos"))


def capped_neutrals(spark, d):
    e = _edges(spark, d).select(F.lit(1).alias("qid"), F.col("src").alias("tag"), F.col("dst").alias("neutral"))
    return ranking.capped(e, 3).select("qid", "tag", "neutral", F.col("pos").cast("long").alias("pos"))


def keyword_filter(spark, d):
    words = ("ing", "07")
    return clean.drop_keyword_tags(_items(spark, d), words).select("qid", F.col("removed").cast("long").alias("removed"), F.size("related_tags").cast("long").alias("left"))


def clean_tag_lists(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array_append(F.split("p_name", " "), F.concat(F.lit("Q"), "p_partkey")).alias("tags"))
    return p.select("p_partkey", F.array_join(X.clean_tags(F.col("tags")), "|").alias("tags"))


def related_tags(spark, d):
    """Suppliers of a part that aren't the part itself, by order, one for each id."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("value_label"))
    li = table(spark, d, "lineitem").join(s, "l_suppkey").select(
        F.concat(F.lit("Q"), "l_partkey").alias("qid"), F.lit("wikibase-item").alias("value_type"), F.concat(F.lit("Q"), "l_suppkey").alias("value_qid"), "value_label",
        F.right(F.col("l_partkey").cast("string"), F.lit(1)).alias("item_label"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("pos"),
    )
    return graph.related_tags(li).select("qid", F.array_join(F.transform("related_tags", lambda t: t["qid"]), ",").alias("tags"))


def resolved_labels(spark, d):
    tags = table(spark, d, "events").select("event_id", F.lit("en").alias("lang"), F.col("event_type").alias("label"))
    labels = table(spark, d, "events").filter("event_id % 3 = 0").select(F.lit("en").alias("lang"), F.col("event_type").alias("label"), F.col("user_id").alias("qid"))
    return graph.resolve_labels(tags, labels).select("event_id", "qid")


def not_processed(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.when(F.col("o_orderkey") % 4 == 0, True).alias("wikipedia_checked"), F.when(F.col("o_orderkey") % 9 == 0, False).alias("wikipedia_exists"))
    return clean.not_processed(table(spark, d, "customer").select(F.col("c_custkey").alias("qid")), done)


# --- statistics -----------------------------------------------------------------------------------------------------


def score_normalize(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.select("o_orderkey", *(F.round(scores.normalised(o, "o_totalprice", m), 6).alias(m) for m in ("max", "zscore", "minmax")))


def score_histogram(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_totalprice", 20).withColumn("bin", F.col("bin").cast("long"))


def quantile_classes(spark, d):
    q = stats.quantile_classes(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5)
    return q.groupBy("class").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least")).withColumn("class", F.col("class").cast("long"))


def _predictions(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 50.0).cast("double").alias("y"), (F.col("l_quantity") / 60.0 + F.col("l_discount")).cast("double").alias("pred"), "l_linenumber")


_PREDICTIONS = "WITH p AS (SELECT (l_quantity / 50.0)::DOUBLE AS y, (l_quantity / 60.0 + l_discount)::DOUBLE AS pred, l_linenumber FROM lineitem)"


def regression_metrics(spark, d):
    m = stats.regression_metrics(_predictions(spark, d), by=("l_linenumber",))
    return m.select(F.col("l_linenumber").cast("long").alias("l_linenumber"), "n", *(F.round(c, 8).alias(c) for c in ("mse", "rmse", "mae", "r2", "pearson")))


def _classed(spark, d):
    return _predictions(spark, d).select(V.score_class(F.col("y")).alias("truth"), V.score_class(F.col("pred")).alias("pred"))


def confusion_matrix(spark, d):
    return stats.confusion(_classed(spark, d))


def class_metrics(spark, d):
    m = stats.class_metrics(_classed(spark, d))
    return m.select("class", "support", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")))


def kappa_mcc(spark, d):
    m = stats.overall_metrics(_classed(spark, d))
    return m.select("n", *(F.round(c, 8).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mcc", "kappa")))


def spearman(spark, d):
    return stats.spearman(_predictions(spark, d)).select(F.round("spearman", 6).alias("spearman"))


def seed_aggregate(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").cast("double").alias("value"))
    return stats.over_seeds(m).select("model", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def curve_band(spark, d):
    c = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("config"), (F.col("l_orderkey") % 97).alias("seed"), F.col("l_linenumber").cast("int").alias("epoch"))
    c = c.agg(F.max(F.col("l_quantity").cast("double")).alias("loss"))
    return stats.curve_band(c, 9).select(F.col("config").cast("long").alias("config"), F.col("epoch").cast("long").alias("epoch"), F.round("mean", 6).alias("mean"), "least", "most")


def loss_table(spark, d):
    return stats.losses(_predictions(spark, d).filter("y > 0 and y < 1"), beta=0.1).select(*(F.round(c, 8).alias(c) for c in ("mse", "mae", "smooth_l1", "kl")))


# --- samples --------------------------------------------------------------------------------------------------------


def _sample(mode: str, amount: float):
    def query(spark, d):
        o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
        return sampling.by_histogram(o, "o_totalprice", "o_orderkey", 10, mode, amount).select("o_orderkey", F.col("bin").cast("long").alias("bin"))

    return query


def extremes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.extremes(o, "o_totalprice", "o_orderkey", 0.1, 25).select("o_orderkey", "side")


def exact_split(spark, d):
    return sampling.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def stratified_split(spark, d):
    return sampling.split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", strata="o_orderpriority").select("o_orderkey", "part")


def worker_shards(spark, d):
    return sampling.shards(table(spark, d, "customer").select("c_custkey"), "c_custkey", 7).select("c_custkey", F.col("shard").cast("long").alias("shard"))


def sampled_ids(spark, d):
    return neutral.sample_ids(table(spark, d, "events").select(F.col("user_id").alias("id")), 20)


# --- encoders and models --------------------------------------------------------------------------------------------


def hash_embed(spark, d):
    e = encode.embed(table(spark, d, "documents").select("doc_id", "text"), "text")
    signs = F.array_join(F.transform("embedding", lambda x: F.signum(x).cast("int").cast("string")), ",")
    return e.select("doc_id", F.size("embedding").cast("long").alias("width"), F.round(V.norm(F.col("embedding")), 4).alias("norm"), signs.alias("signs"))


def _features(spark, d):
    e = table(spark, d, "embeddings")
    y = F.get("embedding", F.lit(0)).cast("double") + 0.5 * F.get("embedding", F.lit(1)).cast("double") + F.col("label") / 10.0
    return e.select(F.col("vec_id").alias("qid"), array_to_vector(V.doubles("embedding")).alias("features"), y.alias("y"), "label")


def principal_axes(spark, d):
    p = models.principal(_features(spark, d))
    return p.select("qid", F.round(F.abs(F.get("projection", F.lit(0))), 5).alias("a"), F.round(F.abs(F.get("projection", F.lit(1))), 5).alias("b"))


def discriminant_axes(spark, d):
    p = models.discriminant(_features(spark, d), "label")
    return p.select("qid", F.round(F.abs(F.get("projection", F.lit(0))), 4).alias("a"), F.round(F.abs(F.get("projection", F.lit(1))), 4).alias("b"))


def score_pairs(spark, d):
    train = cut(encode.embed(table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text", F.log1p("n_chars").alias("y")), "text").drop("text"))  # encoded once
    model = models.artifact(train.select("qid", array_to_vector(V.doubles("embedding")).alias("features"), "y"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), F.col("text").alias("context"))
    return models.score_pairs(pairs, model, "ridge").select("conv_id", "turn", F.round("risk_score", 4).alias("risk_score"))


_HASHED = "md5('42|' || o_orderkey)"
_BINS = """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderkey, o_totalprice, least(floor((o_totalprice - lo) / ((hi - lo) / {n})), {n} - 1)::BIGINT AS bin, md5('42|' || o_orderkey) AS h FROM orders, r)"""
_B10 = _BINS.format(n=10)

QUERIES = {
    f.__name__: f
    for f in (
        rps_by_item, rank_table, block_rank_table, rps_sweep_high_low, rank_risk_scores, rank_export, paired_cosine_score, unit_vectors, keep_first_canonical,
        keep_longest_page, last_value_by_user, clean_paragraphs, usable_labels, unique_words, pair_texts, url_parts, phrase_places,
        relation_edges, one_hop, unique_nodes, class_closure, coverage_counters, covered_edges, covered_lists, neutral_sample, unlabeled_ids, id_counts,
        upsert_labels, insert_ignore, score_normalize, score_histogram, quantile_classes, regression_metrics, confusion_matrix, class_metrics,
        kappa_mcc, spearman, seed_aggregate, curve_band, loss_table, extremes, exact_split, stratified_split, worker_shards, sampled_ids, hash_embed,
        principal_axes, discriminant_axes, score_pairs,
        fallback_ids, first_unlabeled, named_exactly, normalised_tags, tag_statistics, node_universe, target_ids, first_with_tags, enriched_items, cache_records, merged_cache, covered_relations, full_coverage, neutral_lists, claim_union, capped_neutrals, keyword_filter, clean_tag_lists, related_tags, resolved_labels, not_processed, retriever_sweep,
    )
} | {f"stratified_{m}": _sample(m, a) for m, a in (("count", 20), ("average", 1), ("percentage", 0.3), ("equal", 2), ("equal_tails", 3))}

_CLASS = "CASE WHEN least(greatest({0}, 0), 1) >= 0.66 THEN 'high' WHEN least(greatest({0}, 0), 1) >= 0.33 THEN 'medium' ELSE 'low' END"
_CLASSED = f"{_PREDICTIONS}, c AS (SELECT {_CLASS.format('y')} AS truth, {_CLASS.format('pred')} AS pred FROM p)"
_CELLS = f"{_CLASSED}, k AS (SELECT unnest(['low', 'medium', 'high']) AS class), m AS (SELECT k.class, count(*) FILTER (c.truth = k.class) AS support, count(*) FILTER (c.pred = k.class) AS predicted, count(*) FILTER (c.truth = k.class AND c.pred = k.class) AS hit FROM k, c GROUP BY 1), f AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM m), g AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)"
_SPLIT = "CASE WHEN r <= ceil(0.15::DOUBLE * n) THEN 'test' WHEN r <= ceil(0.15::DOUBLE * n) + ceil((0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) * (n - ceil(0.15::DOUBLE * n))) THEN 'val' ELSE 'train' END"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{X.BLANKS}+|{X.BLANKS}+$', '', 'g')"



ORACLES = {
    "rps_by_item": _RING + "SELECT qid, round(avg(CASE WHEN rank < 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS rps, count(*) AS tags FROM ranks WHERE n = 50 GROUP BY 1",
    "rank_table": _RING + "SELECT qid, tag, n, rank, sample_size FROM ranks",
    "block_rank_table": _RING + "SELECT qid, tag, rank, sample_size FROM ranks WHERE n = 50",
    "rps_sweep_high_low": _RING + """, s AS (SELECT qid, n, avg(CASE WHEN rank < 5 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM ranks GROUP BY 1, 2),
        h AS (SELECT n, count(*) FILTER (score > 0.5) AS high, count(*) FILTER (score <= 0.5) AS low FROM s GROUP BY 1)
        SELECT o.n, high::DOUBLE AS high, low::DOUBLE AS low, CASE WHEN low > 0 THEN round(high::DOUBLE / (high + low), 9) END AS ratio FROM (VALUES (10), (25), (50), (100)) o(n) LEFT JOIN h ON h.n = o.n""",
    "rank_risk_scores": _RING + """, a AS (SELECT qid, list(rank ORDER BY tag) AS r FROM ranks WHERE n = 50 GROUP BY 1)
        SELECT qid, round(list_max(r)::DOUBLE, 6) AS worst, round(list_avg(r), 6) AS mean, round(list_aggregate(r, 'quantile_cont', 0.9::DOUBLE), 6) AS p90,
        round(0.7::DOUBLE * list_max(r) + 0.3::DOUBLE * list_avg(r), 6) AS combo, round(1 / ln(len(r) + 1), 6) AS logc, round(1 / pow(len(r) + 1, 0.5::DOUBLE), 6) AS power,
        round(len(list_filter(r, lambda x: x < 1000))::DOUBLE / len(r), 6) AS below, round(CASE WHEN r[1] <= 50 THEN list_min(r) / 50.0::DOUBLE ELSE 1 END, 6) AS top,
        round(0.25::DOUBLE * list_max(r) + 0.75::DOUBLE * list_avg(r), 6) AS combined FROM a""",
    "rank_export": _RING + "SELECT qid, " + ", ".join(f"string_agg(rank::VARCHAR, ',' ORDER BY tag) FILTER (n = {n}) AS r{n}" for n in ORDERS) + " FROM ranks GROUP BY 1",
    "paired_cosine_score": """SELECT vec_id, round(0.5 * (list_dot_product(e[1:16], e[17:32]) / ((sqrt(list_dot_product(e[1:16], e[1:16])) + 1e-8) * (sqrt(list_dot_product(e[17:32], e[17:32])) + 1e-8)) + 1), 9) AS score
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "unit_vectors": """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM e)
        SELECT vec_id, round(sqrt(list_dot_product(u, u)), 9) AS norm, round(u[6], 9) AS fifth FROM u""",
    "keep_first_canonical": r"""WITH a AS (SELECT doc_id, source, replace(lower(@text@), 'ß', 'ss') AS c FROM documents)
        SELECT doc_id, md5(c) AS canon FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY source, doc_id) AS r FROM a WHERE c <> '') WHERE r = 1""",
    "clean_paragraphs": r"""WITH s AS (SELECT doc_id, text, regexp_replace(string_split(@text@, chr(10) || chr(10))[1], '\s+', ' ', 'g') AS p FROM documents), a AS (SELECT doc_id, text, @p@ AS t FROM s),
        b AS (SELECT *, lower(t) AS low, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS n FROM a)
        SELECT doc_id, md5(CASE WHEN t <> '' AND n >= 10 AND NOT regexp_matches(low, '^(may refer to|may also refer to|can refer to|can also refer to|may stand for|may mean|this category should only contain articles on species)')
          AND NOT regexp_matches(low[1:200], 'disambiguation|may refer to one of the following|refer to one of the following|this page lists articles|this disambiguation page|wikipedia does not have an article with this exact name|this category should only contain articles on species') THEN t ELSE '-' END) AS paragraph,
        length(@text@) < 60 AND regexp_matches(@text@, '(may refer to:|is a given name and a surname\.|is a given name\.|is a surname\.)$') AS stub FROM b""",
    "neutral_sample": f"""{_EDGES}, u AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, count(*) OVER () AS total FROM supplier),
        w AS (SELECT p_partkey AS target, j.j, ('0x' || substr(md5('1|' || p_partkey || '|' || j.j), 1, 12))::BIGINT % (SELECT count(*) FROM supplier) AS idx FROM part, range(0, 31) j(j)),
        f AS (SELECT w.target, u.node, min(w.j) AS j FROM w JOIN u ON u.idx = w.idx ANTI JOIN e ON e.src = w.target AND e.dst = u.node WHERE u.node <> w.target AND w.j > 0 GROUP BY 1, 2),
        g AS (SELECT target, node, row_number() OVER (PARTITION BY target ORDER BY j) AS pos FROM f), h AS (SELECT * FROM g WHERE pos <= 10),
        k AS (SELECT p_partkey AS target, least(10, (SELECT count(*) FROM supplier WHERE s_suppkey <> p_partkey) - (SELECT count(*) FROM e WHERE e.src = p_partkey AND e.dst <> p_partkey)) - (SELECT count(*) FROM h WHERE h.target = p_partkey) AS need FROM part),
        r AS (SELECT k.target, u.node, k.need, row_number() OVER (PARTITION BY k.target ORDER BY (u.idx - w.idx + u.total) % u.total) AS i FROM k JOIN u ON u.node <> k.target JOIN w ON w.target = k.target AND w.j = 0 ANTI JOIN e ON e.src = k.target AND e.dst = u.node ANTI JOIN h ON h.target = k.target AND h.node = u.node WHERE k.need > 0)
        SELECT target, node AS neutral FROM h UNION ALL SELECT target, node FROM r WHERE i <= need""",
    "keep_longest_page": "SELECT lang, source, arg_min(doc_id, (-length(@text@), doc_id)) AS doc_id FROM documents WHERE @text@ <> '' GROUP BY 1, 2",
    "last_value_by_user": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "usable_labels": """SELECT p_partkey, p_name, contains(lower(p_name), lower(substr(p_name, 1, 4))) AS self FROM part
        WHERE @p_name@ <> '' AND NOT regexp_matches(@p_name@, '^Q\\d+$') AND NOT regexp_matches(@p_name@, '^\\d+$') AND NOT regexp_matches(lower(p_name), 'wikidata|wikipedia|wikimedia')""",
    "unique_words": "SELECT DISTINCT @tag@ AS tag FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part UNION ALL SELECT p_brand FROM part) WHERE @tag@ <> ''",
    "pair_texts": """SELECT conv_id, turn, md5(CASE WHEN @role@ <> '' AND NOT contains(lower(@text@), lower(@role@)) THEN @role@ || ' : ' || @text@ ELSE @text@ END) AS pair,
        role || '_' || turn AS name FROM conversations""",
    "url_parts": """SELECT page_id, CASE WHEN contains(u, '/entity/') THEN string_split(u, '/entity/')[-1] ELSE '' END AS tail, CASE WHEN regexp_matches(url, '^https?://') THEN 'wikibase-item' ELSE 'string' END AS kind,
        md5(replace(replace(html, '\\', '\\\\'), '"', '\\"')) AS escaped FROM (SELECT *, replace(url, '/en/', '/entity/') AS u FROM pages)""",
    "relation_edges": f"{_EDGES} SELECT src, count(*) AS n, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS tags FROM e GROUP BY 1",
    "one_hop": f"""{_EDGES}, a AS (SELECT src, dst + 10000000 AS dst FROM e UNION ALL SELECT s_suppkey + 10000000, s_nationkey + 20000000 FROM supplier)
        SELECT a.src, a.dst, coalesce(h.hops, '') AS hops FROM a LEFT JOIN (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS hops FROM (SELECT DISTINCT src, dst FROM a) GROUP BY 1) h ON h.src = a.dst""",
    "unique_nodes": f"""{_EDGES}, x AS (SELECT src, dst + 10000000 AS dst, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS label, pos FROM e
          UNION ALL SELECT s_suppkey + 10000000, s_nationkey + 20000000, CASE WHEN s_acctbal > 0 THEN 'credit' ELSE 'debit' END, s_suppkey FROM supplier),
        o AS (SELECT dst AS node, label, 1 AS k, pos AS a, 0 AS b FROM x UNION ALL SELECT y.dst, y.label, 2, x.pos, y.pos FROM x JOIN x y ON x.dst = y.src)
        SELECT node, arg_min(label, (k, a, b, label)) AS label FROM o GROUP BY 1""",
    "class_closure": """WITH RECURSIVE g AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
        t(node) AS (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT g.child FROM t JOIN g ON g.parent = t.node) SELECT node FROM t""",
    "coverage_counters": f"""{_EDGES}, o AS (SELECT e.src, CASE WHEN p.s_suppkey IS NULL THEN 'no_page' WHEN t.p_partkey IS NOT NULL THEN 'tag_list' WHEN i.p_partkey IS NOT NULL THEN 'item_list' ELSE 'no_list' END AS o
          FROM e LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) p ON p.s_suppkey = e.dst LEFT JOIN (SELECT * FROM part WHERE p_size > 10) t ON t.p_partkey = e.dst LEFT JOIN (SELECT * FROM part WHERE p_size > 10) i ON i.p_partkey = e.src),
        b AS (SELECT src, count(*) FILTER (o = 'no_page') AS np, count(*) FILTER (o = 'tag_list') AS tl, count(*) FILTER (o = 'item_list') AS il, count(*) FILTER (o = 'no_list') AS nl FROM o GROUP BY 1)
        SELECT count(*) AS items, count(*) FILTER (tl + il > 0) AS items_kept, count(*) FILTER (tl + il = 0) AS items_dropped, sum(np)::BIGINT AS tags_without_page, sum(nl)::BIGINT AS tags_without_list, sum(il)::BIGINT AS tags_by_item_list, sum(tl + il)::BIGINT AS tags_kept FROM b""",
    "covered_edges": f"{_EDGES} SELECT src, dst FROM e WHERE dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND src IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "covered_lists": f"{_EDGES} SELECT src, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst) FILTER (dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)), '') AS v FROM e GROUP BY 1",
    "unlabeled_ids": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "id_counts": "SELECT (SELECT count(*) FROM customer) AS seen, (SELECT count(DISTINCT o_custkey) FROM orders) AS labeled, (SELECT count(*) FROM customer) - (SELECT count(DISTINCT o_custkey) FROM orders) AS unlabeled",
    "upsert_labels": "SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (value >= 50), arg_max(event_type, event_id)) AS label FROM events GROUP BY 1",
    "insert_ignore": "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "score_normalize": """WITH a AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
        SELECT o_orderkey, round(o_totalprice / hi, 6) AS max, round((o_totalprice - m) / s, 6) AS zscore, round((o_totalprice - lo) / (hi - lo), 6) AS minmax FROM orders, a""",
    "score_histogram": _BINS.format(n=20) + " SELECT g.bin, count(b.bin) AS n FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY 1",
    "quantile_classes": """WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders), c AS (SELECT len(list_filter(e, lambda x: x <= o_totalprice)) AS class, o_totalprice FROM orders, q)
        SELECT class, count(*) AS n, min(o_totalprice) AS least FROM c GROUP BY 1""",
    "regression_metrics": _PREDICTIONS + """ SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n, round(avg((y - pred) * (y - pred)), 8) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 8) AS rmse, round(avg(abs(y - pred)), 8) AS mae,
        round(1 - avg((y - pred) * (y - pred)) / var_pop(y), 8) AS r2, round(corr(y, pred), 8) AS pearson FROM p GROUP BY 1""",
    "confusion_matrix": _CLASSED + " SELECT a.class AS truth, b.class AS pred, count(c.truth) AS n FROM (SELECT unnest(['low', 'medium', 'high']) AS class) a CROSS JOIN (SELECT unnest(['low', 'medium', 'high']) AS class) b LEFT JOIN c ON c.truth = a.class AND c.pred = b.class GROUP BY 1, 2",
    "class_metrics": _CELLS + " SELECT class, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM g",
    "kappa_mcc": _CELLS + """ SELECT sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 8) AS accuracy, round(avg(f1), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1,
        round((sum(hit) * sum(support) - sum(support * predicted))::DOUBLE / sqrt((sum(support) * sum(support) - sum(predicted * predicted))::DOUBLE * (sum(support) * sum(support) - sum(support * support))), 8) AS mcc,
        round((sum(hit) / sum(support) - sum(support * predicted)::DOUBLE / (sum(support) * sum(support))) / (1 - sum(support * predicted)::DOUBLE / (sum(support) * sum(support))), 8) AS kappa FROM g""",
    "spearman": _PREDICTIONS + """, a AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ra, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rb FROM p)
        SELECT round(corr(ra, rb), 6) AS spearman FROM a""",
    "seed_aggregate": "SELECT l_returnflag AS model, l_linestatus AS metric, round(avg(l_quantity)::DOUBLE, 6) AS mean, round(stddev_pop(l_quantity)::DOUBLE, 6) AS std FROM lineitem GROUP BY 1, 2",
    "curve_band": """WITH c AS (SELECT (l_suppkey % 5)::BIGINT AS config, l_orderkey % 97 AS seed, l_linenumber AS epoch, max(l_quantity)::DOUBLE AS loss FROM lineitem GROUP BY 1, 2, 3),
        g AS (SELECT config, seed, e.epoch::BIGINT AS epoch FROM (SELECT DISTINCT config, seed FROM c), range(1, 10) e(epoch)),
        f AS (SELECT g.config, g.epoch, last_value(loss IGNORE NULLS) OVER (PARTITION BY g.config, g.seed ORDER BY g.epoch) AS loss FROM g LEFT JOIN c ON c.config = g.config AND c.seed = g.seed AND c.epoch = g.epoch)
        SELECT config, epoch, round(avg(loss), 6) AS mean, min(loss) AS least, max(loss) AS most FROM f GROUP BY 1, 2""",
    "loss_table": _PREDICTIONS + """, q AS (SELECT *, abs(pred - y) AS d, least(greatest(1 / (1 + exp(-pred)), 1e-7), 1 - 1e-7) AS s, least(greatest(y, 1e-7), 1 - 1e-7) AS t FROM p WHERE y > 0 AND y < 1)
        SELECT round(avg(d * d), 8) AS mse, round(avg(d), 8) AS mae, round(avg(CASE WHEN d < 0.1 THEN d * d / 0.2::DOUBLE ELSE d - 0.05::DOUBLE END), 8) AS smooth_l1, round(avg(t * ln(t / s) + (1 - t) * ln((1 - t) / (1 - s))), 8) AS kl FROM q""",
    "extremes": """WITH q AS (SELECT quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders),
        a AS (SELECT o_orderkey, 'low' AS side, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS r FROM orders, q WHERE o_totalprice <= lo UNION ALL
        SELECT o_orderkey, 'high', row_number() OVER (ORDER BY md5('42|' || o_orderkey)) FROM orders, q WHERE o_totalprice >= hi) SELECT o_orderkey, side FROM a WHERE r <= 25""",
    "exact_split": f"WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_HASHED}) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {_SPLIT} AS part FROM a",
    "stratified_split": f"WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASHED}) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, {_SPLIT} AS part FROM a",
    "worker_shards": "SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) - 1 AS shard FROM customer",
    "sampled_ids": "SELECT user_id AS id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('1|' || user_id) LIMIT 20",
    "phrase_places": """WITH p AS (SELECT doc_id, length(text) AS n, string_split(lower(text), 'the') AS s FROM documents),
        a AS (SELECT doc_id, n, CASE WHEN len(s) > 1 THEN list_sum(list_transform(s[1:least(3, len(s) - 1)], lambda x: length(x)))::BIGINT + (least(3, len(s) - 1) - 1) * 3 END AS place FROM p)
        SELECT doc_id, coalesce(place, -1) AS "at", coalesce(place, 0) AS w0, least(coalesce(place, 0) + 3, greatest(n, 3)) AS w1 FROM a""",
    "hash_embed": f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{X.BLANKS}+')) AS w FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT % 64 AS b, sum(CASE WHEN substr(md5(w), 16, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM w WHERE w <> '' GROUP BY 1, 2),
        g AS (SELECT doc_id, b.b, coalesce(c.n, 0) AS n FROM documents CROSS JOIN range(64) b(b) LEFT JOIN c USING (doc_id, b))
        SELECT doc_id, 64::BIGINT AS width, CASE WHEN sum(n * n) > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm, string_agg(sign(n)::INT::VARCHAR, ',' ORDER BY b) AS signs FROM g GROUP BY 1""",
    "retriever_sweep": _RING + """, h AS (SELECT * FROM (VALUES ('front', 1), ('back', 17)) h(retriever, lo)),
        ns2 AS (SELECT h.retriever, n.tag, n.pos, round(list_dot_product(t.e[lo:lo + 15], u.e[lo:lo + 15]), 9) AS sim FROM neutrals n JOIN b t ON t.qid = n.tag JOIN b u ON u.qid = n.neutral, h),
        os2 AS (SELECT h.retriever, e.qid, e.tag, round(list_dot_product(t.e[lo:lo + 15], u.e[lo:lo + 15]), 9) AS s0 FROM edges e JOIN b t ON t.qid = e.tag JOIN b u ON u.qid = e.qid, h),
        r2 AS (SELECT os2.retriever, os2.qid, os2.tag, o.n, count(*) FILTER (ns2.pos < o.n AND ns2.sim > os2.s0) + 1 AS rank FROM os2 JOIN (VALUES (10), (25), (50)) o(n) ON true
          LEFT JOIN ns2 ON ns2.tag = os2.tag AND ns2.retriever = os2.retriever GROUP BY 1, 2, 3, 4),
        s2 AS (SELECT retriever, qid, n, avg(CASE WHEN rank < 5 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM r2 GROUP BY 1, 2, 3),
        h2 AS (SELECT retriever, n, count(*) FILTER (score > 0.5) AS high, count(*) FILTER (score <= 0.5) AS low FROM s2 GROUP BY 1, 2),
        v AS (SELECT *, CASE WHEN low > 0 THEN high::DOUBLE / (high + low) END AS ratio FROM h2),
        p AS (SELECT retriever, row_number() OVER (ORDER BY max(ratio) FILTER (n = 10) DESC NULLS LAST, retriever) AS place FROM v GROUP BY 1)
        SELECT v.retriever, v.n, high, low, round(ratio, 9) AS ratio, p.place FROM v JOIN p ON p.retriever = v.retriever""",
    "stratified_count": _B10 + " SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h) AS r FROM b) WHERE r <= 20",
    "stratified_average": _B10 + ", c AS (SELECT ceil(count(*) / count(DISTINCT bin)) AS cap FROM b) SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h) AS r FROM b), c WHERE r <= cap",
    "stratified_percentage": _B10 + ", c AS (SELECT ceil(0.3::DOUBLE * max(n)) AS cap FROM (SELECT count(*) AS n FROM b GROUP BY bin)) SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h) AS r FROM b), c WHERE r <= cap",
    "stratified_equal": _B10 + ", c AS (SELECT count(*) AS k FROM b WHERE bin < 2) SELECT o_orderkey, bin FROM b WHERE bin < 2 UNION ALL SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (ORDER BY h) AS r FROM b WHERE bin >= 2), c WHERE r <= k",
    "stratified_equal_tails": _B10 + """, c AS (SELECT least(count(*) FILTER (bin < 3), count(*) FILTER (bin >= 7)) AS k FROM b)
        SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (ORDER BY h) AS r FROM b WHERE bin < 3), c WHERE r <= k UNION ALL SELECT o_orderkey, bin FROM (SELECT *, row_number() OVER (ORDER BY h) AS r FROM b WHERE bin >= 7), c WHERE r <= k""",
    "normalised_tags": _ITEMS + " SELECT qid, pos, tag, label FROM (SELECT *, row_number() OVER (PARTITION BY qid, tag ORDER BY pos) AS r FROM t WHERE tag <> qid) WHERE r = 1 UNION ALL SELECT qid, pos, tag, label FROM t WHERE tag IS NULL",
    "tag_statistics": _ITEMS + " SELECT count(DISTINCT qid) AS items, count(*) AS tags, count(tag) AS with_id, count(*) FILTER (tag IS NULL) AS without_id, (2 * count(tag))::BIGINT AS one_hop FROM t",
    "node_universe": f"{_EDGES} SELECT src AS node FROM e UNION SELECT dst + 10000000 FROM e",
    "target_ids": "SELECT DISTINCT p_partkey AS qid FROM part WHERE p_partkey % 3 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)",
    "first_with_tags": """WITH a AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 7 > 0 THEN 'i:' || (p_partkey % 7) ELSE 'l:' || lower(p_brand) END AS k,
          list_filter(string_split(p_name, ' '), lambda t: NOT regexp_matches(t, '^Q\\d+$|[_/]') AND NOT contains(lower(t), 'wiki')) AS tags FROM part)
        SELECT pos, array_to_string(tags, ' ') AS tags FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM a WHERE len(tags) > 0) WHERE r = 1""",
    "enriched_items": """SELECT p_partkey AS qid, p_name AS label, true AS wikipedia_checked, text IS NOT NULL AS wikipedia_exists, coalesce(lang, 'en') AS wikipedia_lang, coalesce(source, p_name) AS wikipedia_title,
        md5(coalesce(text[1:20], '')) AS paragraph FROM part LEFT JOIN documents ON doc_id = p_partkey""",
    "cache_records": """WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Q' || o_custkey ELSE ' ' END AS qid, CASE WHEN o_orderkey % 2 = 0 THEN 'Q' || o_orderkey ELSE o_orderpriority END AS tag,
          CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS label, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus END AS title, o_orderkey AS p FROM orders), s AS (SELECT *, coalesce(title, label, tag) AS t FROM r)
        SELECT CASE WHEN qid NOT IN (' ', 'Q0') THEN qid WHEN regexp_matches(tag, '^Q[1-9]') THEN tag END AS qid, tag, coalesce(label, t) AS label, 'en' AS wikipedia_lang, t AS wikipedia_title, p AS wikipedia_first_paragraph FROM s""",
    "merged_cache": """WITH e AS (SELECT CASE WHEN event_id % 11 > 0 THEN 'Q' || user_id END AS qid, event_type AS p, event_id::BIGINT AS pos FROM events), c AS (SELECT 'Q' || c_custkey AS qid, 'p' || c_custkey AS p FROM customer WHERE c_custkey % 2 = 0)
        SELECT qid, p AS wikipedia_first_paragraph, pos FROM e WHERE qid IS NULL UNION ALL SELECT f.qid, coalesce(c.p, f.p), f.pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM e WHERE qid IS NOT NULL) f LEFT JOIN c ON c.qid = f.qid WHERE r = 1
        UNION ALL SELECT qid, p, (SELECT max(pos) FROM e) + row_number() OVER (ORDER BY qid) FROM c WHERE qid NOT IN (SELECT qid FROM e WHERE qid IS NOT NULL)""",
    "covered_relations": f"""{_EDGES}, k AS (SELECT src, dst + 10000000 AS dst FROM e WHERE dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND src IN (SELECT p_partkey FROM part WHERE p_size > 10))
        SELECT src, dst, (SELECT count(DISTINCT src) FROM e WHERE src NOT IN (SELECT src FROM k)) AS none FROM k""",
    "full_coverage": "SELECT s_suppkey AS key, CASE WHEN s_acctbal > 0 THEN s_name END AS page FROM supplier",
    "neutral_lists": f"""{_EDGES}, l AS (SELECT s_suppkey + 10000000 AS node, p.p AS pos FROM supplier, range(1, 3) p(p) WHERE s_nationkey < 12 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size > 25)
        SELECT e.src, e.dst + 10000000 AS dst, l.node * 10 + l.pos AS neutral, l.pos FROM e JOIN l ON l.node = CASE WHEN e.dst + 10000000 IN (SELECT node FROM l) THEN e.dst + 10000000 ELSE e.src END""",
    "claim_union": """SELECT l_partkey AS qid, 'P1' AS pid, 'Q' || l_suppkey AS value_qid, NULL::VARCHAR AS value, min(l_orderkey)::BIGINT AS pos FROM lineitem GROUP BY 1, 2, 3
        UNION ALL SELECT l_partkey, 'P2', NULL, l_returnflag, min(l_orderkey) FROM lineitem GROUP BY 1, 4""",
    "capped_neutrals": f"{_EDGES} SELECT 1 AS qid, src AS tag, dst AS neutral, pos FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5('1|1|' || src || '|' || dst), dst) AS pos FROM e) WHERE pos < 3",
    "keyword_filter": _ITEMS + " SELECT qid, count(*) FILTER (h) AS removed, count(*) FILTER (NOT h) AS left FROM (SELECT qid, regexp_matches(lower(coalesce(tag, '') || '|' || label), 'ing|07') AS h FROM t) GROUP BY 1",
    "clean_tag_lists": """SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda t: NOT regexp_matches(t, '^Q\\d+$|[_/]') AND NOT contains(lower(t), 'wiki')), '|') AS tags FROM part""",
    "related_tags": """WITH a AS (SELECT 'Q' || l_partkey AS qid, 'Q' || l_suppkey AS v, min((l_orderkey * 10 + l_linenumber)::BIGINT * 100000 + l_suppkey) AS pos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
          WHERE l_partkey <> l_suppkey AND NOT contains(lower(s_name), right(l_partkey::VARCHAR, 1)) GROUP BY 1, 2) SELECT qid, string_agg(v, ',' ORDER BY pos) AS tags FROM a GROUP BY 1""",
    "resolved_labels": "SELECT event_id, q.qid FROM events e LEFT JOIN (SELECT event_type, min(user_id) AS qid FROM events WHERE event_id % 3 = 0 GROUP BY 1) q ON q.event_type = e.event_type",
    "not_processed": "SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 9 = 0)",
}
ORACLES |= {
    "fallback_ids": "SELECT s_suppkey AS qid FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0)",
    "first_unlabeled": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY c_custkey LIMIT 30",
    "named_exactly": "SELECT p_partkey, contains(p_name, upper(substr(p_name, 2, 3))) AS exact, true AS any_case FROM part",
}
QUERIES |= item_queries.QUERIES | file_queries.QUERIES
ORACLES |= item_queries.ORACLES | file_queries.ORACLES
ORACLES = {name: re.sub("@([^@]+)@", lambda m: _strip(m[1]), sql) for name, sql in ORACLES.items()}
