"""Registered queries on items, encoders, models and pages, and their SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.functions import text as X
from farsight.functions import vectors as V
from farsight.operators import clean, encode, graph, models, scores, stats
from farsight.sources import tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- tokens and spans -----------------------------------------------------------------------------------------------

PHRASE = "that the"
#: Tokens of a document that has the phrase, with their first and end offsets; c0 is where the phrase starts.
_TOKENS = f"""WITH s AS (SELECT doc_id, text, strpos(lower(text), '{PHRASE}') - 1 AS c0 FROM documents WHERE strpos(lower(text), '{PHRASE}') > 0),
p AS (SELECT doc_id, c0, regexp_split_to_array(text, '[\\x20\\x09-\\x0D]') AS a FROM s), u AS (SELECT doc_id, c0, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM p),
o AS (SELECT doc_id, c0, token, i, (sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(token) - 1)::INT AS a FROM u),
t AS (SELECT doc_id, token, a, (a + length(token))::INT AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS size,
    greatest(a, c0) < least(a + length(token), c0 + {len(PHRASE)}) AS hit FROM o WHERE token <> '')"""


def _phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.lit(PHRASE).alias("phrase"))


def token_spans(spark, d):
    return encode.span_tokens(_phrases(spark, d)).select("doc_id", "start", "end", "token")


def token_offsets(spark, d):
    """Words of all titles and turns by the table function in SQL."""
    encode.register_token_offsets(spark)
    table(spark, d, "conversations").createOrReplaceTempView("farsight_turns")
    return spark.sql("SELECT c.conv_id, c.turn, cast(t.idx AS bigint) AS idx, t.start, t.end, t.token FROM farsight_turns c, LATERAL token_offsets(c.text) t")


def span_windows(spark, d):
    """Windows of up to 9 tokens around a phrase."""
    w = encode.span_windows(_phrases(spark, d), limit=9, context=4)
    return w.select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("start").cast("long").alias("start"), F.array_join("tokens", " ").alias("tokens"))


def span_embed(spark, d):
    """The vector of a phrase within its window: two sums that tell its entries apart."""
    e = encode.embed_spans(_phrases(spark, d), limit=9, context=4)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("doc_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(weighted, 5).alias("weighted"), F.round(F.array_max(F.transform("embedding", F.abs)), 6).alias("largest"))


_WINDOWS = (
    _TOKENS
    + """, h AS (SELECT doc_id, min(n) AS first, max(n) + 1 AS last, max(size) AS size FROM t WHERE hit GROUP BY 1),
v AS (SELECT *, least(9, last - first + 8) AS width FROM h), x AS (SELECT *, greatest(0, least((first + last) // 2 - width // 2, size - width)) AS s FROM v),
y AS (SELECT *, CASE WHEN s > first OR s + width < least(last, first + width) THEN first ELSE s END AS w0 FROM x), z AS (SELECT *, least(w0 + width, size) AS w1 FROM y),
w AS (SELECT z.doc_id, z.first, z.last, z.w0, t.n, t.token FROM z JOIN t ON t.doc_id = z.doc_id AND t.n >= z.w0 AND t.n < z.w1)"""
)


# --- text-keyed bank ------------------------------------------------------------------------------------------------


def text_bank(spark, d):
    """Turns of conversations as requests: each different text is encoded once, every request is answered in its place."""
    c = table(spark, d, "conversations").select(F.concat_ws("/", F.format_string("%08d", "conv_id"), F.format_string("%06d", "turn")).alias("pos"), "text", F.concat(F.lit("Q"), "conv_id").alias("qid"))
    first, rest = c.filter(F.endswith("pos", F.lit("0"))), c.filter(~F.endswith("pos", F.lit("0")))
    bank = encode.extend_text_bank(encode.text_bank(spark), first)
    bank = encode.extend_text_bank(bank, rest)
    held = bank.select("text", F.col("qid").alias("owner"))
    return encode.answered(c, bank).join(held, "text").select("pos", "owner", F.size("embedding").cast("long").alias("width"), F.count("*").over(Window.partitionBy("text")).alias("asked"))


# --- models ---------------------------------------------------------------------------------------------------------


def _rows(spark, d):
    """Two features and a score."""
    e = table(spark, d, "embeddings")
    a, b = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return e.select(F.col("vec_id").alias("qid"), array_to_vector(F.array(a, b)).alias("features"), (0.5 + a + 0.5 * b * b + F.get("embedding", F.lit(2)).cast("double")).alias("y"))


def model_metrics(spark, d):
    """Constants and ridge over two seeds: every metric of each part from one grouped pass."""
    m = models.evaluate(_rows(spark, d), ["zero", "one", "ridge"], [42, 43])
    shown = ["mse", "rmse", "mae", "r2", "pearson", "spearman", "accuracy"]
    m = m.filter(F.col("metric").isin(shown) | F.startswith("metric", F.lit("cm_")))
    return m.select("model", "seed", "part", "metric", F.round("value", 6).alias("value"))


def model_report(spark, d):
    """Means over seeds of the test part, by family, and the model that the validation part chooses."""
    done = models.experiment(_rows(spark, d), {"Baselines": ["zero", "one"], "Linear": ["ridge"]}, [42, 43])
    return done.report.select("shown", "model", *(F.round(c, 3).alias(c) for c in ("rmse", "mae", "pearson", "spearman", "accuracy")), F.lit(done.best).alias("best"))


_CLASS = "CASE WHEN least(greatest({0}, 0), 1) >= 0.66 THEN 'high' WHEN least(greatest({0}, 0), 1) >= 0.33 THEN 'medium' ELSE 'low' END"
#: Ridge on two standardised features has a closed form: two sums and the correlation r of the training part.
_METRICS = f"""WITH e AS (SELECT vec_id AS qid, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, 0.5 + embedding[1]::DOUBLE + 0.5 * embedding[2]::DOUBLE * embedding[2]::DOUBLE + embedding[3]::DOUBLE AS y FROM embeddings),
k AS (SELECT s.seed, e.*, row_number() OVER (PARTITION BY s.seed ORDER BY md5(s.seed || '|' || qid)) AS r, count(*) OVER (PARTITION BY s.seed) AS n FROM e, (VALUES (42), (43)) s(seed)),
p AS (SELECT *, CASE WHEN r <= ceil(0.15::DOUBLE * n) THEN 'test' WHEN r <= ceil(0.15::DOUBLE * n) + ceil(0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE) * (n - ceil(0.15::DOUBLE * n))) THEN 'val' ELSE 'train' END AS part FROM k),
m AS (SELECT seed, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my, count(*) AS n FROM p WHERE part = 'train' GROUP BY 1),
z AS (SELECT p.seed, qid, part, y, (a - ma) / sa AS a, (b - mb) / sb AS b, my, m.n FROM p JOIN m ON m.seed = p.seed),
s AS (SELECT seed, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS by_, sum(a * b) AS ab, max(n) AS n FROM z WHERE part = 'train' GROUP BY 1),
w AS (SELECT seed, (ay * (n + 1) - by_ * ab) / ((n + 1) * (n + 1) - ab * ab) AS wa, (by_ * (n + 1) - ay * ab) / ((n + 1) * (n + 1) - ab * ab) AS wb FROM s),
f AS (SELECT x.model, z.seed, part, qid, y, CASE x.model WHEN 'zero' THEN 0 WHEN 'one' THEN 1 ELSE my + wa * a + wb * b END AS pred FROM z JOIN w ON w.seed = z.seed, (VALUES ('zero'), ('one'), ('ridge')) x(model) WHERE part <> 'train'),
g AS (SELECT *, rank() OVER (PARTITION BY model, seed, part ORDER BY y) + (count(*) OVER (PARTITION BY model, seed, part, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model, seed, part ORDER BY pred) + (count(*) OVER (PARTITION BY model, seed, part, pred) - 1) / 2.0 AS rp,
    {_CLASS.format("y")} AS cy, {_CLASS.format("pred")} AS cp FROM f),
r AS (SELECT model, seed, part, avg((y - pred) ** 2) AS mse, sqrt(avg((y - pred) ** 2)) AS rmse, avg(abs(y - pred)) AS mae, 1 - avg((y - pred) ** 2) / var_pop(y) AS r2, CASE WHEN stddev_pop(pred) > 0 THEN coalesce(corr(y, pred), 0) ELSE 0 END AS pearson,
    CASE WHEN stddev_pop(rp) > 0 THEN coalesce(corr(ry, rp), 0) ELSE 0 END AS spearman, avg((cy = cp)::INT) AS accuracy FROM g GROUP BY 1, 2, 3),
c AS (SELECT model, seed, part, 'cm_' || a.c || '_' || b.c AS metric, count(*) FILTER (cy = a.c AND cp = b.c)::DOUBLE AS value FROM g, (VALUES ('low'), ('medium'), ('high')) a(c), (VALUES ('low'), ('medium'), ('high')) b(c) GROUP BY 1, 2, 3, 4),
every AS (SELECT model, seed, part, metric, round(value, 6) AS value FROM (UNPIVOT r ON mse, rmse, mae, r2, pearson, spearman, accuracy INTO NAME metric VALUE value) UNION ALL SELECT * FROM c)"""


# --- pages ----------------------------------------------------------------------------------------------------------


def page_bounds(spark, d):
    return tables.page_bounds(table(spark, d, "orders").select("o_custkey"), "o_custkey", 100)


# --- items ----------------------------------------------------------------------------------------------------------


def upsert_metrics(spark, d):
    """Metrics by run and name, of which later ones replace earlier ones."""
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_type").alias("metric"), "value", "event_id")
    old = clean.keep_last(e.filter("event_id % 3 = 0"), ["run", "metric"], "event_id")
    return graph.upsert(old, e.filter("event_id % 3 > 0"), ["run", "metric"], "event_id").select("run", "metric", F.round("value", 6).alias("value"))


def scan_report(spark, d):
    """Customers with their orders' priorities as ranks; those without get no score."""
    o = table(spark, d, "orders").select("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"))
    lists = o.groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_list("rank").alias("ranks"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("label")).join(lists, "qid", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    r = tables.scan_report(items, lambda r: scores.below(r, 3))
    return r.select("qid", "label", F.when(F.isnan("risk_score"), None).otherwise(F.round("risk_score", 6)).alias("risk_score"), F.size("ranks").cast("long").alias("n"))


def grouped_claims(spark, d):
    """Claims of parts: suppliers under P1, return flags under P2."""
    li = table(spark, d, "lineitem")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    claim = lambda pid, label, vq, v: li.select(F.col("l_partkey").alias("qid"), F.lit(pid).alias("pid"), F.lit(label).alias("property_label"), F.lit("t").alias("value_type"), vq.alias("value_qid"), F.lit("l").alias("value_label"), v.alias("value"), F.lit("d").alias("datatype"), pos.alias("pos"))
    none = F.lit(None).cast("string")
    g = graph.grouped_claims(claim("P1", "supplier", F.concat(F.lit("Q"), "l_suppkey"), none).unionByName(claim("P2", "flag", none, F.col("l_returnflag"))))
    value = lambda p, f: F.array_join(F.transform(F.col("claims")[p]["values"], lambda v: v[f]), ",")
    return g.select("qid", value("P1", "value_qid").alias("suppliers"), value("P2", "value").alias("flags"), F.col("claims")["P1"]["property_label"].alias("label"))


def best_model(spark, d):
    """Of clerks as models, the one with the least mean price, the first by place of equals."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice").cast("double"), 4).alias("rmse"), F.min("o_orderkey").alias("pos"))
    return stats.best_model(o, "rmse", eligible="-").select("model", "rmse")


def residual_histogram(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50.0).cast("double").alias("y"), (F.col("l_quantity") / 60.0 + F.col("l_discount")).cast("double").alias("pred"))
    return stats.residuals(li, bins=7).select(F.col("bin").cast("long").alias("bin"), "n", F.round("density", 6).alias("density"), F.round("mean_error", 8).alias("mean_error"))


def fully_expanded(spark, d):
    """Orders whose lines all have a tax, as items whose tags all have a list."""
    tag = F.struct(F.when(F.col("l_tax") > 0, F.array(F.lit("x"))).alias("one_hop_related_tags"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(tag).alias("related_tags"))
    return items.select("l_orderkey", clean.fully_expanded().alias("full"))


def with_text(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text")).alias("text"))
    found, none = clean.with_text(ids, pages)
    return found.join(none).select("qid", F.md5("text").alias("text"), "skipped")


def new_by_label(spark, d):
    """Parts whose name no part of the first brands has."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("label"), "p_brand")
    done = p.filter("p_brand like 'Brand#1%'").select(F.upper(F.concat(F.lit(" "), "label")).alias("label"))
    return graph.new_by_canonical_label(p, done).select("p_partkey", "label")


def missing_tags(spark, d):
    tags = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tag"))
    return graph.missing_tags(tags, table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("tag")))


def tag_pages(spark, d):
    tags = table(spark, d, "nation").select(F.concat(F.lit("\t "), "n_name", F.lit(" ")).alias("tag"))
    pages = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("title"), "s_suppkey")
    return graph.tag_pages(tags, pages).select("tag", "s_suppkey")


def page_titles(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"))
    links = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "lang", F.col("source").alias("title"))
    return graph.page_titles(ids, links, "de").select("qid", "title")


def labels_by_language(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n")).filter("cast(n as int) % 2 = 0")
    maps = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("labels"))
    return maps.select("source", X.label_by_language(F.col("labels"), ["fr", "de", "en"]).alias("label"))


def two_sources(spark, d):
    docs = table(spark, d, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.left("text", F.lit(20)))).when(F.col("doc_id") % 3 == 1, F.lit("\t"))
    return docs.select("doc_id", F.md5(F.coalesce(X.two_source_text(first, F.col("text")), F.lit("-"))).alias("text"))


def training_rows(spark, d):
    """Vectors with a score: their label's share of the largest."""
    e = table(spark, d, "embeddings")
    score = e.select(F.col("vec_id").alias("qid"), (F.col("label") / 10.0).alias("y")).filter("qid % 5 > 0")
    rows = models.training_set(e.filter("vec_id % 7 > 0").select(F.col("vec_id").alias("qid")), e.select(F.col("vec_id").alias("qid"), "embedding"), score)
    x = vector_to_array("features")
    both = V.concatenated(x, F.array(F.col("y")))
    return rows.select("qid", F.round("y", 6).alias("y"), F.size(both).cast("long").alias("width"), F.round(V.sigmoid(x[0]), 6).alias("sigmoid"))


QUERIES = {
    f.__name__: f
    for f in (
        token_spans, token_offsets, span_windows, span_embed, text_bank, model_metrics, model_report, page_bounds, upsert_metrics, scan_report, grouped_claims, best_model, residual_histogram, fully_expanded, with_text, new_by_label,
        missing_tags, tag_pages, page_titles, labels_by_language, two_sources, training_rows,
    )
}

ORACLES = {
    "token_spans": _TOKENS + """ SELECT doc_id, a AS "start", b AS "end", token FROM t WHERE hit""",
    "token_offsets": """WITH p AS (SELECT conv_id, turn, regexp_split_to_array(text, '[\\x20\\x09-\\x0D]') AS a FROM conversations), u AS (SELECT conv_id, turn, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM p),
        o AS (SELECT *, (sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(token) - 1)::INT AS a FROM u)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS idx, a AS "start", (a + length(token))::INT AS "end", token FROM o WHERE token <> ''""",
    "span_windows": _WINDOWS + " SELECT doc_id, first, last, w0 AS start, string_agg(token, ' ' ORDER BY n) AS tokens FROM w GROUP BY 1, 2, 3, 4",
    "span_embed": _WINDOWS + """, q AS (SELECT doc_id, n >= first AND n < last AS own, ('0x' || substr(md5(lower(token)), 1, 15))::BIGINT % 64 AS b, CASE WHEN substr(md5(lower(token)), 16, 1) >= '8' THEN 1 ELSE -1 END AS x FROM w),
        k AS (SELECT doc_id, count(*) FILTER (own) AS m, count(*) AS n FROM q GROUP BY 1),
        e AS (SELECT q.doc_id, b, coalesce(sum(x) FILTER (own), 0) / max(m)::DOUBLE + 0.5 * sum(x) / max(n)::DOUBLE AS x FROM q JOIN k ON k.doc_id = q.doc_id GROUP BY 1, 2),
        l AS (SELECT doc_id, CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END AS l FROM e GROUP BY 1)
        SELECT e.doc_id, round(sqrt(sum((x / l) ** 2)), 6) AS norm, round(sum(x / l * (b + 1)), 5) AS weighted, round(max(abs(x / l)), 6) AS largest FROM e JOIN l ON l.doc_id = e.doc_id GROUP BY 1""",
    "text_bank": """WITH c AS (SELECT printf('%08d', conv_id) || '/' || printf('%06d', turn) AS pos, text, 'Q' || conv_id AS qid FROM conversations),
        o AS (SELECT text, arg_min(qid, (NOT suffix(pos, '0'), pos)) AS owner, count(*) AS n FROM c GROUP BY 1) SELECT c.pos, o.owner, 64::BIGINT AS width, o.n AS asked FROM c JOIN o ON o.text = c.text""",
    "model_metrics": _METRICS + " SELECT * FROM every",
    "model_report": _METRICS + """, a AS (SELECT model, part, metric, avg(value) AS value FROM (SELECT model, seed, part, metric, value FROM (UNPIVOT r ON rmse, mae, pearson, spearman, accuracy INTO NAME metric VALUE value)) GROUP BY 1, 2, 3)
        SELECT CASE model WHEN 'one' THEN 'Baselines' WHEN 'ridge' THEN 'Linear' ELSE '' END AS shown, model, round(max(value) FILTER (metric = 'rmse'), 3) AS rmse, round(max(value) FILTER (metric = 'mae'), 3) AS mae,
          round(max(value) FILTER (metric = 'pearson'), 3) AS pearson, round(max(value) FILTER (metric = 'spearman'), 3) AS spearman, round(max(value) FILTER (metric = 'accuracy'), 3) AS accuracy, 'ridge' AS best FROM a WHERE part = 'test' GROUP BY model""",
    "page_bounds": "SELECT (dense_rank - 1) // 100 AS page, min(o_custkey) AS first, max(o_custkey) AS last, count(*) AS rows FROM (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) AS dense_rank FROM orders) GROUP BY 1",
    "upsert_metrics": """WITH e AS (SELECT user_id % 50 AS run, event_type AS metric, value, event_id, event_id % 3 > 0 AS late FROM events)
        SELECT run, metric, round(arg_max(value, (late, event_id)), 6) AS value FROM e GROUP BY 1, 2""",
    "scan_report": """SELECT c_custkey AS qid, c_name AS label, round(avg(CASE WHEN o_orderkey IS NOT NULL THEN (left(o_orderpriority, 1)::INT < 3)::INT END)::DOUBLE, 6) AS risk_score, count(o_orderkey) AS n
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "grouped_claims": """WITH a AS (SELECT l_partkey AS qid, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey AS qid, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
        SELECT x.qid, x.suppliers, y.flags, 'supplier' AS label FROM (SELECT qid, string_agg('Q' || l_suppkey, ',' ORDER BY pos, 'Q' || l_suppkey) AS suppliers FROM a GROUP BY 1) x JOIN (SELECT qid, string_agg(l_returnflag, ',' ORDER BY pos, l_returnflag) AS flags FROM b GROUP BY 1) y ON y.qid = x.qid""",
    "best_model": "SELECT o_orderpriority AS model, round(avg(o_totalprice)::DOUBLE, 4) AS rmse FROM orders WHERE contains(o_orderpriority, '-') GROUP BY 1 ORDER BY round(avg(o_totalprice)::DOUBLE, 4), min(o_orderkey) LIMIT 1",
    "residual_histogram": """WITH e AS (SELECT (l_quantity / 50.0)::DOUBLE - (l_quantity / 60.0 + l_discount)::DOUBLE AS e FROM lineitem), r AS (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS m, count(*) AS n FROM e),
        c AS (SELECT least(floor((e - lo) / ((hi - lo) / 7)), 6)::BIGINT AS bin, count(*) AS n FROM e, r GROUP BY 1)
        SELECT b.b AS bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (r.n * (r.hi - r.lo) / 7), 6) AS density, round(r.m, 8) AS mean_error FROM range(7) b(b) LEFT JOIN c ON c.bin = b.b, r""",
    "fully_expanded": "SELECT l_orderkey, bool_and(l_tax > 0) AS full FROM lineitem GROUP BY 1",
    "with_text": """SELECT c_custkey AS qid, md5(text) AS text, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND trim(text) <> '')) AS skipped
        FROM customer JOIN documents ON doc_id = c_custkey WHERE doc_id % 4 <> 0 AND trim(text) <> ''""",
    "new_by_label": "SELECT p_partkey, split_part(p_name, ' ', 1) AS label FROM part WHERE lower(split_part(p_name, ' ', 1)) NOT IN (SELECT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_brand LIKE 'Brand#1%')",
    "missing_tags": "SELECT DISTINCT l_suppkey AS tag FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "tag_pages": "SELECT n_name AS tag, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "page_titles": "SELECT c_custkey AS qid, source AS title FROM customer JOIN documents ON doc_id = c_custkey WHERE lang = 'de'",
    "labels_by_language": """WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) % 2 = 0)
        SELECT source, coalesce((max(n) FILTER (lang = 'fr'))::VARCHAR, (max(n) FILTER (lang = 'de'))::VARCHAR, (max(n) FILTER (lang = 'en'))::VARCHAR, '') AS label FROM n GROUP BY 1""",
    "two_sources": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || left(text, 20) ELSE '' END AS a, @text@ AS t FROM documents), p AS (SELECT doc_id, a, split_part(t, chr(10) || chr(10), 1) AS p FROM s)
        SELECT doc_id, md5(coalesce(nullif(@a@, ''), nullif(@p@, ''), '-')) AS text FROM p""",
    "training_rows": """SELECT vec_id AS qid, round(label / 10.0, 6) AS y, len(embedding)::BIGINT + 1 AS width, round(1 / (1 + exp(-(embedding[1]::DOUBLE))), 6) AS sigmoid FROM embeddings WHERE vec_id % 7 > 0 AND vec_id % 5 > 0""",
}
