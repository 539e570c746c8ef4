"""Golden tables and properties for graph, sampling, ranking, statistics, models, files and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.functions import vectors as V
from farsight.operators import encode, graph, models, neutral, ranking, sampling, scores, stats
from farsight.sources import tables
from farsight.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_graph(spark):
    items = spark.createDataFrame(
        [("Q1", [("Q2", "a"), ("Q2", "a"), ("Q1", "s"), (None, "x"), (None, "x")])], "qid string, related_tags array<struct<qid: string, label: string>>"
    )
    assert sorted(rows(graph.normalised_tags(items).select("tag", "label")), key=str) == sorted([("Q2", "a"), (None, "x"), (None, "x")], key=str)
    lists = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "k int, v array<string>")
    pages = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.covered_list(lists, pages, "k", "v"), "k") == [(1, ["a", "a"]), (2, []), (3, [])]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    start = spark.createDataFrame([("c",)], "node string")
    assert [r[0] for r in rows(graph.closure(edges, start))] == ["a", "b", "c"]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "q", 1)], "k int, v string, seq int")
    assert rows(graph.upsert(old, new, ["k"], "seq").select("k", "v")) == [(1, "x"), (2, "w"), (3, "q")]
    cache = spark.createDataFrame([("Q1", "new"), ("Q9", "n")], "qid string, wikipedia_first_paragraph string")
    have = spark.createDataFrame([("Q1", "old", 1), ("Q1", "older", 2), (None, "k", 3)], "qid string, wikipedia_first_paragraph string, pos long")
    assert sorted(map(str, rows(graph.merge_cache(have, cache).select("qid", "wikipedia_first_paragraph")))) == sorted(map(str, [("Q1", "new"), (None, "k"), ("Q9", "n")]))


def test_neutral_sample(spark):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    related = spark.createDataFrame([(0, 1), (0, 2)], "target long, node long")
    got = rows(neutral.neutral_sample(spark.range(2).select(F.col("id").alias("target")), nodes, related, 10).select("target", "neutral"))
    assert [n for t, n in got if t == 0] == [3, 4, 5] and [n for t, n in got if t == 1] == [0, 2, 3, 4, 5]
    few = neutral.neutral_sample(spark.range(1).select(F.col("id").alias("target")), nodes, related, 2)
    assert few.count() == 2 and few.filter("neutral in (0, 1, 2)").count() == 0


def test_neutral_sample_of_any_ids(spark):
    nodes = spark.createDataFrame([(f"Q{i}",) for i in range(50)], "node string")
    related = spark.createDataFrame([("Q1", f"Q{i}") for i in range(2, 45)], "target string, node string")
    targets = spark.createDataFrame([("Q1",), ("Q7",), ("other",)], "target string")
    got = neutral.neutral_sample(targets, nodes, related, 10, draws=1)
    by = {}
    for r in got.collect():
        by.setdefault(r.target, []).append((r.pos, r.neutral))
    assert {n for _, n in by["Q1"]} == {"Q0", "Q45", "Q46", "Q47", "Q48", "Q49"}  # all that there are
    for t in ("Q7", "other"):
        assert sorted(p for p, _ in by[t]) == list(range(1, 11)) and len({n for _, n in by[t]} - {t}) == 10
    large = spark.createDataFrame([(10**15 + i,) for i in range(20)], "node long")
    assert neutral.neutral_sample(large.select(F.col("node").alias("target")), large, spark.createDataFrame([], "target long, node long"), 3).count() == 60


def test_dense_numbers_do_not_depend_on_ranges(spark, monkeypatch):
    from farsight.functions import order

    ids = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}",) for i in range(1000)] + [(None,), ("far away",)], "node string")
    want = [(k, i) for i, k in enumerate(sorted(r[0] for r in ids.collect() if r[0]))]
    assert rows(order.ordered(ids), "idx") == want
    monkeypatch.setattr(order, "RANGE", 100)
    assert rows(order.ordered(ids), "idx") == want


def test_claim_union_keeps_literals(spark):
    schema = "qid string, pid string, value_qid string, value string, pos int"
    one = spark.createDataFrame([("Q1", "P1", None, "a", 1), ("Q1", "P1", None, "b", 2), ("Q1", "P2", "Q5", "x", 3)], schema)
    two = spark.createDataFrame([("Q1", "P1", None, "a", 9), ("Q1", "P2", "Q5", "y", 1), ("Q1", "P1", "", "b", 1)], schema)
    assert rows(graph.claim_union(one, two), "pos") == [("Q1", "P1", None, "a", 1), ("Q1", "P1", None, "b", 2), ("Q1", "P2", "Q5", "x", 3)]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)], "child int, parent int")
    assert graph.closure(edges, spark.createDataFrame([(0,)], "node int")).count() == 13


def test_white_space_of_any_kind_is_stripped(spark):
    from farsight.functions import text as X
    from farsight.operators import clean

    pages = spark.createDataFrame([("a", "\n\t\n", 1), ("a", "\u00a0x\n", 2), ("b", " \u3000", 3)], "k string, text string, pos int")
    assert rows(clean.keep_longest(pages, ["k"], "text", "pos")) == [("a", "x", 2)]
    got = spark.createDataFrame([("L", "a text\n")], "l string, c string").select(X.pair_text(F.col("l"), F.col("c"))).first()[0]
    assert got == "L : a text"


def test_keyword_filter_looks_at_values_at_any_depth(spark):
    from farsight.operators import clean

    schema = "related_tags array<struct<qid: string, label: string, wikipedia_title: string, more: array<struct<x: string>>>>"
    items = spark.createDataFrame([([("Q1", "a", "b", []), ("Q2", "a", "b", [("in Wikidata",)]), ("Q3", 'say "x": wikipedia', None, None)],)], schema)
    got = clean.drop_keyword_tags(items).first()
    assert [t.qid for t in got.related_tags] == ["Q1"] and got.removed == 2


def test_sweep_and_places(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.7, 0.0])], "qid long, embedding array<float>")
    edges, neutrals = spark.createDataFrame([(2, 1)], "qid long, tag long"), spark.createDataFrame([(1, 3, 1)], "tag long, neutral long, pos int")
    flipped = bank.withColumn("embedding", F.transform("embedding", lambda x: -x * x))
    got = ranking.sweep(edges, neutrals, {"a": bank, "b": flipped.filter("qid < 3")}, [2])
    assert rows(got.select("retriever", "rank", "sample_size")) == [("a", 2, 2), ("b", 1, 1)]
    r = spark.createDataFrame([("a", 10, None), ("b", 10, 0.2), ("c", 10, 0.9), ("c", 20, 0.1)], "retriever string, n int, ratio double")
    assert rows(ranking.by_first(r, "ratio", 10).select("retriever", "place").distinct()) == [("a", 3), ("b", 2), ("c", 1)]


def test_constant_and_cosine_models_and_span_scores(spark):
    data = spark.createDataFrame([(i, [1.0, 0.0, float(i % 2), float(1 - i % 2), 0.0, 0.0, 0.0, 0.0], float(i % 4)) for i in range(40)], "qid long, v array<double>, y double")
    data = data.select("qid", array_to_vector("v").alias("features"), "y")
    assert models.predicted(models.fitted("mean", data), data).select("pred").distinct().collect() == [(1.5,)]
    assert sorted(round(r[0], 6) for r in models.predicted(models.fitted("cosine", data), data).select("pred").distinct().collect()) == [0.5, 1.0]
    texts = spark.createDataFrame([(i, f"word{i % 5} other", float(i % 5)) for i in range(30)], "qid long, text string, y double")
    train = encode.embed(texts, "text").select("qid", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), "y")
    pairs = spark.createDataFrame([("word1", "see word1 here"), ("none", "see word2 here"), (None, None)], "label string, context string")
    got = {r.label: r for r in models.score_pairs(pairs, models.artifact(train), "m", text_mode="span").collect()}
    alone = models.score_pairs(spark.createDataFrame([("x", "word1")], "label string, context string"), models.artifact(train), "m", text_mode="context").first()
    assert len(got) == 3 and got["word1"].risk_score == pytest.approx(alone.risk_score, abs=1e-6) and got["none"].score_text_mode == "span"


def test_ranks(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.7, 0.0]), (4, [0.5, 1.0]), (5, [0.1, 0.0])], "qid long, embedding array<float>")
    edges = spark.createDataFrame([(2, 1)], "qid long, tag long")
    neutrals = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (1, 5, 3), (1, 99, 4)], "tag long, neutral long, pos int")
    assert rows(ranking.ranks(edges, neutrals, bank, [3, 10])) == [(2, 1, 3, 2, 3), (2, 1, 10, 2, 4)]
    assert rows(ranking.block_ranks(edges, neutrals, bank, 10)) == [(2, 1, 2, 4)]
    many = spark.createDataFrame([(1, 2, u) for u in range(9)], "qid long, tag long, neutral long")
    assert ranking.capped(many, 4).count() == 3


def test_scores(spark):
    df = spark.createDataFrame([([1, 49, 50, 51],), ([],), ([60, 2],), ([1, 2, 3, 4],)], "r array<int>").coalesce(1)
    got = df.select(scores.below("r"), scores.in_top("r"), scores.percentile("r")).collect()
    assert got[0][0] == 0.5 and got[1][0] == 0.0 and got[1][1] == 1.0 and got[2][1] == 1.0 and got[3][2] == pytest.approx(3.7)
    with pytest.raises(ValueError, match="worst_rank"):
        scores.score("nothing")
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in flat.select(scores.normalised(flat, "x", "zscore")).collect()] == [0.0, 0.0]
    assert [r[0] for r in flat.select(scores.normalised(flat, "x", "minmax")).collect()] == [0.0, 0.0]
    hl = spark.createDataFrame([(1, 0.5), (1, 0.6), (2, 0.6)], "n int, score double")
    assert rows(scores.high_low(hl).select("n", "ratio")) == [(1, 0.5), (2, None)]


def test_statistics(spark):
    y = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "y double")
    assert rows(stats.histogram(y, "y", 2).select("bin", "n")) == [(0, 1), (1, 2)]
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, pred double")
    m = stats.regression_metrics(const).first()
    assert m.r2 == 0 and m.pearson == 0
    low = spark.createDataFrame([("low", "low")] * 3, "truth string, pred string")
    assert stats.confusion(low).count() == 9 and stats.overall_metrics(low).first().mcc == 0
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5, 200).astype(float)
    b = a + rng.integers(0, 3, 200)
    got = stats.spearman(spark.createDataFrame([(float(x), float(z)) for x, z in zip(a, b, strict=True)], "y double, pred double")).first()[0]

    def mean_rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    assert got == pytest.approx(np.corrcoef(mean_rank(a), mean_rank(b))[0, 1])
    curves = spark.createDataFrame([("c", 1, 1, 3.0), ("c", 1, 2, 1.0), ("c", 2, 1, 5.0)], "config string, seed int, epoch int, loss double")
    assert rows(stats.curve_band(curves, 2)) == [("c", 1, 4.0, 3.0, 5.0), ("c", 2, 3.0, 1.0, 5.0)]
    best = spark.createDataFrame([("b", 1.0, 2), ("a", 1.0, 1)], "model string, rmse double, pos int")
    assert stats.best_model(best).first().model == "a"


def test_samples(spark):
    df = spark.createDataFrame([(i, 0.0 if i == 0 else 0.5) for i in range(10)] + [(10, 1.5)], "id int, y double")
    assert sampling.by_histogram(df, "y", "id", 3, "count", 3).count() == 5
    assert sampling.by_histogram(df, "y", "id", 3, "average").count() == 6
    assert sampling.by_histogram(df, "y", "id", 3, "percentage", 0.5).count() == 7  # 1 + ceil(0.5 * 9) + 1
    with pytest.raises(ValueError):
        sampling.by_histogram(df, "y", "id", 3, "other")
    assert sampling.split_sizes(101) == (69, 16, 16)
    parts = dict(rows(sampling.split(spark.range(101), "id").groupBy("part").count()))
    assert parts == {"train": 69, "val": 16, "test": 16}
    sizes = [r[1] for r in rows(sampling.shards(spark.range(10), "id", 4).groupBy("shard").count())]
    assert sizes == [3, 3, 2, 2]
    assert sampling.range_splits(spark.range(10), "id", 4).filter("split = 2").count() == 2
    assert sampling.range_splits(spark.range(10), "id", 4, drop_tail=True).count() == 8


def test_ridge_is_closed_form(spark):
    rng = np.random.default_rng(1)
    x, n = rng.normal(size=(200, 3)), 200
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "qid int, v array<double>, y double").select("qid", array_to_vector("v").alias("features"), "y")
    got = models.fitted("linear", df).coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    assert got == pytest.approx(np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc), abs=1e-9)
    z = np.array([r[0] for r in models.standardised(df).select(F.col("features")).collect()])
    assert np.asarray([v.toArray() if hasattr(v, "toArray") else v for v in z]).std(0) == pytest.approx([1, 1, 1])
    p = np.array([r[0] for r in models.principal(df).orderBy("qid").select("projection").collect()])
    u = np.linalg.svd(xc, full_matrices=False)[2][:2]
    assert np.abs(p) == pytest.approx(np.abs(xc @ u.T), abs=1e-8)


def test_encoders_bank_and_spans(spark):
    docs = spark.createDataFrame([(1, "The red cat sat", "red cat"), (2, "no such", "zz")], "doc_id long, text string, phrase string")
    assert rows(encode.span_tokens(docs).select("start", "end", "token")) == [(4, 7, "red"), (8, 11, "cat")]
    assert encode.embed_spans(docs).select(F.round(V.norm(F.col("embedding")), 6)).first()[0] == 1.0
    bank = encode.embed(spark.createDataFrame([("a", "x y")], "qid string, text string"), "text")
    more = spark.createDataFrame([("a", "x y"), ("b", "z")], "qid string, text string")
    assert rows(encode.extend_bank(bank, more).select("qid")) == [("a",), ("b",)]
    encode.register_encoder("tiny", lambda: encode.hashing_encoder(8))
    with pytest.raises(ValueError, match="entries"):
        encode.extend_bank(bank, more, "tiny")
    with pytest.raises(ValueError, match="unknown encoder"):
        encode.encoder("rader")


def test_files(spark, tmp_path):
    good, bad = json.dumps({"qid": "Q1", "label": "a", "related_tags": ["x"]}), "{broken"
    (tmp_path / "items_with_tags_0.jsonl").write_text(good + "\n\n" + bad + "\n")
    read = lambda strict: tables.read_json_lines(spark, str(tmp_path), tables.ITEM_V1, strict, glob="items_with_tags_*.jsonl")
    assert read(False).count() == 1
    with pytest.raises(Exception):
        read(True).collect()
    assert tables.bad_lines(spark, str(tmp_path), tables.ITEM_V1).first()[0] == 1
    (tmp_path / "map.json").write_text(json.dumps({"Q1": {"qid": "Q1", "label": "a", "related_tags": []}}))
    assert tables.read_relation_map(spark, str(tmp_path / "map.json")).first().label == "a"
    tables.write_json_lines(spark.range(3), str(tmp_path / "out"), gzip=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert [r.id for r in tables.after_key(spark.range(10), "id", 3, 2).collect()] == [4, 5]
    assert [r.id for r in tables.page_of(spark.range(10), "id", 1, 4).collect()] == [4, 5, 6, 7]
    report = tables.scan_report(spark.createDataFrame([("q", "l", [])], "qid string, label string, ranks array<int>"), scores.below).first()
    assert math.isnan(report.risk_score)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "qid string").coalesce(1).write.json(str(src))
    stream = lambda: incremental.read_stream(spark, str(src), "qid string")
    key, pair = T.StructType.fromDDL("qid string"), T.StructType.fromDDL("qid string, label string")
    for _ in range(2):  # a restart adds nothing
        incremental.into_set(stream(), str(tmp_path / "set"), str(tmp_path / "c1")).awaitTermination()
    assert rows(incremental.committed(spark, str(tmp_path / "set"), key).select("qid")) == [("a",), ("b",)]
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "qid string, label string")
    incremental.label_missing(stream(), names, str(tmp_path / "labels"), str(tmp_path / "c2")).awaitTermination()
    assert rows(incremental.committed(spark, str(tmp_path / "labels"), pair).select("qid", "label")) == [("a", "A"), ("b", "B")]
    incremental.scored(stream(), lambda d: d.withColumn("s", F.length("qid")), str(tmp_path / "s"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    q = incremental.distinct_ids(stream()).writeStream.format("memory").queryName("ids").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ids").count() == 2


def test_a_batch_that_dies_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    src, sink, key = str(tmp_path / "in"), str(tmp_path / "set"), T.StructType.fromDDL("qid string")
    add = lambda *ids: spark.createDataFrame([(i,) for i in ids], "qid string").coalesce(1).write.mode("append").json(src)
    run = lambda: incremental.into_set(incremental.read_stream(spark, src, "qid string"), sink, str(tmp_path / "c")).awaitTermination()
    seen = lambda: rows(incremental.committed(spark, sink, key))
    add("a", "b")
    run()
    assert seen() == [(0, "a"), (0, "b")]
    write, died = incremental.write_batch, []

    def dies(df, path, number):
        write(df, path, number)
        incremental.versions.remove(spark, f"{path}/_commits/{number}")  # its rows are there, its record isn't
        died.append(number)
        raise RuntimeError("lost")

    add("b", "c")
    monkeypatch.setattr(incremental, "write_batch", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    assert died == [1] and seen() == [(0, "a"), (0, "b")] and spark.read.parquet(f"{sink}/batch=1").count() == 1
    monkeypatch.setattr(incremental, "write_batch", write)
    run()
    assert seen() == [(0, "a"), (0, "b"), (1, "c")]
    # a batch that had its record but not yet the stream's: the same again
    write(spark.createDataFrame([("c",)], "qid string"), sink, 1)
    assert seen() == [(0, "a"), (0, "b"), (1, "c")] and incremental.commits(spark, sink).count() == 2
    version = incremental.compacted(spark, sink, key, str(tmp_path / "whole"))
    assert version == 1 and rows(incremental.versions.read_table(spark, str(tmp_path / "whole"), "rows")) == [("a",), ("b",), ("c",)]


def test_state_of_repeats_is_bounded(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:00:40"), (None, "2024-01-01 00:00:41")], "qid string, t string").coalesce(1).write.json(src)
    stream = incremental.read_stream(spark, src, "qid string, t timestamp")
    q = incremental.distinct_within(stream, "t", "1 minute").writeStream.format("memory").queryName("within").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("within").select("qid")) == [("a",), ("b",)]


def test_canonical_labels_of_whole_texts(spark, tmp_path):
    from farsight import queries

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('x', 10000000), cast(id div 2 as string))").alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.keep_first_canonical(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [0, 2] and len({r.canon for r in got}) == 2
