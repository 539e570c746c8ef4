"""Steps whose time, files or memory grew faster than their input."""

import glob
import os
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farsight import queries
from farsight.functions import order
from farsight.functions import text as X
from farsight.operators import encode, graph, neutral, ranking, sampling
from farsight.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shards_of_many_ranges_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "RANGE", 100)
    spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).write.parquet(str(tmp_path / "k"))
    got = sampling.shards(spark.read.parquet(str(tmp_path / "k")), "k", 7).orderBy("k").collect()
    sizes = [143] * 6 + [142]
    assert [r.shard for r in got] == [i for i, n in enumerate(sizes) for _ in range(n)]


def test_a_split_is_one_file(spark, tmp_path):
    df = spark.range(400).repartition(4).select("id", (F.col("id") % 20).alias("split"), F.when(F.col("id") % 11 == 0, "late").alias("_error"))
    tables.write_splits(df, str(tmp_path))
    assert all(len(glob.glob(f"{tmp_path}/items/split={i}/*.json")) == 1 for i in range(20))
    assert spark.read.json(f"{tmp_path}/items").count() + spark.read.json(f"{tmp_path}/failed").count() == 400


def test_draws_and_related_ids_meet_once(spark):
    targets, nodes = spark.range(40).select(F.col("id").alias("target")), spark.range(60).select(F.col("id").alias("node"))
    related = nodes.crossJoin(targets).filter("(node + target) % 3 = 0").select("target", "node")
    got = neutral.neutral_sample(targets, nodes, related.unionByName(related.withColumn("target", F.lit(99).cast("long"))), 10)
    assert "SortMergeJoin" not in plan(got) and "Exchange" not in plan(got)  # what is left reads the rows that were written
    by = {}
    for r in got.collect():
        by.setdefault(r.target, []).append((r.pos, r.neutral))
    assert sorted(by) == list(range(40))
    for t, x in by.items():
        assert sorted(p for p, _ in x) == list(range(1, 11)) and len({n for _, n in x}) == 10 and not any((n + t) % 3 == 0 or n == t for _, n in x)


def test_related_tags_keep_all_lines(spark, tmp_path):
    spark.createDataFrame([(1, 10, 20, 1), (1, 10, 21, 2), (1, 10, 22, 3)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"S{i}"[:2]) for i in (20, 21, 22)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [tuple(r) for r in queries.related_tags(spark, str(tmp_path)).select("qid", "tags").collect()] == [("Q10", "Q20,Q21,Q22")]
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.execute(queries.ORACLES["related_tags"]).fetchall() == [("Q10", "Q20,Q21,Q22")]


TEXTS = ["a b c The Cat d e f", "xthe catx y", " \t the\ncat", "the cat", "", None, "q the  cat the cat z", "\U0001f600 \U0001f600the cat\U0001f600 end", "w " * 700 + "see the cat " + "v " * 300, "no"]


def test_windows_without_rows_for_words(spark):
    docs = spark.createDataFrame([(i, t, "the cat") for i, t in enumerate(TEXTS)] + [(None, "the cat", "the cat")], "doc_id long, text string, phrase string")
    for nth, limit, context in ((1, 9, 4), (2, 3, 0), (1, 1, 0)):
        df = encode.span_windows(docs, nth=nth, limit=limit, context=context)
        assert "Exchange" not in plan(df) and "Generate" not in plan(df)
        every = encode.tokens(docs.filter("doc_id is not null")).collect()
        spans = {r.doc_id: (r.c0, r.c1) for r in encode.phrase_spans(docs, nth=nth).collect()}
        want = {}
        for d, (c0, c1) in spans.items():
            if d is None:
                continue
            words = sorted((t.start, t.end, t.token) for t in every if t.doc_id == d)
            hit = [i for i, (a, b, _) in enumerate(words) if max(a, c0) < min(b, c1)]
            want[d] = (hit[0], hit[-1] + 1, [w for *_, w in words])
        got = {r.doc_id: r for r in df.collect()}
        assert set(got) == set(want)
        for d, (first, last, words) in want.items():
            r = got[d]
            assert (r.first, r.last) == (first, last) and r.tokens == words[r.start : r.start + len(r.tokens)] and 0 < len(r.tokens) <= limit


def test_offsets_of_long_texts(spark):
    texts = ["ab c" * 1 + " dd\t" * n for n in (0, 1, 255, 256, 257, 1000)] + [" x", "", None]
    got = {}
    for r in encode.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.token))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(m.start(), m.end(), m[0]) for m in encode._WORDS.finditer(t or "")]


def test_first_labels_add_up_before_they_meet(spark):
    edges = spark.createDataFrame([(1, 2, "b", 5), (1, 2, "a", 5), (3, 2, "c", 7), (2, 4, "d", None), (1, 4, "e", 1), (9, 9, "f", 3)], "src long, dst long, label string, pos long")
    df = graph.unique_nodes(edges)
    assert {r.node: r.label for r in df.collect()} == {2: "a", 4: "d", 9: "f"}
    assert "HashAggregate" in plan(df) and "Join" not in plan(df)


def test_lines_of_an_edge_add_up_in_hash_tables(spark, tmp_path):
    spark.createDataFrame([(7, 1, 2, 1), (3, 1, 2, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = queries._edges(spark, str(tmp_path))
    assert [tuple(r) for r in e.collect()] == [(1, 2, 3)] and "SortAggregate" not in plan(e)


def test_encoders_get_few_rows_at_a_time(spark):
    encode.register_encoder("counted", lambda: lambda texts: np.array([[float(len(texts)), float(len(t)) + 1] for t in texts]))
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(150)], "k int, text string").coalesce(1)
    e = encode.embed(df, "text", "counted", batch=64)
    assert "MapInArrow" in plan(e)  # a batch is not Python objects as a whole
    got = {r.k: r.embedding for r in e.collect()}
    for i in range(150):
        v = np.array([64.0 if i < 128 else 22.0, (0 if i % 5 == 0 else i) + 1.0])
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)


def test_plain_labels_stay_out_of_the_workers(spark, monkeypatch):
    labels = ["  Plain ", "Ångström ", "Straße", None, ""]
    df = spark.createDataFrame([(x,) for x in labels], "label string").select(X.canonical_label(F.col("label")).alias("c"))
    assert [r.c for r in df.collect()] == [unicodedata.normalize("NFKC", x or "").casefold().strip() for x in labels]
    assert "ArrowEvalPython" in plan(df) and "NOT RLIKE" in plan(df).upper().replace("(", "").replace("COALESCELABEL#", "")
    assert X._canonical(pa.array([None, *labels[:2]] * 300)).to_pylist()[-1] == "ångström"


def test_a_tile_holds_numbers_not_objects():
    ids = [np.array([5, 7, 9]), np.array([7, 11])]
    side = ranking._Side(ids, [np.eye(3, dtype=np.float32), np.full((2, 3), 2, np.float32)])
    assert side.index.dtype == np.int64 and side.vectors.dtype == np.float32
    at = side.places(pa.array([11, None, 7, 6, 5]))
    assert [None if a < 0 else side.rows(np.array([a]))[0].tolist() for a in at] == [[2, 2, 2], None, [2, 2, 2], None, [1, 0, 0]]
    named = ranking._Side([ranking._Side.values(pa.array(["a", "b"]))], [np.eye(2, dtype=np.float32)])
    assert named.places(pa.array(["b", None, "c"])).tolist() == [1, -1, -1] and ranking._Side([], []).places(pa.array([1])).tolist() == [-1]


def test_a_sweep_finds_its_neutrals_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    bank = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "qid long, embedding array<double>")
    neutrals = spark.createDataFrame([(0, i, i) for i in range(1, 6)], "tag long, neutral long, pos int").mapInArrow(count, "tag long, neutral long, pos int")
    edges = spark.createDataFrame([(3, 0)], "qid long, tag long")
    found = ranking.sweep(edges, neutrals, {"a": bank, "b": bank}, [3, 9])
    assert sorted((r.retriever, r.n, r["rank"], r.sample_size) for r in found.collect()) == [(x, n, 1, k) for x in "ab" for n, k in ((3, 3), (9, 6))]
    assert seen.value == 5
