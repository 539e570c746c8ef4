"""Interval joins, windows around phrases, text-keyed banks, tiles of similarities and the form of items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.operators import clean, encode, graph, ranking


def test_overlaps_are_found_once(spark):
    rng = random.Random(1)
    ranges = lambda n, most: [(rng.randrange(3), a := rng.randrange(300), a + rng.randrange(most)) for _ in range(n)]
    left, right = [(*x, i) for i, x in enumerate(ranges(200, 9))], [(*x, i) for i, x in enumerate(ranges(60, 200))]
    a, b = spark.createDataFrame(left, "doc_id long, start int, end int, l int"), spark.createDataFrame(right, "doc_id long, c0 int, c1 int, r int")
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))
    for width in (1, 7, 64):
        assert sorted((r.l, r.r) for r in encode.overlapping(a, b, width=width).select("l", "r").collect()) == want
    assert want


def test_windows_and_vectors_see_the_context(spark):
    docs = spark.createDataFrame([(1, "a b c The Cat d e f", "the cat"), (2, "x THE CAT", "the cat"), (3, "none", "the cat"), (4, "the cat the cat", "the cat")], "doc_id long, text string, phrase string")
    got = {r.doc_id: (r.first, r.last, r.start, r.tokens) for r in encode.span_windows(docs, limit=4, context=1).collect()}
    assert got == {1: (3, 5, 2, ["c", "The", "Cat", "d"]), 2: (1, 3, 0, ["x", "THE", "CAT"]), 4: (0, 2, 0, ["the", "cat", "the", "cat"])}
    assert {r.doc_id: r.tokens for r in encode.span_windows(docs).collect()}[1] == ["The", "Cat"]  # without context the window is the phrase
    seen = {}

    def maker():
        def run(windows):
            return [np.array([[float(len(w)), float(i), 1.0] for i in range(len(w))]) for w in windows]

        return run

    encode.register_token_encoder("places", maker)
    seen = {r.doc_id: r.embedding for r in encode.embed_spans(docs, "places", limit=4, context=1).collect()}
    for d, mean in ((1, [4, 1.5, 1]), (2, [3, 1.5, 1]), (4, [4, 0.5, 1])):
        assert np.allclose(seen[d], np.array(mean) / np.linalg.norm(mean))


def test_text_bank(spark):
    asked = spark.createDataFrame([(3, "b", "Q2"), (1, "a", None), (2, "a", "Q1"), (4, "b", "Q9"), (5, None, "Q5"), (6, "", "Q6")], "pos int, text string, qid string")
    bank = encode.extend_text_bank(encode.text_bank(spark), asked).cache()
    assert sorted((r.text, r.qid) for r in bank.collect()) == [("", "Q6"), ("a", ""), ("b", "Q2")]
    more = encode.extend_text_bank(bank, spark.createDataFrame([(1, "b", "Q7"), (2, "c", "Q2")], "pos int, text string, qid string")).cache()
    assert sorted((r.text, r.qid) for r in more.collect()) == [("", "Q6"), ("a", ""), ("b", "Q2"), ("c", "Q2")]
    got = encode.answered(asked.filter("text is not null"), more).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (6, "")] and got[0].embedding == got[1].embedding != got[2].embedding
    with pytest.raises(Exception, match="not in the bank"):
        encode.answered(spark.createDataFrame([(1, "zz")], "pos int, text string"), bank).collect()
    encode.register_encoder("small", lambda: encode.hashing_encoder(8))
    with pytest.raises(ValueError, match="entries"):
        encode.extend_text_bank(bank, spark.createDataFrame([(1, "new", "Q")], "pos int, text string, qid string"), "small")


def test_tiles_give_every_pair_its_similarity(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 6)).astype(np.float32)
    bank = spark.createDataFrame([(f"Q{i}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "qid string, embedding array<float>")
    pairs = [(f"Q{a}", f"Q{b}", int(k)) for k, (a, b) in enumerate(rng.integers(0, 66, (500, 2)))] + [("Q1", f"Q{i}", 1000 + i) for i in range(60)] + [("none", "Q1", 7000), ("Q1", "Q2", None)]
    df = spark.createDataFrame(pairs, "tag string, other string, k int")
    at = lambda q: int(q[1:]) if q != "none" else 99
    want = sorted((a, b, str(k), float(v[at(a)].astype(float) @ v[at(b)].astype(float))) for a, b, k in pairs if at(a) < 60 and at(b) < 60)
    for size, part in ((200, 5), (1 << 20, 1 << 20)):
        monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
        monkeypatch.setattr(ranking, "TILE_PAIRS", part)
        got = sorted((r.tag, r.other, str(r.k), r.sim) for r in ranking.tag_similarities(df, bank).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


def test_block_ranks_are_the_ranks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (40, 4)).astype(float)  # many equal similarities
    bank = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid long, embedding array<double>")
    edges = spark.createDataFrame(sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (120, 2))} | {(i, 5) for i in range(40)}), "qid long, tag long")
    near = [(t, int(o), p + 1) for t in range(40) for p, o in enumerate(rng.permutation(40)[: rng.integers(0, 20)])]
    neutrals = spark.createDataFrame(near, "tag long, neutral long, pos int")
    want = sorted((r.qid, r.tag, r["rank"], r.sample_size) for r in ranking.ranks(edges, neutrals, bank, [12]).collect())
    assert sorted((r.qid, r.tag, r["rank"], r.sample_size) for r in ranking.block_ranks(edges, neutrals, bank, 12).collect()) == want


def test_nodes_with_several_labels_keep_the_first(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice("xyz"), i) for i in range(60)]
    best = {}
    for s, d, label, pos in edges:
        best[d] = min(best.get(d, ((9,), "")), ((1, pos, 0), label))
    for _, d1, _, p1 in edges:
        for s, d, label, p2 in edges:
            if s == d1:
                best[d] = min(best[d], ((2, p1, p2), label))
    got = graph.unique_nodes(spark.createDataFrame(edges, "src long, dst long, label string, pos long")).collect()
    assert {r.node: r.label for r in got} == {k: v[1] for k, v in best.items()}
    hops = {}
    for s, d, *_ in edges:
        hops.setdefault(s, set()).add(d)
    lists = graph.neighbour_lists(spark.createDataFrame(edges, "src long, dst long, label string, pos long")).collect()
    assert {r.dst: r.hops for r in lists} == {k: sorted(v) for k, v in hops.items() if k in {e[1] for e in edges}}


def test_the_form_of_items_is_checked(spark):
    hop = "array<struct<qid: string, label: string>>"
    schema = f"qid string, related_tags array<struct<qid: string, label: string, one_hop_related_tags: {hop}>>"
    check = lambda tags: clean.validated(spark.createDataFrame([("Q1", tags)], schema)).count()
    assert check([("Q2", "a", [("Q3", "b"), (None, "c")]), (None, "d", [])]) == 1 and check([]) == 1
    for tags, fault in (
        (None, "missing"), ([("Q2", None, [])], "lacks its label"), ([(" ", "a", [])], "blank id"), ([("Q2", "a", None)], "lacks one_hop"),
        ([("Q2", "a", [("Q3", None)])], "one-hop tag lacks"), ([("Q2", "a", [("", "x")])], "one-hop tag has a blank"), ([None], "lacks its label"),
    ):
        with pytest.raises(Exception, match=f"Q1: .*{fault}"):
            clean.validated(spark.createDataFrame([("Q1", tags)], schema)).collect()
