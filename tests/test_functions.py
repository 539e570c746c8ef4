"""Golden rows for expressions and keep rules."""

import pytest
from pyspark.sql import functions as F

from farsight.functions import text as X
from farsight.functions import vectors as V
from farsight.operators import clean


def values(spark, expr, *rows, names=("a", "b")):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names[: len(rows[0]) if isinstance(rows[0], tuple) else 1]))
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_usable_labels(spark):
    labels = ["", "  ", "Q12", "Q", "Q1a", "123", "My WikiPedia", "Paris"]
    assert [x for x, ok in zip(labels, values(spark, X.usable_label(F.col("a")), *labels), strict=True) if ok] == ["Q", "Q1a", "Paris"]


def test_clean_tags(spark):
    df = spark.createDataFrame([(["Q5", "Wikimedia category", "a_b", "a/b", "WikiX", "city"],)], "t array<string>")
    assert df.select(X.clean_tags("t")).first()[0] == ["city"]


def test_canonical_label(spark):
    a, b, c, d = values(spark, X.canonical_label(F.col("a")), "Straße", "STRASSE", "ﬁn ", "fin")
    assert a == b and c == d and a != c


def test_self_reference(spark):
    rows = [("Par", "Paris"), ("Par", "par avion"), ("", "x")]
    assert values(spark, X.refers_to_itself(F.col("a"), F.col("b"), False), *rows) == [True, False, False]
    assert values(spark, X.refers_to_itself(F.col("a"), F.col("b"), True), *rows) == [True, True, False]


def test_paragraphs(spark):
    long = "x" * 60 + " may refer to:"
    assert values(spark, X.stub_paragraph(F.col("a")), "", "X may refer to:", long) == [False, True, False]
    nine, ten = "a b c d e f g h i", "a b c d e f g h i  é"
    early, late = "w " * 75 + "disambiguation " + "w " * 9, "w " * 125 + "disambiguation"
    got = values(spark, X.clean_paragraph(F.col("a")), nine, ten, "May refer to a b c d e f g h i", early, late)
    assert got == [None, "a b c d e f g h i é", None, None, late]


def test_page_key(spark):
    rows = [("Q1", None), (None, "Q2"), ("Q0", "Paris"), ("x", "Q3")]
    assert values(spark, X.page_key(F.col("a"), F.col("b")), *rows) == ["Q1", "Q2", None, "Q3"]


def test_pair_text_and_names(spark):
    rows = [("Ada", "ada was x"), ("Ada", "She was"), ("", "c")]
    assert values(spark, X.pair_text(F.col("a"), F.col("b")), *rows) == ["ada was x", "Ada : She was", "c"]
    assert values(spark, X.tag_name(F.col("a"), F.lit(""), F.lit(3)), "k") == ["k_3"]
    assert values(spark, X.iri_tail(F.col("a")), "http://x/entity/Q1", "http://x/prop/direct/P2", "y") == ["Q1", "P2", ""]


def test_occurrence(spark):
    rows = [("The cat, the dog", "the"), ("none here", "zz"), ("a.b a.b", "a.b")]
    assert values(spark, X.occurrence(F.col("a"), F.col("b"), 1), *rows) == [0, None, 0]
    assert values(spark, X.occurrence(F.col("a"), F.col("b"), 2), *rows) == [9, None, 4]
    assert values(spark, X.occurrence(F.col("a"), F.col("b"), 9), *rows) == [9, None, 4]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0, 1.0], [[1.0, float("nan")], [3.0, 2.0]])], "v array<double>, m array<array<double>>")
    score, mean, unit = df.select(V.paired_cosine(F.col("v")), V.mean_vector(F.col("m")), V.normalised(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert score == pytest.approx(1.0) and mean == [2.0, 1.0] and unit == [0.0, 0.0]
    with pytest.raises(Exception, match="multiple of 4"):
        df.select(V.paired_cosine(F.array(*map(F.lit, range(6))))).collect()
    s = spark.createDataFrame([(x,) for x in (-1.0, 0.329, 0.33, 0.66, 2.0)], "x double").coalesce(1)
    assert [r[0] for r in s.select(V.score_class(F.col("x"))).collect()] == ["low", "low", "medium", "high", "high"]


def test_keep_rules(spark):
    items = spark.createDataFrame([("Q1", "A", ["Q5"], "f", 1), ("Q1", "A", ["city"], "f", 2), ("Q1", "A", ["town"], "f", 3)], "qid string, label string, related_tags array<string>, file string, pos long")
    assert [r.pos for r in clean.keep_first_with_tags(items).collect()] == [2]
    pages = spark.createDataFrame([("a", "xxx", 1), ("a", "yyyyy", 2), ("a", "zzzzz", 3), ("b", " ", 4)], "qid string, text string, pos long")
    assert [r.pos for r in clean.keep_longest(pages, ["qid"], "text", "pos").collect()] == [2]
    assert [r.text for r in clean.keep_last(pages.filter("qid = 'a'"), ["qid"], "pos").collect()] == ["zzzzz"]
