"""Phrases against brute force, SQL and on odd rows."""

import os
import re
from collections import Counter, defaultdict

import pytest

from farsight.llm import collocations as C

DATA = "/root/testdata/sf0.01"
ODD = [
    ("New York city, new york City. new york", "en"), ("in new york city\tnew  york city", "en"), ("a a a a a a a", "en"), (None, "en"), ("", None), ("x y. x y; x y", None), ("x y", "und"),
    ("one two three four five six seven", "de"), ("One two three four five six", "de"), ("one two three four five! one\ntwo", "de"), ("Ünï é, ünï é", "fr"), ("\x0b\x1c \x00 w\x00", "fr"),
    ("one two three four five six seven", "de"), ("w" * 5000 + " z", "de"), ("w" * 5000 + " z", "de"), ("a b a b a b a b a b", "en"),
]


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((" ".join(p), a, left, right, n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 40), (2, 2000), (3, 5), (50, 5)])
def test_odd_rows(spark, least, top):
    docs = spark.createDataFrame([(*r, 7, "no") for r in ODD], "text string, lang string, n int, phrase string").repartition(3)
    assert sorted(map(tuple, C.collocations(docs, least, top).collect())) == brute(ODD, least, top)
    assert C.collocations(docs.limit(0), least, top).count() == 0


def test_a_full_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_SLOTS", 16)
    monkeypatch.setattr(C, "SLOT_BYTES", 1 << 40)
    monkeypatch.setattr(C, "CHUNK", 8)
    docs = spark.createDataFrame(ODD, "text string, lang string").repartition(2)
    assert sorted(map(tuple, C.collocations(docs, 2, 2000).collect())) == brute(ODD, 2, 2000)


def test_runs_make_no_difference(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "" for r in ODD]), pa.array([r[1] or "und" for r in ODD])], ["text", "lang"])
    every = SimpleNamespace(value=b"\xff" * 2)
    seen = []
    for run in (30, 1 << 20):
        monkeypatch.setattr(C, "RUN", run)
        seen.append(Counter())
        for out in C._windows([batch], every, every):
            for *window, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                seen[-1][tuple(window)] += n
    assert seen[0] == seen[1] and seen[0]["de", "one", "two", "three", "four", "five"] == 4 and seen[0]["de", "one", "", "", "", ""] == 1


def test_large_counts_are_exact(spark):
    """Products over 64 bits."""
    from unittest.mock import patch

    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a", 1, 2 * big + 1), ("en", "b", 1, 2 * big + 3), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    with patch.object(C, "phrase_counts", lambda docs, least: (found, spark.createDataFrame([("en", 10**15)], "lang string, n long"))):
        (row,) = C.collocations(found).collect()
    assert row.score == 1000 * big * 10**15 // ((2 * big + 1) * (2 * big + 3))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = C.query(spark, DATA).toPandas(), con.execute(C.ORACLE).df()
    rows = lambda df: sorted(df[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))
    assert len(want) > 50 and rows(got) == rows(want)
