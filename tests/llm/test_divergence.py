"""The audit of sources against brute force, SQL and on odd rows."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.llm import divergence as D

DATA = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LONG = "x" * 40
ODD = [
    ("the cat the DOG Ünï été", "en", "a"), ("the cat", "en", "a"), ("THE dog's 日本語テキスト " + LONG, "en", "b"), (None, "en", "c"), ("the the " + LONG, "en", None),
    ("eins zwei", None, "a"), ("eins", None, None), ("", "xx", "a"), ("", "xx", "b"), ("solo solo", "yy", "a"), ("abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq", "en", "b"),
    ("abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq abcdefghijklmnopq", "en", "hot"), ("the cat", "en", "a"), ("a\x7fb\x00c", "en", "hot"), ("a b c", "en", "hot"),
]


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(lower))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = lambda c, all_: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in all_) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s], kept) for s in sources}
        q = share(every, kept)
        for s in sources:
            rows_ = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in rows_.items():
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 3), (2, 50), (3, 50), (99, 5)])
def test_odd_rows(spark, least, top):
    docs = spark.createDataFrame([(*r, 1, "no") for r in ODD], "text string, lang string, source string, n int, term string").repartition(4)
    assert sorted(map(tuple, D.audit(docs, least, top).collect())) == brute(ODD, least, top)
    assert D.audit(docs.limit(0), least, top).count() == 0


def test_blocks_and_runs_make_no_difference(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in ODD]) for i in range(3)], ["text", "lang", "source"])
    seen = []
    for run in (16, 1 << 20):
        monkeypatch.setattr(D, "RUN", run)
        seen.append(Counter())
        for out in D._counted([batch]):
            for *term, n, docs in zip(*(c.to_pylist() for c in out.columns), strict=True):
                seen[-1][*term, "n"] += n
                seen[-1][*term, "docs"] += docs
    assert seen[0] == seen[1] and seen[0]["en", "a", "the", "n"] == 4 and seen[0]["en", "a", "the", "docs"] == 3
    entry = pa.array([[{"source": "b", "n": 4}], [{"source": "a", "n": 1}, {"source": "c", "n": 9}], [{"source": "a", "n": 2}]])
    k = len(entry)
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * k), entry, pa.array([["a", "b", "c"]] * k), pa.array([[3, 4, 9]] * k), pa.array([3] * k)], ["lang", "found", "sources", "totals", "kept"])
    found = []
    for cells in (1, 1 << 20):
        monkeypatch.setattr(D, "CELLS", cells)
        found.append([o.to_pydict() for o in D._distances([rows])])
    p = [[1 + 10**9 * (c + 5) // (t + 15) for c in counts] for counts, t in (((0, 1, 2), 3), ((4, 0, 0), 4), ((0, 9, 0), 9))]
    want = {(i, j): sum(abs(a - b) for a, b in zip(p[i], p[j])) for i in range(3) for j in range(i + 1, 3)}
    assert found[0] == found[1] and dict(zip(zip(found[0][0]["i"], found[0][0]["j"]), found[0][0]["value"])) == want


def test_radix_order_and_packing():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(58)]
    assert D.radix_order(keys).tolist() == np.lexsort(keys[::-1]).tolist()
    raw = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in rng.integers(1, 17, 300)]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    sizes = np.array([len(r) for r in raw])
    order = D.radix_order(D.packed(data, ends - sizes, sizes, 2))
    assert [raw[i] for i in order] == sorted(raw)


def test_large_counts_are_exact(spark):
    n = np.array([0, 7, 10**12], np.int64)
    want = [1 + 10**9 * (int(x) + 5) // (3 * 10**12 + 5 * 11) for x in n]
    assert D.shares(n, 3 * 10**12, 11).tolist() == want
    got = spark.createDataFrame([(int(x),) for x in n], "n long").select(D.share(F.col("n"), F.lit(3 * 10**12), F.lit(11)).alias("p")).collect()
    assert [r.p for r in got] == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = D.query(spark, DATA).toPandas()
    want = con.execute(D.ORACLE).df()
    rows = lambda df: sorted(df[["lang", "source", "part", "item", "value", "rank"]].itertuples(index=False, name=None))
    assert len(want) > 2000 and rows(got) == rows(want)
