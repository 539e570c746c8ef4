"""Packing in order against the tokenizer, a plain dynamic program, and on odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.llm import ordered_packing as O

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "One two. Three four! Five"), (2, ""), (3, None), (None, "no id"), (5, "<|endoftext|> <|ENDOFTEXT|> x."), (5, "again"), (6, "word " * 9000),
    (7, "H̱ Á É　日本。 don't I'LL 12.5 (\"Yes.\") \x1c \x85 a|b| ΣΑΣ"), (8, "x" * 30_000), (1, "One two. Three four! Five"), (9, "\n\t "), (10, "A b.\nC d\ne. " * 700),
]


def checked(rows, size=4096):
    """The rows hold every id once, in sequences without gaps, in the order of the documents."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= size
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return t, by


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, x, "no", "no") for d, x in ODD], "doc_id long, text string, start string, sequence_id string").coalesce(1)
    rows = O.pack_in_order(docs, PATH, size=512).collect()
    t, _ = checked(rows, 512)
    rows.sort(key=lambda r: (r.sequence_id, r.offset))  # the order of the documents
    at = 0
    for d, x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        done = 0
        while done < len(ids):
            r = rows[at]
            assert (r.doc_id, r.start, r.doc_tokens) == (d, done, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[done : done + r.length], "<u4").tobytes())
            done, at = done + r.length, at + 1
        assert done == len(ids)
    assert at == len(rows)
    assert O.pack_in_order(docs.limit(0), PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = O.pack_in_order(docs, PATH).collect()
    t, by = checked(rows)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(got[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = np.array([sum(r.length for r in s) for s in by.values()])
    padding = np.where(sizes & (sizes - 1), 4096 - sizes, 0).sum()
    assert padding < 0.03 * sizes.sum()


def plain_best(places, penalty, size):
    """The least cost, by trying every start of every window."""
    cost = {0: 0}
    for i in range(1, len(places)):
        late = places[-1] - size <= places[i]
        tries = []
        for j in range(i):
            n = int(places[i] - places[j])
            if n <= size:
                exact = n & (n - 1) == 0 and (n >= O.LEAST or late)
                tries.append(cost[j] + (0 if exact else size - n) + O.WINDOW + int(penalty[i]))
        cost[i] = min(tries)
    return cost[len(places) - 1]


def test_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(O, "LEAST", 8)
    rng = np.random.default_rng(1)
    for size in (32, 64):
        for _ in range(40):
            lengths = rng.integers(1, rng.integers(2, 90), rng.integers(1, 12))
            stops = np.unique(rng.integers(1, lengths.sum() + 1, rng.integers(0, 40)))
            places, penalty = O.possible_cuts(lengths, stops, step=16)
            assert places[0] == 0 and places[-1] == lengths.sum() and np.diff(places).max() <= 16
            assert not set(np.cumsum(lengths)) - set(places)
            cuts = O.best_cuts(places, penalty, size)
            n = np.diff(cuts)
            late = cuts[1:] >= places[-1] - size
            exact = ((n & (n - 1)) == 0) & ((n >= 8) | late)
            cost = np.where(exact, 0, size - n).sum() + O.WINDOW * len(n) + penalty[np.isin(places, cuts[1:])].sum()
            assert n.max() <= size and cost == plain_best(places, penalty, size)


def test_sentences_end_with_stops():
    encoder = O.WordIds(PATH)
    text = 'One two. (Three "four!") five,\nsix 7.5 eight?'
    ids, lengths, stops = encoder.of_texts([text.encode(), b"", b"nine"], 2)
    cut = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in ("One two.", '(Three "four!")', "five,", "six 7.5 eight?")]
    assert stops.tolist() == np.cumsum([len(c) for c in cut]).tolist()
    assert lengths.tolist() == [sum(map(len, cut)) + 1, 1, 2] and len(ids) == lengths.sum()
