"""The training-data operators against brute force, held-out labels and SQL, and on odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farsight.llm import common, fingerprint, html, jaccard, language, mixing, packing, quality, substring, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 9),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 9),
    (3, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y", "en", "b", 9),
    (4, "", None, None, 0),
    (5, None, "en", None, None),
    (6, "  \t\n two  spaces <|endoftext|> here.\n\nend ", "de", "c", 1),
    (7, "word " * 30_000, "en", "a", 1),
    (8, "é　日本 'll don't \x1c x y", "fr", "c", 1),
    (8, "é　日本 'll don't \x1c x y", "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def words(t):
    return WORD.findall(t or "")


def collect(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_substring(rows, k=13):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring(odd):
    got = substring.repeated_substrings(odd)
    assert collect(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute_substring(ODD)
    three = got.filter("doc_id = 3").first()
    assert three.kept_text == "x y" and [(r["first"], r["last"]) for r in three.repeats] == [(1, 14)] and three.n_removed == 14


def test_jaccard(odd):
    def sets(t, k):
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(t)]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    for k, num in ((3, 90), (3, 50), (5, 80)):
        s = {d: sets(t, k) for d, t, *_ in ODD}
        root = {d: d for d in s}
        for _ in s:
            for a in s:
                for b in s:
                    if s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                        root[a] = root[b] = min(root[a], root[b])
        want = sorted(((d, len(s[d]), root[d]) for d, *_ in ODD), key=str)
        assert collect(jaccard.near_duplicates(odd, k, num, 100)) == want


def test_token_counts_and_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x, *_ in ODD}
    got = collect(token_counts.token_counts(odd, PATH))
    assert got == sorted(((d, len((x or "").encode()), len(ids[d]), len(ids[d]) > 1024) for d, x, *_ in ODD), key=str)
    rows = packing.pack(odd, PATH, size=256).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: 0 for d, *_ in ODD}) + Counter(d for d, *_ in ODD for _ in range(-(-(len(ids[d]) + 1) // 256)))
    by = {}
    for r in rows:
        full = ids[r.doc_id] + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_token_counts_and_ids_of_a_table(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}
    raw = [x.encode() for x in texts.values()]
    for memo in (packing.MEMO, 5):  # met words are forgotten again and again
        monkeypatch.setattr(packing, "MEMO", memo)
        encoder = packing._Ids(PATH)
        assert [x.tolist() for lo in range(0, len(raw), 50) for x in encoder.of_texts(raw[lo : lo + 50])] == list(ids.values())
    for common in (token_counts.COMMON, 50):  # few common pre-tokens, so that most are dealt
        monkeypatch.setattr(token_counts, "COMMON", common)
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
        assert got == {d: len(x) for d, x in ids.items()}


def thue_morse(n):
    """Two words of 2^n letters that a polynomial hash modulo 2^64 takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    one, two = thue_morse(11)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} a b"), (4, f"{one} a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r.n_removed for r in substring.repeated_substrings(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    assert [r.component_id for r in jaccard.near_duplicates(docs, 3, 90, 100).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    t = Tokenizer.from_file(PATH)
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()} == {d: len(x) for d, x in ids.items()}
    for r in packing.pack(docs, PATH, size=4096).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0], "<u4").tobytes())


def test_many_lengths_fill_a_sequence():
    plan = packing.packing_plan({n: 1 for n in range(1, 100)}, 8192)
    assert sum(times for _, times in plan) == 1


def test_words_of_texts():
    raw = ["", "a", " two\twords\x0b", "x" * 3_000_000 + " y", "é\u3000日本 z", "one two"]
    got = [h.tolist() for h in common.hashed_words([t.encode() for t in raw])]
    assert [len(h) for h in got] == [len(words(t)) for t in raw]
    by = {}
    for t, h in zip(raw, got):
        for w, x in zip(words(t), h):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    h = Counter(int(x) for x in rng.integers(1, 400, 3000))
    plan = packing.packing_plan(h, 512)
    used = Counter()
    for lengths, times in plan:
        assert sum(n * k for n, k in lengths.items()) <= 512
        for n, k in lengths.items():
            used[n] += k * times
    assert used == h
    assert sum(times for _, times in plan) <= 1.02 * -(-sum(n * k for n, k in h.items()) // 512)
    assert packing.packing_plan({}, 512) == []


def brute_quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(runs)
    inside = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_quality_measures_of_a_table(spark, odd):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for docs, rows in ((odd, [(r[0], r[1]) for r in ODD]), (spark.read.parquet(f"{DATA}/documents.parquet"), texts)):
        got = quality.measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert collect(got) == sorted(((d, *brute_quality(t)) for d, t in rows), key=str)


def test_quality(spark, odd):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.quality_rules(odd, labels).collect()
    assert len(got) == len(ODD)
    seven = next(r for r in got if r.doc_id == 7)
    assert seven.n_repeat_words == 30_000 and seven.base_failed and not seven.kept
    four = next(r for r in got if r.doc_id == 4)
    assert (four.n_words, four.word_chars, four.base_failed) == (0, 0, True)
    assert quality.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality.choose([(0, 0), (1, 50), (90, 60)], 1000, 100, 0.02, 0.05) == 1
    assert quality.choose([(0, 5)], 20, 10, 0.02, 0.05) is None  # too few to prove it


def test_quality_cutoffs_of_strata_with_few_labels(spark):
    # (words, characters of words, symbols, words in repeats): 350 good and 70 bad rows of each language have labels
    rows = [(f"{s}{i}", s, 100, 500 + i % 50, 40 + i if i % 6 == 0 else i % 4, 0, i % 5 // 4, False) for s in ("en", "de", "fr", None) for i in range(420)]
    others = [(f"x{r[0]}", *r[1:]) for r in rows if r[1] != "fr"]  # all rows of fr have labels
    measured = spark.createDataFrame(rows + others, "doc_id string, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(r[0], int(r[4] < 40)) for r in rows], "doc_id string, quality int")
    got = quality.verdicts(measured, quality.calibrate(measured, labels)).join(labels, "doc_id")
    share = {(r.stratum, r.quality): r.kept for r in got.groupBy("stratum", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share == {(s, q): float(q) for s in ("en", "de", "fr", None) for q in (0, 1)}
    bad, others = ({"a": [0, 4, 2] + [0] * 47, "b": [0, 0, 6] + [0] * 47}, {"a": [0, 9, 9] + [9] * 47, "b": [0, 0, 1] + [9] * 47})
    assert quality.chain(bad, others) == [{"b": 2}, {"b": 2, "a": 1}, {"b": 2, "a": 2}]


def brute_fingerprint(text):
    """Root, leaves and sections of the tree, digest by digest."""
    leaves = [",".join(format(xx64(c.encode()), "x") for c in re.split(r"(?<=[.,!?|;:] )", p)) for p in text.split("\n")]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sections = [[]]
    for i, p in enumerate(leaves):
        sections[-1].append(p)
        if xx64(p.encode()) % fingerprint.PARAGRAPHS == 0 and i + 1 < len(leaves):
            sections.append([])
    root = md5(";".join(md5("/".join(md5(p) for p in s)) for s in sections))
    return root + ":" + ";".join("/".join(s) for s in sections), {x for p in leaves for x in p.split(",")}, sections


def xx64(raw):
    import xxhash

    return xxhash.xxh64_intdigest(raw, seed=42)


def brute_apart(a, b):
    """How many different paragraphs of a lie in sections that b lacks, and not in sections that only b has."""
    one, two = ({tuple(s) for s in x[2]} for x in (a, b))
    return len({p for s in one - two for p in s} - {p for s in two - one for p in s}) if a[0].split(":")[0] != b[0].split(":")[0] else 0


def brute_fingerprints(rows):
    rows = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    like = lambda a, b: 1.0 if a[0].split(":")[0] == b[0].split(":")[0] else 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, new, other = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(nxt)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0].lower(), new[0].lower(), round(like(own, new), 9), round(like(own, other), 9), brute_apart(own, new), brute_apart(new, own)))
    return sorted(out, key=str)


def test_fingerprints(spark, odd, monkeypatch):
    def got(docs):
        return sorted(((*r[:5], round(r.near_edited, 9), round(r.near_next, 9), r.gone, r.new) for r in fingerprint.edited_fingerprints(docs).collect()), key=str)

    assert got(odd) == brute_fingerprints(ODD)  # the last is followed by the first, equal rows by each other
    far = [(i, f"text {i}. and\nmore, {i % 3}") for i in range(200)] + [(10**15, "far away"), (-(10**15), "before")]
    docs = spark.createDataFrame(far, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(fingerprint, "FAN", 20)
    assert got(docs) == brute_fingerprints(far)
    nulls = [(None, "no id. one"), (None, "a, no id"), *far]
    assert got(spark.createDataFrame(nulls, "doc_id long, text string").repartition(3)) == brute_fingerprints(nulls)  # the last is followed by the first null id
    ranged = fingerprint.with_next(docs, "text")
    assert ranged.count() == len(far)


def test_differing_paragraphs(spark):
    long = [f"line {i}, of many." for i in range(300)]
    put_in = [*long[:100], "a new one", *long[100:]]
    pairs = [("a\nb\nc", "a\nx\nc"), ("a", "a"), ("a", "a\nb"), ("\n".join(put_in), "\n".join(long)), ("\n".join(long), "\n".join(put_in))]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    both = df.select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    got = both.select(fingerprint.differing(F.col("a"), F.col("b")).alias("d"), F.size(fingerprint.apart(F.col("a"), F.col("b"))["sections"]).alias("s")).collect()
    assert [r.d for r in got] == [[1], [], [], [100], []]
    assert got[3].s <= 2 and got[4].s == 1  # a line that is put in changes the section around it alone


def brute_mixing(rows, block, shards, seed):
    """taken and draws of each row, by going through every block of every pass."""
    h = lambda d, t: hashlib.md5(f"{seed}|{d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    due = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    orders, left = [], []
    for i, (s, n_words) in enumerate(zip(names, sizes)):
        n = -(-n_words // block)
        orders.append([])
        for turn in range(3):
            k = mixing.keys(seed, i, turn, n)
            at = [mixing.place(j, n, f"{seed}|{i}", turn, k) for j in range(n)]
            assert sorted(at) == list(range(n))
            orders[i] += [(turn, j) for j in np.argsort(at).tolist()]
        left.append(min(round(due[i]), 3 * n_words))
    drawn = []
    for i, n_words in enumerate(sizes):
        todo, here = left[i], []
        for turn, j in orders[i]:
            if todo <= 0:
                break
            take = min(todo, block, n_words - j * block)
            here.append((turn, j, take))
            todo -= take
        assert todo == 0
        drawn.append(here)
    quotas = mixing.split_quotas([len(x) for x in drawn], shards, seed)
    out = []
    for i, s in enumerate(names):
        at = 0
        bounds = np.cumsum(quotas[:, i])
        for d, t, *_ in sorted((r for r in rows if r[3] == s), key=lambda r: h(r[0], r[1])):
            n, draws = len(words(t)), []
            for place, (turn, j, take) in enumerate(drawn[i]):
                lo, hi = max(at, j * block), min(at + n, j * block + take)
                if lo < hi:
                    draws.append((turn, lo - at, hi - lo, int(np.searchsorted(bounds, place, side="right"))))
            out.append((d, n, sizes[i], due[i], sum(x[2] for x in draws), sorted(draws)))
            at += n
    return sorted(out, key=str)


def test_mixing(spark, odd):
    seen = []
    for seed in (1, 2):
        got = mixing.mixture(odd, block_words=4, shards=3, seed=seed).collect()
        have = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken, sorted((x["pass"], x["first"], x.words, x.shard) for x in r.draws)) for r in got), key=str)
        assert have == brute_mixing(ODD, 4, 3, seed)
        seen.append(have)
    assert seen[0] != seen[1]
    sums = Counter()
    for _, _, _, target, taken, _ in seen[0]:
        sums[target] += taken
    assert all(abs(n - target) <= 1 for target, n in sums.items())
    assert mixing.targets([10, 1], [1, 1]) == [8.0, 3.0]
    q = mixing.split_quotas([7, 100, 3], 5, 1)
    assert q.sum(0).tolist() == [7, 100, 3] and q.sum(1).max() - q.sum(1).min() <= 1
    assert mixing.block_size(10_000, 64) == 64
    n = mixing.block_size(20 * 10**12, 64)  # a mix of 20 million million words still splits by exact draws
    q = mixing.split_quotas([-(-(w * 10**12) // n) for w in (15, 4, 1)], 4, 1)
    assert q.sum() * n >= 20 * 10**12 and q.sum(1).max() - q.sum(1).min() <= 1


def test_drawn_texts_are_the_draws(spark, odd):
    mixed = mixing.mixture(odd, block_words=4, shards=3)
    texts = mixing.drawn_texts(odd, mixed).select("text").collect()
    by = {d: words(t) for d, t, *_ in ODD}
    want = Counter(w for r in mixed.collect() for x in r.draws for w in by[r.doc_id][x["first"] : x["first"] + x.words])
    assert Counter(w for r in texts for w in words(r.text)) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_mixing_of_a_table(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = mixing.query(spark, DATA).collect()
    have = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, sorted((x["pass"], x["first"], x.words, x.shard) for x in r.draws)) for r in got]
    want = [(*r[:3], round(r[3], 6), *r[4:]) for r in brute_mixing(rows, mixing.BLOCK_WORDS, mixing.SHARDS, 1)]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu {0}</nav><div class='ad'>buy</div><article><h1>H &amp; {0}</h1><p>one {0}\n two<br>x{0}<p>three {0}</p><script>var a='</p>';</script></article><div class=comments>hi</div><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/a", page.format(i)) for i in range(5)] + [(9, None, None), (10, "u", ""), (11, "http://h.example/b", "<p>cut <b>off")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "H & 3\none 3 two x3\nthree 3" and got[3].n_chars == len(got[3].text)
    assert got[9].text == got[10].text == "" and got[11].text == "cut off"


def test_html_as_browsers_read_it():
    text = lambda body: html.main_text(body, set(), None)
    assert text("<article><p title=it's>First words here</p><p>I don't know</p></article>") == "First words here\nI don't know"
    assert text("<article><p title = 'a > b' data-x=\"it's\" hidden>One</p><a href=x?a='b'>two</a></article>") == "One\ntwo"
    assert text('<article><p class="x>One</p></article>') == "One"  # a quote that nothing closes
    assert text("<article><p>one<hr>two</p></article>") == "one\ntwo"
    assert text("<article><p>foo<wbr>bar <img src=x>b<img alt='>'>az a<br>b</p></article>") == "foobar baz a b"
    kept = '<article><div class="share-price">4 pounds</div><section id="search-methods">By hand</section><div class="related work">Much</div></article>'
    assert text(kept.replace("related work", "work-related-injuries")) == "4 pounds\nBy hand\nMuch"
    for name in ("share-buttons", "social share", "comments", "comment-list-12", "ad_slot_3", "site-footer", "related-posts"):
        assert text(f'<article><p>Kept</p><div class="{name}">Gone</div></article>') == "Kept", name


def test_html_template_without_names(spark):
    # no article element and no telling names: only the occurrence vectors part template and content
    def page(i):
        note = "<div><b>we use crumbs</b> fine</div>" if i % 3 else ""  # on two thirds of the pages, with its element
        said = "<p>as ever</p>" if i % 4 else ""  # content that three quarters of the pages happen to have
        return f"<body><div><span>start</span> here</div>{note}<section><h1>title {i}</h1>{said}" + "".join(f"<p>words {i} {j}</p>" for j in range(2 + i % 5)) + "<div>all rights kept</div></section><table><tr><td>last part</td></tr></table></body>"

    rows = [(i, "http://a.example/x", page(i)) for i in range(24)] + [(99, "http://a.example/y", "<body><p>of another make</p></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(24):
        assert got[i] == "\n".join([f"title {i}", *(["as ever"] if i % 4 else []), *(f"words {i} {j}" for j in range(2 + i % 5))])
    assert got[99] == "of another make"
    found = html.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    text = lambda value, place: html._hash("text", value, place)
    assert found.slot == "body>section"
    # brute force: texts with the vector of a tag around them, on half of the pages or more
    vectors, held = {}, {}
    for i, _, h in rows:
        for (token, tag, place), (n, _, _) in html.page_tokens(h).items():
            vectors.setdefault((token, tag, place), {})[i] = n
    for (token, tag, place), v in vectors.items():
        if not tag and 2 * len(v) >= len(rows) and any(t and v == w and html._within(place, q) for (_, t, q), w in vectors.items()):
            held[token] = place
    assert set(found.constants) == set(held) and text("all rights kept", "body>section>div") in held and text("as ever", "body>section>p") not in held


def test_models_on_small_samples(spark, odd):
    rng = np.random.default_rng(0)
    pick = lambda vocab: " ".join(rng.choice(vocab, 40))
    base = [f"w{i}" for i in range(60)]
    rows = [(pick(base) + (" vile rotten " if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    field = toxicity.fit([(t.encode(), y) for t, y in rows])
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, field).collect()}
    assert np.mean([(got[i].score >= 0.5) == y for i, (_, y) in enumerate(rows)]) > 0.95
    hit = got[0]
    assert [rows[0][0][s.start : s.end] for s in hit.spans] == ["vile rotten"]
    assert toxicity.toxic_scores(odd, field).count() == len(ODD)
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20
    model = language.fit(train, np.ones(language.BUCKETS))
    said = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert said[4].lang_pred == said[5].lang_pred == "und" and said[1].lang_pred in ("en", "de")


def test_toxicity_documents_are_whole_chains():
    rng = np.random.default_rng(0)
    sizes, transition = np.array([0, 200, 1, 64, 0, 129, 65, 7]), np.array([[1.0, -1.0], [-0.5, 2.0]])
    e = rng.normal(0, 1, sizes.sum())
    forward, backward = toxicity.marginal_odds(e, transition, sizes)
    got, at = forward * backward / (1 + forward * backward), 0
    for n in sizes:
        own, t = np.stack([np.ones(n), np.exp(e[at : at + n])], 1), np.exp(transition)
        alpha, beta = own.copy(), np.ones((n, 2))
        for i in range(1, n):
            alpha[i] = own[i] * (alpha[i - 1] @ t) / alpha[i - 1].sum()
        for i in range(n - 2, -1, -1):
            beta[i] = t @ (own[i + 1] * beta[i + 1])
            beta[i] /= beta[i].sum()
        p = alpha * beta
        assert got[at : at + n] == pytest.approx(p[:, 1] / p.sum(1))
        at += n


def test_toxicity_scores_keep_the_share_of_toxic_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(30)], 20)), int(i % 10 == 0)) for i in range(1000)]  # words tell nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), max_docs=200)
    assert toxicity.toxic_scores(docs, field).agg(F.avg("score")).first()[0] < 0.2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are missing")
def test_held_out_labels_and_languages(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.query(spark, d).filter("held_out").join(labels.filter("toxic is not null"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    clean = counts.get((0, 0), 0) + counts.get((0, 1), 0)
    assert counts.get((1, 1), 0) >= 4 and counts.get((0, 1), 0) <= 0.08 * clean  # few labels are there to learn from
    got = language.query(spark, d).filter("held_out").join(docs.filter("lang is not null").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog in the house", "en") for i in range(3000)] + [(9000 + i, "der hund und die katze im haus", "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, max_docs=60)
    assert model.langs == ["de", "en"]
    assert language.identify(docs.filter("lang = 'de'"), model).select("lang_pred").distinct().collect() == [("de",)]


def test_samples_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 90, "en")] * 50 + [(2, "y" * 900, "en"), (3, "z", "en")], "doc_id long, text string, lang string")
    assert common.sample(docs, 10, "s", "text").count() == 10  # rows of an id that repeats count each
    assert common.sample(docs, 100, "s", "text", max_bytes=100).filter("doc_id = 2").count() == 0
    monkeypatch.setattr(common, "SAMPLE_TOTAL", 500)
    assert common.sample(docs, 100, "s", "text").agg(F.sum(F.length("text"))).first()[0] <= 500


def test_long_texts_leave_every_class_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_TOTAL", 4000)
    rows = [(f"{i:04d}", "rare" if i % 10 == 0 else "often", "x" * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "h string, kind string, text string")
    left = Counter(r.kind for r in common.bounded(df, 150, "h", group="kind").collect())
    assert left == {"rare": 4, "often": 36}
    docs = [(i, ("straße und häuser " if i % 10 == 0 else "the cat and dog ") * 3 + "y" * 40, "de" if i % 10 == 0 else "en") for i in range(200)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(model.langs) == ["de", "en"]


def test_null_ids(spark):
    import corpus_pipeline

    rows = [*ODD[:4], (None, ODD[0][1], "en", "a", 9), (None, "Only this text has no id", "en", "a", 9), (None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    alone = lambda df: collect(df.filter("doc_id is null"))
    assert alone(jaccard.near_duplicates(docs)) == sorted([(None, 10, None), (None, 2, None), (None, 0, None)], key=str)
    got = substring.repeated_substrings(docs)
    assert alone(got.select("doc_id", "n_words", "n_removed")) == sorted([(None, 14, 0), (None, 6, 0), (None, 0, 0)], key=str)
    assert collect(got.filter("doc_id is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute_substring(ODD[:4])
    assert [r[2] > 0 for r in alone(token_counts.token_counts(docs, PATH))] == [r[1] > 0 for r in alone(token_counts.token_counts(docs, PATH))]
    again = spark.createDataFrame([(1, "one", None, None, 0), (1, "one two three four", None, None, 0)], SCHEMA)  # each row has its own count
    assert sorted(r.n_tokens for r in token_counts.token_counts(again, PATH).collect()) == [1, 4]
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").filter("doc_id is null").count() == 3
    assert corpus_pipeline.cut_repeats(spark, docs, "").filter("doc_id is null").count() == 3
    mixed = mixing.mixture(docs)
    texts = corpus_pipeline.mix_sources(spark, docs, "")
    assert texts.select(F.sum(F.size(F.split("text", " +")))).first()[0] == mixed.select(F.sum("taken")).first()[0]


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, lang, s, None if t is None else len(t), 0.9, 5, "k") for d, t, lang, s, _ in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, kept_text string")
    labels = spark.createDataFrame([(d, 1, 0) for d in range(1, 8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept = got.collect()
        assert {(r.score, r.n_words, r.kept_text) for r in kept} == {(0.9, 5, "k")}, name  # whatever they are called
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
        ids = Counter(r.doc_id for r in kept)
        if name == "toxicity":
            assert ids == Counter(r[0] for r in rows)  # nothing toxic is known
        if name == "near_duplicates":
            assert ids == Counter([1, 4, 5, 6, 7, 8, 8])  # 2 and 3 are like 1
        if name == "substring_dedup":
            assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8} and next(r.text for r in kept if r.doc_id == 3).split() == ["x", "y"]
        if name == "mixing":
            assert not ids.keys() & {4, 5}
        docs_next = stage(spark, docs.unionByName(docs), str(tmp_path))
        assert docs_next.columns == docs.columns
    assert corpus_pipeline.pack_sequences(spark, docs, "").select("doc_id").distinct().count() == 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring.repeated_substrings(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert token_counts.token_counts(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert quality.quality_rules(none, labels).count() == 0
    assert fingerprint.edited_fingerprints(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert toxicity.toxic_scores(none, toxicity.train(none, labels)).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
@pytest.mark.parametrize("name", ["op5_substring", "op9_jaccard"])
def test_matches_sql(spark, name):
    import duckdb

    from farsight.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    c = sorted(want.columns)
    assert sorted(map(str, got[c].itertuples(index=False, name=None))) == sorted(map(str, want[c].itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are missing")
def test_pipeline(spark):
    import corpus_pipeline

    folder = common.shared_folder(spark).removeprefix("file:")
    tables = lambda: sorted(os.listdir(f"{folder}/farsight")) if os.path.isdir(f"{folder}/farsight") else []
    before = tables()
    rows = corpus_pipeline.run(spark, DATA).toPandas()
    assert tables() == before and len([x for x in os.listdir(f"{folder}/pipeline")]) == 1  # only the last stage's rows are left
    assert len(rows) and rows.length.max() <= 2048 and set(rows.columns) >= {"doc_id", "sequence_id", "offset"}


def test_pieces_go_back_in_a_row_for_each_block(monkeypatch):
    words = [f" word{i}" for i in range(300)]
    rows = [(b, w, 3 * i + b) for i, w in enumerate(words) for b in (5, 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[lo : lo + 70]], t) for j, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int32()))], ["block", "part", "code"]) for lo in range(0, 600, 70)]
    want = {(b, c): len(token_counts.tokenizer(PATH)[0].encode(w, add_special_tokens=False).ids) for b, w, c in rows}
    for gathered, least in ((token_counts.GATHERED, 2), (140, 2 * 5)):
        monkeypatch.setattr(token_counts, "GATHERED", gathered)
        found = [r for out in token_counts._counted(iter(batches), PATH) for r in out.to_pylist()]
        assert len(found) == least
        got = {}
        for r in found:
            steps, pieces = token_counts._unpacked(r["pieces"]).reshape(2, -1)
            got |= {(r["block"], int(c)): int(n) for c, n in zip(steps.cumsum(), pieces, strict=True)}
        assert got == want


def test_stages_leave_little_in_the_workers(spark, monkeypatch):
    rows = [(1, "a vile b vile", "x"), (2, "a b", None), (None, None, "x"), (1, "a vile b vile", "x"), (3, "", "y")]
    docs = spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "text", "source"]))
    field = toxicity.fit([(b"a vile b", 1), (b"a b c", 0)] * 20)
    monkeypatch.setattr(toxicity, "ROWS", 2)
    want = toxicity.toxic_scores(docs, field).filter("score < 0.5").select(*docs.columns)
    got = docs.filter(toxicity.toxic_score("text", field) < 0.5)
    assert Counter(got.collect()) == Counter(want.collect()) and 0 < got.count() < 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan  # rows stay in the JVM
    assert "PythonRDD" not in mixing.mixture(docs)._jdf.queryExecution().toRdd().toDebugString()
    monkeypatch.setattr(packing, "ROWS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["a b", None, "c", "", "d e"])], ["doc_id", "text"])
    parts = list(packing._pieces(iter([batch]), PATH, 256, 0))
    assert [p.column("doc_id").to_pylist() for p in parts] == [[1, 2], [3, 4], [5]]


def test_sketches_bound_the_likeness():
    """No pair over the threshold is turned away, whatever the widths of the sketches; unlike sets are."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (30, 100)):
        sets = [np.zeros(0, np.uint64)]
        for size in (1, 3, 40, 63, 64, 65, 127, 130, 500, 1030, 70_000):
            base = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
            for share in (0, 0.04, 0.1, 0.3, 0.7):
                changed = base.copy()
                changed[: int(share * size)] = rng.integers(0, 1 << 63, int(share * size), np.int64).astype(np.uint64)
                sets += [np.unique(changed), np.unique(changed[: size - int(share * size) or size])]
        found = jaccard._Sketches([len(s) for s in sets], [jaccard.sketch(s) for s in sets], num, den)
        far = turned = 0
        for s in sets:
            near = set(found.near(len(s), jaccard.sketch(s)).tolist())
            for i, other in enumerate(sets):
                both = len(np.intersect1d(s, other))
                if both and den * both >= num * (len(s) + len(other) - both):
                    assert i in near
                elif not both and min(len(s), len(other)) >= 100 and len(s) < 2000 and num >= 80:
                    far, turned = far + 1, turned + (i not in near)
        assert turned == far and (far > 0) == (num >= 80)


def test_only_texts_with_a_possible_partner_meet(spark, monkeypatch):
    """Texts that share a passage, but are not alike, are told apart by their sketches, in both rounds; few texts are shuffled."""
    passage = " ".join(f"shared{i}" for i in range(30))
    own = lambda d, n=300: " ".join(f"own{d}x{i}" for i in range(n))
    rows = [(d, f"{passage} {own(d)}") for d in range(400)] + [(1000, own("a")), (1001, own("a") + " end"), (1002, None), (1003, "")]
    rows += [(2000 + d, f"{own('b')} {own(d, 5)}") for d in range(40)]
    docs, sent = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    real = jaccard._opened

    def opened(docs, places, *rest):
        sent.extend(r[0] for r in places.select("doc_id").distinct().collect())
        return real(docs, places, *rest)

    monkeypatch.setattr(jaccard, "_opened", opened)
    got = {r[0]: r[2] for r in jaccard.near_duplicates(docs, words=3, num=90, den=100).collect()}
    assert got == {d: 1000 if d == 1001 else 2000 if d >= 2000 else d for d, _ in rows}
    assert set(sent) <= {1000, 1001, *range(2000, 2040)} and {1000, 1001} <= set(sent)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, bits):
    """What surely isn't among some ids is told where it is read; ids that share a bit are told by the join that follows."""
    monkeypatch.setattr(common, "ID_BITS", bits)
    rows = spark.createDataFrame([(d, f"text {d}", d) for d in [*range(500), 7, 7, -1, None, None]], "doc_id int, text string, `a.b` int")
    ids = spark.createDataFrame([(7,), (-1,), (10_000,)], "doc_id long")
    maybe, others = common.parted(rows, ids)
    assert maybe.columns == others.columns == rows.columns
    first, rest = maybe.collect(), others.collect()
    assert sorted(map(str, first + rest)) == sorted(map(str, rows.collect()))
    assert {7, -1} <= {r[0] for r in first} and not {7, -1} & {r[0] for r in rest} and len(first) < (100 if bits == 64 else 8)
    assert not re.search(r"Exchange (hash|range|Round)", others._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "substring_dedup", "packing"])
def test_stages_send_small_batches_to_workers(spark, stage):
    import corpus_pipeline

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat(id, ' word '), 500) as text", "'en' as lang", "'a' as source", "0L as n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(20), DATA)  # its last rows are made later
        found = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
    finally:
        spark.conf.set(conf, before)
    assert sum(found) > 14e6 and max(found) < 6e6


def test_small_batches_are_merged_as_one():
    texts = [" ".join(f"w{(i % 4) * 20 + j}" for j in range(40)) for i in range(12)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    small = [whole.slice(i, 3) for i in range(0, 12, 3)]
    levels = type("Held", (), {"value": bytes(jaccard.SLOTS)})
    for work in (lambda it: substring._anchors(it, 13), lambda it: jaccard._prefixes(it, 5, 80, 100, levels), lambda it: (b for b in jaccard._keys(it, 5) if b.column("doc_id").null_count)):
        one, many = (pa.Table.from_batches(work(iter(x))).combine_chunks() for x in ([whole], small))
        assert one.num_rows and many.equals(one)


def test_batches_are_taken_together_up_to_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64())], ["x"])
    counts = lambda n, **most: [sum(b.num_rows for b in g) for g in common.together([batch] * n, **most)]
    assert counts(7, rows=25) == [30, 30, 10] and counts(5, most=160) == [20, 20, 10] and counts(0) == []
