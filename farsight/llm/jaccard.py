"""N-gram Jaccard join through a token-group matrix.

Equal shingle sets are collapsed, within a batch before their tokens are dealt and over all batches before they are grouped. Each different set
gives the leading part of its tokens in one global order (common tokens last): two sets whose Jaccard index reaches the threshold share
SHARED tokens of these parts, or all that they must share. Similar sets are dealt into groups of bounded size by the token that they share with most others.

A set has a sketch, the parity of how many of its tokens fall into each of about as many slots. Sketches of two sets differ in
no more slots than the sets in tokens, which bounds the Jaccard index from above. Wherever texts would meet, their
sketches meet first, and only texts with a partner that the bound allows are sent there.

First each group is opened for its own members: what links them makes preliminary components. Parts of one crowd
have a few members in common, so that thousands of near copies are one component after this round.
Then the matrix holds (token, group) for the union of each group's leading tokens, without tokens that only one component has, and with the
range of set sizes. It bounds the overlap of every two groups; only groups that can link over the bound are opened, for the members of the other
as queries. A query whose overlap with an opened group's union of whole tokens can't reach the threshold is turned away, the
others are compared exactly. Links that join what is not joined yet are kept, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farsight.llm.common import documents, grams, lists, merged, parted, runs, shared_folder, signed, texts, tidy, together, words_of, written
from farsight.llm.components import components

#: Slots of the table of common tokens (one byte each on every executor), whatever the size of the input.
SLOTS = 1 << 22
#: Documents of one batch that share a token before the batch reports it as common; least sum that makes it so.
LOCAL_COMMON, COMMON = 2, 3
#: Tokens of its leading part that a set must share with another's, or all that it must share if those are fewer.
SHARED = 3
#: Members and tokens that a group has on average at most; larger groups are dealt into several.
GROUP, GROUP_TOKENS = 256, 1 << 18
#: Slots of a sketch at least and at most; a larger set's sketch bounds less, which costs texts, not links.
LEAST_BITS, MOST_BITS = 1 << 6, 1 << 16
#: Groups whose members visit an opened group together.
VISITORS = 16


def shingle_sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of the whole sequence if it has fewer words."""
    for a, b in runs([len(t) for t in raw]):
        words = words_of([t.lower() for t in raw[a:b]])  # bytes: A-Z only
        ids, first = words.hashes(), words.first()
        every = grams(ids, k)
        for lo, n in zip(first.tolist(), words.sizes.tolist(), strict=False):
            if not n:
                yield np.zeros(0, np.uint64)
            else:
                yield np.unique(every[lo : lo + n - k + 1] if n >= k else grams(ids[lo : lo + n], n, seed=n))


def _keys(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (token, number of documents) for what is common in a batch."""
    names = ["doc_id", "n_shingles", "h1", "h2", "token", "n"]
    for group in together(batches):
        different: dict[bytes, np.ndarray] = {}
        for batch in group:
            digests, sizes = [], []
            for s in shingle_sets(texts(batch), k):
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                different.setdefault(digests[-1], s)
            one, two = (pa.array([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests], pa.int64()) for i in (0, 8))
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), one, two, none, none], names)
        every = np.concatenate([np.zeros(0, np.uint64), *different.values()])
        different.clear()
        every.sort()  # in place: most tokens are there once
        tokens, counts = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        often = counts + 1 >= LOCAL_COMMON
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [signed(tokens[often]), pa.array(counts[often].astype(np.int64) + 1)], names)


def _leading(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens of which two sets over the threshold share as many as SHARED (or all they must share): n - ceil(t n) + SHARED, common ones last."""
    n = len(s)
    level = levels[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    order = np.argsort((level << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
    return s[order[: n - -(-n * num // den) + SHARED]]


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, levels) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, others): a batch's documents by leading token; of equal sets the one with the smallest id. Rows without a token have its n and sketch."""
    names = ["token", "doc_id", "others", "n", "sketch"]
    table = np.frombuffer(levels.value, np.uint8)
    for group in together(batches):
        firsts: dict[bytes, tuple[int, np.ndarray, int, bytes]] = {}
        for doc, s in (x for batch in group for x in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts(batch), k), strict=True)):
            digest = xxhash.xxh3_128_digest(s.tobytes())
            known = firsts.get(digest)
            if known is None:
                firsts[digest] = doc, _leading(s, table, num, den), len(s), sketch(s)
            elif doc < known[0]:
                firsts[digest] = doc, *known[1:]
        none = pa.nulls(len(firsts), pa.int64())
        own = [pa.array([x[i] for x in firsts.values()], t) for i, t in ((0, pa.int64()), (2, pa.int64()), (3, pa.binary()))]
        yield pa.RecordBatch.from_arrays([none, own[0], pa.nulls(len(firsts), pa.list_(pa.int64())), *own[1:]], names)
        ids = [np.full(len(lead), doc, np.int64) for doc, lead, *_ in firsts.values()]
        token, doc_id = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in firsts.values())]), np.concatenate([np.zeros(0, np.int64), *ids])
        (token,), (doc_id,), more, (others,) = merged([token], [doc_id])
        none = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([signed(token), pa.array(doc_id), lists(more, pa.array(others)), none, pa.nulls(len(token), pa.binary())], names)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of tokens in each slot: the power of two from len(s) on, within LEAST_BITS and MOST_BITS."""
    slots = min(max(1 << max(len(s) - 1, 0).bit_length(), LEAST_BITS), MOST_BITS)
    return np.packbits(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as of sketches with fewer slots."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class _Sketches:
    """Sketches of a group's members, by width."""

    def __init__(self, sizes: list[int], sketches: list[bytes], num: int, den: int):
        self.num, self.den = num, den
        widths = np.array([len(x) // 8 for x in sketches], np.int64)
        self.by = []
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            rows = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), width)
            self.by.append((at, np.array([sizes[i] for i in at.tolist()], np.int64), rows))

    def near(self, size: int, own: bytes) -> np.ndarray:
        """Members that a set of this size and sketch may link with."""
        row, found = np.frombuffer(own, np.uint64)[None, :], []
        for at, sizes, rows in self.by:
            apart = np.abs(sizes - size) * (self.den + self.num) <= (sizes + size) * (self.den - self.num)
            at, sizes, rows = at[apart], sizes[apart], rows[apart]
            if len(at):
                width = min(rows.shape[1], row.shape[1])
                differ = np.bitwise_count(_folded(rows, width) ^ _folded(row, width)).sum(1, dtype=np.int64)
                found.append(at[differ * (self.den + self.num) <= (sizes + size) * (self.den - self.num)])
        return np.concatenate([np.zeros(0, np.int64), *found])


def _hopeful(batches: Iterator[pa.RecordBatch], num: int, den: int, among: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group, members before guests, those with a partner that sketches allow: members among themselves, or guests and members of other components."""
    names = ["g", "c", "part", "guest", "doc_id", "component"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    key, last, members, found, hopes, kept = None, None, [], None, set(), []

    def close() -> None:
        if among and len(members) > 1:
            found = _Sketches([m[-2] for m in members], [m[-1] for m in members], num, den)
            hopes.update(i for i, m in enumerate(members) if len(found.near(m[-2], m[-1])) > 1)
        kept.extend((*key, False, *members[i][:2]) for i in sorted(hopes))

    for batch in batches:
        for *place, guest, doc, component, size, own in zip(*(batch.column(n).to_pylist() for n in [*names, "n", "sketch"]), strict=True):
            if place != key:
                if key is not None:
                    close()
                key, last, members, found, hopes = place, None, [], None, set()
            if (guest, doc) == last:  # a row that repeats an id
                continue
            last = guest, doc
            if not guest:
                members.append((doc, component, size, own))
                continue
            found = found or _Sketches([m[-2] for m in members], [m[-1] for m in members], num, den)
            partners = [i for i in found.near(size, own).tolist() if members[i][1] != component]
            if partners:
                hopes.update(partners)
                kept.append((*place, True, doc, component))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], t) for i, t in enumerate(types)], names)
        kept.clear()
    if key is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], t) for i, t in enumerate(types)], names)


class _Group:
    """An open group: its members' tokens by token."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.docs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.of: list[int] = []  # each member's preliminary component
        self.components: set[int] = set()
        self.met: set[tuple[int, int]] = set()  # components that a visit has linked
        self.members = None

    def index(self, members: np.ndarray) -> None:
        self.members = members
        sets = [self.sets[i] for i in members.tolist()]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Indexed members whose Jaccard index with s reaches the threshold."""
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        at = at[self.tokens[at] == s]
        if len(at) * self.den < self.num * len(s):  # the bound by the group's union
            return np.zeros(0, np.int64)
        counts = self.count[at]
        flat = np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        both = np.bincount(self.owner[flat], minlength=len(self.sizes))
        return self.members[both * self.den >= self.num * (self.sizes + len(s) - both)]

    def joined(self) -> list[tuple[int, int]]:
        """Links to the least of those that are linked among the members, who come by id. Whoever is reached is not searched for again."""
        left = np.arange(len(self.sets))
        links = []
        while len(left) > 1:
            start, left = int(left[0]), left[1:]
            queue, reached = [start], [start]
            while queue and len(left):
                if self.members is None or 2 * len(left) < len(self.members):
                    self.index(left)
                found = np.intersect1d(self.linked(self.sets[queue.pop()]), left, assume_unique=True)
                left = np.setdiff1d(left, found, assume_unique=True)
                reached += found.tolist()
                queue += found.tolist()
            links += [(self.docs[reached[0]], self.docs[i]) for i in reached[1:]]
        return links

    def visit(self, doc: int, component: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Links of a guest with members of components that its own isn't linked with yet."""
        if not self.sets or self.components == {component}:
            return []
        if self.members is None:
            self.index(np.arange(len(self.sets)))
        links = []
        for j in self.linked(s).tolist():
            pair = component, self.of[j]
            if pair[0] != pair[1] and pair not in self.met:
                self.met |= {pair, pair[::-1]}
                links.append((doc, self.docs[j]))
        return links


def _open(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, members before guests; only the members are held. Links among the members, or where guests come, of guests with members."""
    names, key, group = ["g", "c", "part", "guest", "doc_id", "component"], None, _Group(num, den)
    visited = False

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for batch in batches:
        links: list[tuple[int, int]] = []
        for (*place, guest, doc, component), s in zip(zip(*(batch.column(n).to_pylist() for n in names), strict=True), shingle_sets(texts(batch), k), strict=True):
            if place != key:
                if not visited:
                    links += group.joined()
                key, group, visited = place, _Group(num, den), False
            if not guest:
                group.docs.append(doc)
                group.sets.append(s)
                group.of.append(component)
                group.components.add(component)
            else:
                visited = True
                links += group.visit(doc, component, s)
        yield out(links)
    if not visited:
        yield out(group.joined())


def _opened(docs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): the links that open groups give; rows(doc_id, g, c, part, guest, component) say who comes where. Texts without a place don't enter a shuffle."""
    places = written(rows.groupBy("doc_id").agg(F.collect_list(F.struct("g", "c", "part", "guest", "component")).alias("places")))
    shipped = parted(docs, places)[0].join(places, "doc_id").select("doc_id", "text", F.explode("places").alias("x")).select("x.*", "doc_id", "text")
    return shipped.repartition("g", "c", "part").sortWithinPartitions("g", "c", "part", "guest", "doc_id").mapInArrow(tidy(lambda it: _open(it, k, num, den)), "a long, b long")


def _levels(docs: DataFrame, common: DataFrame):
    """Broadcast table of how common tokens are, by slot: the logarithm of their number of documents."""
    slots = (
        common.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
        .select(F.expr(f"cast(token & {SLOTS - 1} as int)").alias("slot"), F.floor(F.log2("n")).cast("int").alias("level"))
        .groupBy("slot")
        .agg(F.max("level").alias("level"))
        .toArrow()  # SLOTS rows at most
    )
    levels = np.zeros(SLOTS, np.uint8)
    levels[slots.column("slot").to_numpy()] = slots.column("level").to_numpy()
    return docs.sparkSession.sparkContext.broadcast(levels.tobytes())


def joined(docs: DataFrame, sets: DataFrame, common: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, component) of those among sets(doc_id, n), whose shingle sets all differ, that are linked to another.

    common(token, n) sets the order of tokens; any content gives the same result."""
    held = _levels(docs, common)
    leading = written(docs.mapInArrow(tidy(lambda it: _prefixes(it, k, num, den, held)), "token long, doc_id long, others array<long>, n long, sketch binary"))
    sketches = leading.filter("token is null").select("doc_id", "n", "sketch")
    leading = leading.filter("token is not null").select("token", "doc_id", "others")
    rows = F.lit(1) + F.coalesce(F.size("others"), F.lit(0))
    met = leading.withColumn("docs", F.sum(rows).over(Window.partitionBy("token"))).filter("docs > 1")  # one exchange for the sums and their rows
    every = F.array_append(F.coalesce("others", F.array().cast("array<long>")), F.col("doc_id"))
    met = written(met.select("token", F.explode(every).alias("doc_id")).join(sets, "doc_id"))
    shared = met.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    leads = written(met.join(shared, "token"))

    needed = lambda n: F.least(F.lit(SHARED), F.ceil(n * num / den))
    home = leads.groupBy("doc_id").agg(F.max_by("token", F.struct("df", "token")).alias("g"), F.first("n").alias("n"), F.count("*").alias("tokens")).filter(F.col("tokens") >= needed(F.col("n")))
    parts = F.greatest(F.ceil(F.count("*") / F.lit(GROUP)), F.ceil(F.sum("n") / F.lit(GROUP_TOKENS))).cast("int")
    some = F.array_distinct(F.array(F.min("doc_id"), F.max("doc_id"), F.min_by("doc_id", F.xxhash64("doc_id"))))
    crowds = home.groupBy("g").agg(parts.alias("parts"), some.alias("some"), F.count("*").alias("members"))
    home = written(home.join(crowds.select("g", "parts", "members"), "g").select("doc_id", "n", "g", "members", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("c")))
    everywhere = crowds.filter("parts > 1").select("g", F.explode("some").alias("doc_id"), F.expr("sequence(0, parts - 1)").alias("c")).withColumn("c", F.explode("c"))
    place = [F.lit(0).alias("part"), F.lit(False).alias("guest"), F.lit(0).cast("long").alias("component")]
    first = home.filter("members > 1").select("doc_id", "g", "c").union(everywhere.select("doc_id", "g", "c")).distinct().select("*", *place)

    def hopeful(rows: DataFrame, among: bool) -> DataFrame:
        dealt = rows.join(sketches, "doc_id").repartition("g", "c", "part").sortWithinPartitions("g", "c", "part", "guest", "doc_id")
        return dealt.mapInArrow(tidy(lambda it: _hopeful(it, num, den, among)), "g long, c int, part int, guest boolean, doc_id long, component long")

    found = written(components(_opened(docs, hopeful(first, True), k, num, den), "a", "b"))

    owned = leads.join(home.drop("n", "members"), "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    owned = written(owned.select("token", "doc_id", "n", "g", "c", "component"))
    apart = owned.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    owned = written(owned.join(apart, "token"))
    able = owned.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.first("n").alias("n")).filter(F.col("tokens") >= needed(F.col("n"))).select("doc_id")
    owned = owned.join(able, "doc_id")
    matrix = owned.groupBy("token", "g", "c").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    matrix = written(matrix)
    one, two = (matrix.select("token", *(F.col(x).alias(f"{x}{i}") for x in ("g", "c", "least", "most", "lo", "hi"))) for i in (1, 2))
    pairs = written(
        one.join(two, "token")
        .filter("g1 < g2 or (g1 = g2 and c1 < c2)")
        .filter((F.col("least1") * num <= F.col("most2") * den) & (F.col("least2") * num <= F.col("most1") * den) & (F.least("lo1", "lo2") < F.greatest("hi1", "hi2")))
        .groupBy("g1", "c1", "g2", "c2")
        .agg(F.count("*").alias("shared"), F.min(F.least("least1", "least2")).alias("n"))
        .filter(F.col("shared") >= needed(F.col("n")))
        .select("g1", "c1", "g2", "c2")
    )
    members = owned.select("doc_id", "g", "c", "component").distinct()
    hosts = pairs.groupBy("g2", "c2").agg(F.ceil(F.count("*") / F.lit(VISITORS)).cast("int").alias("parts"))
    inside = hosts.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).join(members, F.expr("g = g2 and c = c2")).select("doc_id", "g", "c", "part", F.lit(False).alias("guest"), "component")
    visits = pairs.join(hosts, ["g2", "c2"]).withColumn("part", F.pmod(F.xxhash64("g1", "c1"), F.col("parts")).cast("int")).join(members, F.expr("g = g1 and c = c1"))
    visits = visits.select("doc_id", F.col("g2").alias("g"), F.col("c2").alias("c"), "part", F.lit(True).alias("guest"), "component")
    more = _opened(docs, hopeful(inside.unionByName(visits), False), k, num, den)
    for end in ("a", "b"):  # links between preliminary components
        more = more.join(found.select(F.col("node").alias(end), F.col("component").alias(f"{end}0")), end, "left").withColumn(end, F.coalesce(f"{end}0", end)).drop(f"{end}0")
    late = components(more, "a", "b")
    known = found.select(F.col("node").alias("doc_id"), F.col("component").alias("before")).join(late.withColumnRenamed("node", "before"), "before", "left")
    known = known.select("doc_id", F.coalesce("component", "before").alias("component"))
    return known.unionByName(late.withColumnRenamed("node", "doc_id").join(found.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their sets of word shingles (A-Z lower-cased);
    a document with fewer words is one shingle; one without words, or with a null text, has an empty set and links with
    nothing. component_id is the smallest doc_id reachable by links. A row with a null doc_id links with nothing and has a null component_id; rows that repeat a
    doc_id must repeat its text and get the same result. Other columns are ignored. An empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared_folder(docs.sparkSession)
    keys = "doc_id long, n_shingles long, h1 long, h2 long, token long, n long"
    alone = docs.filter("doc_id is null").mapInArrow(tidy(lambda it: _keys(it, words)), keys).filter("token is null")
    docs = docs.filter("doc_id is not null")
    seen = written(docs.mapInArrow(tidy(lambda it: _keys(it, words)), keys))
    keyed, common = seen.filter("token is null").select("doc_id", "n_shingles", "h1", "h2"), seen.filter("token is not null").select("token", "n")
    classes = written(keyed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    groups = joined(docs, classes.select(F.col("rep").alias("doc_id"), "n"), common, words, num, den)
    return (
        keyed.join(classes, ["h1", "h2"], "left")
        .join(groups.withColumnRenamed("doc_id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, num=90, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = n.doc_id
"""
