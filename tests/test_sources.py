"""Readers of split files, and tables published together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from farsight.sources import objects, tables, versions


def entries(n, seed=1):
    rng = random.Random(seed)
    odd = ['"', "}", "{", "\\", "]", "[", ",", ":", "\n", "é", "日", "\\\"}", "}}", "x" * 50, ""]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(6)))
    tags = lambda: [{"qid": f"Q{rng.randrange(99)}", "label": text()} for _ in range(rng.randrange(4))]
    return {f"Q{i}{text()}": {"qid": f"Q{i}" if i % 3 else None, "label": text(), "related_tags": tags()} for i in range(n)}


@pytest.mark.parametrize("indent,size", [(None, 200), (1, 333), (None, 1 << 20), (2, 61)])
def test_an_object_is_read_by_many_tasks(spark, tmp_path, indent, size):
    whole = entries(120)
    path = tmp_path / "map.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(indent)))
    old = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = objects.parts_of(spark, str(path))
        assert size > 1000 or parts.select("split").distinct().count() > 20
        got = {r["key"]: json.loads(r["value"]) for r in objects.read_entries(spark, str(path)).collect()}
        assert got == whole
        rows = tables.read_relation_map(spark, str(path)).collect()
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), old):
            spark.conf.set(k, v)
    want = sorted((v["qid"] or k, v["label"], [(t["qid"], t["label"]) for t in v["related_tags"]]) for k, v in whole.items())
    assert sorted((r.qid, r.label, [tuple(t) for t in r.related_tags]) for r in rows) == want


def test_several_and_empty_objects(spark, tmp_path):
    for name, x in (("a", {}), ("b", {"k": {"label": "1"}}), ("c", {"k": {"label": "2", "related_tags": []}, "l": {}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(x) + "\n")
    assert sorted((r.qid, r.label) for r in tables.read_relation_map(spark, str(tmp_path)).collect() if r.label) == [("k", "1"), ("k", "2")]
    assert tables.read_relation_map(spark, str(tmp_path)).count() == 3


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"qid": f"Q{i}"}) + "\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        df = tables.read_json_lines(spark, str(tmp_path), "qid string", with_file=True)
        assert df.rdd.getNumPartitions() > 3
        assert [r.qid for r in df.orderBy("file", "pos").collect()] == [f"Q{i}" for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    import gzip

    (tmp_path / "z").mkdir()
    with gzip.open(tmp_path / "z" / "x.jsonl.gz", "wt") as f:
        f.write("".join(json.dumps({"qid": f"Q{i}"}) + "\n" for i in range(50)))
    assert tables.read_json_lines(spark, str(tmp_path / "z"), "qid string", spread=5).rdd.getNumPartitions() == 5


def test_publish_is_one_commit(spark, tmp_path, monkeypatch):
    root, one = str(tmp_path / "out"), lambda v: spark.createDataFrame([(v,)], "v int")
    with pytest.raises(ValueError, match="nothing"):
        versions.read_table(spark, root, "items")
    seen = lambda: [versions.read_table(spark, root, t).first().v for t in ("items", "pages")]
    assert versions.publish(spark, root, {"items": one(1), "pages": one(10)}) == 1 and seen() == [1, 10]
    # the second table fails after the first is written
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, root, {"items": one(2), "pages": one(20).select(F.raise_error(F.lit("broken")).alias("v"))})
    assert seen() == [1, 10]
    # everything is written, the commit isn't
    commit = versions.commit
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        versions.publish(spark, root, {"items": one(3), "pages": one(30)})
    assert seen() == [1, 10]
    monkeypatch.setattr(versions, "commit", commit)
    for v in (4, 5, 6):
        versions.publish(spark, root, {"items": versions.read_table(spark, root, "items").select(F.lit(v).alias("v")), "pages": one(10 * v)})
    assert seen() == [6, 60] and versions.current(spark, root) == 4
    assert versions.read_table(spark, root, "items", 3).first().v == 5 and not versions.exists(spark, f"{root}/v=2")


def test_compaction_drops_what_it_has_read(spark, tmp_path, monkeypatch):
    parts, root = str(tmp_path / "splits"), str(tmp_path / "whole")
    write = lambda name, *ids: spark.createDataFrame([(i,) for i in ids], "qid string").coalesce(1).write.json(f"{parts}/{name}")
    seen = lambda: sorted(r.qid for r in versions.read_table(spark, root, "items").collect())
    write("1", "a", "b")
    assert versions.compact(spark, parts, root, "qid string") == 1 and seen() == ["a", "b"]
    write("2", "c")
    remove = versions.remove
    monkeypatch.setattr(versions, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # after the commit, before the splits go
        versions.compact(spark, parts, root, "qid string")
    monkeypatch.setattr(versions, "remove", remove)
    assert seen() == ["a", "b", "c"]
    write("3", "d")
    versions.compact(spark, parts, root, "qid string")
    assert seen() == ["a", "b", "c", "d"]
    versions.compact(spark, parts, root, "qid string")
    assert seen() == ["a", "b", "c", "d"]


def test_pages_by_key(spark, tmp_path):
    rng = random.Random(7)
    keys = [rng.choice([rng.randrange(10), rng.randrange(10**12), None]) for _ in range(300)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, v int").repartition(5)
    tables.write_pages(df, "k", 40, str(tmp_path))
    order = sorted({k for k in keys if k is not None})
    for number in range(-(-len(order) // 40) + 1):
        own = set(order[40 * number : 40 * number + 40])
        got = sorted(r.v for r in tables.read_page(spark, str(tmp_path), "k", number).collect())
        assert got == [i for i, k in enumerate(keys) if k in own]
    plan = tables.read_page(spark, str(tmp_path), "k", 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k" in plan


def test_ranks_of_either_place(spark, tmp_path):
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    one = lambda q: spark.createDataFrame([(q, "t", 1, 5)], "qid string, tag string, rank int, sample_size int")
    one("a").write.parquet(f"{new}/retriever=x/n=10")
    one("b").write.parquet(f"{old}/retriever=x/n=10")
    one("c").write.parquet(f"{old}/retriever=x/n=20")
    with pytest.warns(UserWarning, match="no ranks of y, 10"):
        got = tables.read_ranks(spark, [new, old], [("x", 10), ("x", 20), ("y", 10)]).collect()
    assert sorted((r.qid, r.retriever, r.n) for r in got) == [("a", "x", 10), ("c", "x", 20)]
    with pytest.warns(UserWarning):
        assert tables.read_ranks(spark, new, [("z", 1)]).count() == 0
