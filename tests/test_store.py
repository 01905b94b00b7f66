"""The keyed store: what an upsert rewrites, what readers see, what expires."""

import os

import pytest
from pyspark.sql import functions as F

from tilth.sources import store
from tilth.streaming import windows


def rows(spark, x):
    return spark.createDataFrame(x, "k long, v string, t long")


def content(df):
    return {(r["k"], r["v"]) for r in df.collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    table = store.KeyedStore(spark, str(tmp_path / "t"), ["k"], buckets=32)
    first = table.upsert(spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("t")), ["t"])
    whole = size(tmp_path / "t/data")
    second = table.upsert(rows(spark, [(7, "new", 2), (7, "old", 1), (99_999, "more", 1)]), ["t"])
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(changed) <= 2 and size(tmp_path / "t/data") - whole < whole / 8
    assert table.read().count() == 20_001 and table.read().where("k = 7").first()["v"] == "new"
    assert table.read(first.version).where("k = 7").first()["v"] != "new"
    assert content(table.lookup(spark.createDataFrame([(7,), (99_999,), (-1,)], "k int"))) == {(7, "new"), (99_999, "more")}
    plan = table.lookup(spark.createDataFrame([(7,)], "k int"))
    assert len(plan.inputFiles()) == 1
    table.resize(8)
    assert table.read().count() == 20_001 and set(map(int, table.manifest().folders)) <= set(range(8))
    table.delete(spark.createDataFrame([(7,), (8,)], "k long"))
    assert table.read().where("k in (7, 8)").count() == 0 and table.read().count() == 19_999


def test_batches_count_once_and_conflicts_show(spark, tmp_path):
    table = store.KeyedStore(spark, str(tmp_path / "t"), ["k"], buckets=4)
    with pytest.raises(ValueError):
        table.read()
    write = windows.keyed_batches(str(tmp_path / "t"), ["k"], ["t"], stream="s", buckets=4)
    write(rows(spark, [(1, "a", 1)]), 0)
    write(rows(spark, [(1, "again", 9)]), 0)
    assert content(table.read()) == {(1, "a")} and table.versions() == [0]
    windows.keyed_batches(str(tmp_path / "t"), ["k"], ["t"], stream="other", buckets=4)(rows(spark, [(2, "b", 1)]), 0)
    assert content(table.read()) == {(1, "a"), (2, "b")}
    stale = table.manifest(0)
    with pytest.raises(store.Conflict):  # two writers from one version
        table._commit(store.Manifest(1, ["k"], 4, stale.schema, stale.folders, {}))
    assert content(table.read()) == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        store.KeyedStore(spark, str(tmp_path / "t"), ["v"]).read()
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "x")], "k long, other string"), ["other"])


def test_a_reader_keeps_its_version_and_versions_expire(spark, tmp_path):
    table = store.KeyedStore(spark, str(tmp_path / "t"), ["k"], buckets=2)
    table.upsert(rows(spark, [(k, "a", 1) for k in range(50)]), ["t"])
    seen = table.read()
    for i in range(5):
        table.upsert(rows(spark, [(3, f"b{i}", 1)]), ["t"])
    assert content(seen.where("k = 3")) == {(3, "a")}
    assert table.expire(keep=2) == 0  # everything is young
    before = size(tmp_path / "t/data")
    assert table.expire(keep=2, older_than=-60) >= 3 and size(tmp_path / "t/data") < before
    assert table.versions() == [4, 5] and content(table.read(4).where("k = 3")) == {(3, "b3")} and table.read().count() == 50


def test_null_keys_empty_batches_and_other_types(spark, tmp_path):
    table = store.KeyedStore(spark, str(tmp_path / "t"), ["k", "v"], buckets=3)
    table.upsert(rows(spark, [(None, "a", 1), (None, "a", 2), (1, None, 1)]), ["t"])
    table.upsert(spark.createDataFrame([(1, None, 5), (None, "a", 7)], "k int, v string, t int"), ["t"])
    table.upsert(rows(spark, []), ["t"])
    assert {tuple(r) for r in table.read().select("k", "v", "t").collect()} == {(None, "a", 7), (1, None, 5)}
    empty = store.KeyedStore(spark, str(tmp_path / "e"), ["k"])
    empty.upsert(rows(spark, []), ["t"])
    assert empty.read().collect() == [] and empty.read().columns == ["k", "v", "t"]
    with pytest.raises(ValueError):
        table.upsert(rows(spark, [(1, "a", 1)]).withColumn("_bucket", F.lit(1)), ["t"])
