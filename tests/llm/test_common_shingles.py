"""Near-duplicates where one shingle is in very many documents, and where columns have the names of helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.llm import simhash


def plain_lists(rows):
    by = {}
    for token, n, node, at in set(rows):
        by.setdefault(token, []).append((n, node, at))
    return {t: sorted(v) for t, v in by.items() if len(v) > 1}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_lists_are_cut_and_put_together(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(7, 20, i, 0) for i in range(20_000)] + [(int(t), int(n), i, 1) for i, (t, n) in enumerate(zip(rng.integers(100, 3000, 9000), rng.integers(10, 14, 9000), strict=True))]
    rows += rows[::3]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash._lists(spark.createDataFrame(rows, "token long, n int, node long, at int").repartition(6)).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_lists(rows)
    assert set(got.token) == set(want)
    for token, g in got.groupby("token"):
        assert sorted(zip(g.n, g.node, g["at"], strict=True)) == want[token]
        n, node, at = want[token][0]
        size = len(want[token])
        assert set(g["size"]) in ({size}, {max(size, 4)})
        for r in g.itertuples():
            near = r.node != node and 9 * min(n - at, r.n - r.at) >= 4 * (n + r.n)
            assert (r.head == node) if near else np.isnan(r.head)


def test_no_task_gets_a_whole_common_token(spark, monkeypatch):
    tables, real = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: tables.setdefault(label, real(df, label)))
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("token"), F.lit(20).alias("n"), F.col("id").alias("node"), F.lit(0).alias("at"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash._lists(rows)
        assert got.count() == 200_000 and got.select("size").distinct().collect()[0][0] == 200_000
        most = max(r["count"] for r in tables["shared-shingles"].groupBy(F.input_file_name()).count().collect())  # a file is a task's
        assert most <= 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_variants_of_one_template_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(500):
        words = list(template)
        for at in rng.choice(60, rng.integers(0, 6), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        texts.append(" ".join(words))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(500):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: root(i) for i in range(500)}


def test_columns_named_like_helpers_stay(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 1), (1, text, "b", 2), (2, text, "c", 3), (3, "another text with some other words in it", None, None), (None, text, "d", 4), (None, None, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, _doc int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted(str(r[0]) for r in kept) == ["1", "3", "None"] and all(k in rows for k in kept)
