"""Search through trigrams against the plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tilth.functions import text
from tilth.operators import lookup, trigrams

ARABIC = "بسم الله الرحمن الرحيم الحمد لله رب العالمين مالك يوم الدين اياك نعبد واياك نستعين اهدنا الصراط المستقيم".split()
LATIN = "in the name of lord mercy most merciful praise be to 100%_sure path\\ straight those whom You favored ÉTÉ".split()


@pytest.fixture(scope="module")
def verses(spark):
    rng = random.Random(3)
    rows = []
    for s in range(1, 13):
        for a in range(1, 60):
            rows.append((s, a, " ".join(rng.choices(ARABIC, k=rng.randint(1, 9))), " ".join(rng.choices(LATIN, k=rng.randint(1, 9))), None if a % 7 == 0 else " ".join(rng.choices(LATIN, k=3))))
    rows += [(99, 1, None, None, None), (99, 2, "", "", ""), (99, 3, "rare", "the needle is here", "x"), (99, 3, "rare", "the needle is here", "x")]
    frame = spark.createDataFrame(rows, "surah int, ayah int, text string, translation string, transliteration string")
    return frame.withColumn("text_normalized", text.normalize(F.col("text")))


@pytest.fixture(scope="module")
def index(spark, verses, tmp_path_factory):
    trigrams.BLOCK_ROWS, before = 40, trigrams.BLOCK_ROWS
    path = str(tmp_path_factory.mktemp("index") / "i")
    trigrams.build(verses, ["surah", "ayah"], ["text_normalized", "translation", "transliteration"], path)
    trigrams.BLOCK_ROWS = before
    return path


@pytest.mark.parametrize("query", ["needle", "NEEDLE", "the na", "100%_", "path\\ s", "lord mercy", "zzz", "of", "x", "", "  merciful praise ", "été", "الرَّحْمَـٰنِ ٱلرَّحِيمِ", "لله رب", "له", "e"])
def test_same_rows_as_the_scan(spark, verses, index, query):
    for limit in (50, 10_000):
        want = [tuple(r) for r in lookup.search_verses(verses, query, limit).select("surah", "ayah", "translation").collect()]
        got = [tuple(r) for r in trigrams.search_verses(spark, index, query, limit).select("surah", "ayah", "translation").collect()]
        assert [w[:2] for w in want] == [g[:2] for g in got] and sorted(map(str, want)) == sorted(map(str, got))


def test_only_blocks_of_candidates_are_read(spark, index):
    found = trigrams.search(spark, index, ["surah", "ayah"], ["translation"], "needle")
    assert found.count() == 2
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "translation" in x]
    blocks = {r["b"] for r in spark.read.parquet(f"{index}/rows").where("translation like '%needle%'").select(F.col("_block").alias("b")).collect()}
    assert len(blocks) == 1 and scans and all(re.search(rf"PartitionFilters: \[.*\(_block#\d+ = {min(blocks)}\)", x) for x in scans)
    assert trigrams.search(spark, index, ["surah", "ayah"], ["translation"], "no such words").count() == 0


def shuffled(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_index_shuffles_less_than_twice_its_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").localCheckpoint()
    before = shuffled(spark)
    trigrams.build(rows, ["id"], ["t"], str(tmp_path / "i"))
    assert shuffled(spark) - before < 2 * sum(map(len, texts))
    want = sorted(i for i, t in enumerate(texts) if words[7] in t)
    assert sorted(r["id"] for r in trigrams.search(spark, str(tmp_path / "i"), ["id"], ["t"], words[7]).collect()) == want


def test_lists_in_chunks_hold_what_the_expression_finds(spark, verses, tmp_path, monkeypatch):
    rows = verses.union(verses.where("surah = 99")).withColumn("translation", F.concat("translation", F.lit(" 𝒳𝒴z")))
    columns = ["text_normalized", "translation", "transliteration"]
    monkeypatch.setattr(trigrams, "CHUNK_ROWS", 7)
    path = str(tmp_path / "i")
    trigrams.build(rows, ["surah", "ayah"], columns, path)
    postings, table = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/rows")
    assert postings.select("_block", "part").distinct().count() == -(-rows.count() // trigrams.CHUNK_ROWS)
    got = postings.select("gram", "_block", "part", F.explode("found").alias("at")).select("gram", "_block", (F.col("part") + F.col("at")).alias("_row"))
    each = F.array_distinct(F.flatten(F.array(*[F.coalesce(trigrams.trigrams(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    # the expression also finds what begins within a letter of two units
    want = table.select(F.explode(each).alias("gram"), "_block", "_row").where("not startswith(gram, '?')")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_short_and_null_texts_have_no_trigrams(spark):
    row = spark.createDataFrame([("ab", None, "Abcd", "aaaa")], "a string, b string, c string, d string").select(*[trigrams.trigrams(F.col(c)) for c in "abcd"]).first()
    assert list(row) == [[], None, ["abc", "bcd"], ["aaa"]] or list(row) == [[], [], ["abc", "bcd"], ["aaa"]]
