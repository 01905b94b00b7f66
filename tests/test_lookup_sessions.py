"""Reference reads, guided sessions and windows of several verses."""

from pyspark.sql import functions as F

from tilth.operators import grading, lookup, progress


def verses(spark):
    rows = [(s, a, f"نص {s}", f"نص {s}", f"Verse {a} of 100% {s}_x" if a % 2 else None, f"tr {a}") for s in (1, 2, 3) for a in range(1, 6)]
    return spark.createDataFrame(rows, "surah int, ayah int, text string, text_normalized string, translation string, transliteration string")


def test_ranges_points_and_search(spark):
    v = verses(spark)
    keys = lambda df: [(r["surah"], r["ayah"]) for r in df.collect()]
    assert keys(lookup.verses_between(v, (1, 4), (3, 1))) == [(1, 4), (1, 5), *[(2, a) for a in range(1, 6)], (3, 1)]
    assert keys(lookup.point(v, surah=2, ayah=3)) == [(2, 3)] and keys(lookup.point(v, surah=9)) == []
    assert keys(lookup.verses_by_keys(v, spark.createDataFrame([(3, 2), (1, 1), (7, 7)], "surah int, ayah int"))) == [(1, 1), (3, 2)]
    assert keys(lookup.search_verses(v, "VERSE 1")) == [(1, 1), (2, 1), (3, 1)]
    assert len(keys(lookup.search_verses(v, "100% 2_"))) == 3 and keys(lookup.search_verses(v, "100_")) == []
    assert len(keys(lookup.search_verses(v, "نَصّ ٢"))) == 0 and len(keys(lookup.search_verses(v, "نَصّ 2"))) == 5
    assert keys(lookup.search_verses(v, "x")) == []


def test_surah_search_and_jumps(spark):
    s = spark.createDataFrame([(1, "الفاتحة", "Opening", "Al-Fatihah"), (2, "البقرة", "Cow", "Al-Baqarah"), (12, "يوسف", None, "Yusuf")], "surah int, name_ar string, name_en string, name_tr string")
    of = lambda q: [r["surah"] for r in lookup.search_surahs(s, q).collect()]
    assert of("12") == [12] and of("al-") == [1, 2] and of("البقره") == [2] and of("") == [] and of("cow") == [2]
    q = spark.createDataFrame([("2:255",), ("Juz 30",), ("page 604",), ("hello",)], "q string")
    got = [tuple(r["j"]) if r["j"] else None for r in q.select(lookup.jump(F.col("q")).alias("j")).collect()]
    assert got == [("verse", 2, 255), ("juz", 30, None), ("page", 604, None), None]


def test_audio_flags_and_examples(spark):
    a = spark.createDataFrame([(1, 1, "r", True), (1, 2, "r", False), (1, 3, "r", None), (1, 1, "q", True)], "surah int, ayah int, reciter string, verified boolean")
    assert [r["ayah"] for r in lookup.usable_audio(a, "r").orderBy("ayah").collect()] == [1, 3]
    seg = spark.createDataFrame([(1, a, "iqlab", i, i + 1, "s", "w") for a in range(1, 6) for i in (0, 4)], "surah int, ayah int, rule string, start_idx int, end_idx int, segment string, word string")
    got = lookup.drill_examples(seg, verses(spark), "iqlab", show=3).collect()
    assert [(r["ayah"], r["start_idx"]) for r in got] == [(1, 0), (2, 0), (3, 0)]


def test_guided_chunks(spark):
    runs = {"clean": "pppp", "slip": "ppfpp", "back": "ppfffppp", "open": "pp", "noise": "pp.pp"}
    rows = [(k, i, c == "p", "  x " if c == "." else "decoded") for k, s in runs.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, i int, ok boolean, d string")
    got = {r["k"]: (r["stage"], r["n_blind_fails"], r["fell_back"], r["quality"]) for r in progress.guided_chunks(df, ["k"], ["i"], "ok", "d").collect()}
    assert got == {"clean": ("done", 0, False, 5), "slip": ("done", 1, False, 4), "back": ("done", 3, True, 2), "open": ("blind", 0, False, None), "noise": ("done", 0, False, 5)}


def test_window_progress_and_rebase(spark):
    words = [("a", 0, 3, True), ("a", 4, 7, True), ("a", 8, 11, True), ("a", 12, 15, False), ("b", 0, 3, False), ("b", 4, 7, False), ("b", 8, 11, True), ("b", 12, 15, True)]
    w = spark.createDataFrame(words, "clip string, start int, end int, content_ok boolean")
    spans = spark.createDataFrame([(c, a, s, e) for c in "ab" for a, s, e in ((1, 0, 7), (2, 8, 15))], "clip string, ayah int, v0 int, v1 int")
    got = {r["clip"]: (r["n_confirmed"], r["resume_at"]) for r in grading.window_progress(w, spans).collect()}
    assert got == {"a": (2, None), "b": (0, 3)}
    back = {(r["clip"], r["ayah"], r["start"]) for r in grading.rebased(w, spans, ["start", "end"]).collect()}
    assert ("a", 2, 0) in back and ("b", 1, 4) in back


def test_clean_attempts(spark):
    w = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", False), ("b", False)], "k string, content_ok boolean")
    got = {r["k"]: r["clean"] for r in progress.attempt_is_clean(w, ["k"], F.lit(3)).collect()}
    assert got == {"a": True, "b": False}
