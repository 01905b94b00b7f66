"""Operators on small fixtures: worked values, ties, empty and odd input."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tilth.functions import alignment, keys, scalars, text
from tilth.operators import grading, intervals, locate, progress, quality, robust, scoring
from tilth.sources import dimensions


def one(df):
    return df.first()[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("x")))


# ---- robust ----
def test_bands_from_few_values(spark):
    rows = [("madd_6", v) for v in (8.0, 8.2, 7.8, 8.1, 7.9, 8.3, 30.0)] + [("iqlab", 1.0), ("iqlab", 1.1)] + [("madd_2", 2.0)] * 6
    got = {r["rule"]: r for r in robust.calibration_bands(spark.createDataFrame(rows, "rule string, x double"), "rule", "x").collect()}
    assert set(got) == {"madd_6", "madd_2"} and abs(got["madd_6"]["median"] - 8.1) < 0.3
    assert got["madd_2"]["mad"] == 1e-9 and got["madd_6"]["p10"] == 7.9


@pytest.mark.parametrize("n", [1, 2, 6, 7, 500])
def test_order_statistics_are_exact(spark, n):
    rng = random.Random(n)
    xs = [round(rng.expovariate(1), 2) for _ in range(n)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", None)], "k string, x double")
    got = robust.order_statistics(df, ["k"], "x", {f"q{q}": robust.nearest_rank(q / 20) for q in range(21)}).collect()
    assert len(got) == 1 and all(got[0][f"q{q}"] == sorted(xs)[round(q / 20 * (n - 1))] for q in range(21))
    assert robust.medians(df, ["k"], "x", "m").first()["m"] == pytest.approx(statistics.median(xs))


def test_theil_sen_resists_outliers(spark):
    points = [(1, x, 1.0 + 0.4 * x) for x in range(55)]
    points[3], points[40] = (1, 3, 900.0), (1, 40, -500.0)
    points += [(2, x, float(x)) for x in range(3)]
    df = spark.createDataFrame([(g, float(x), y, i) for i, (g, x, y) in enumerate(points)], "g int, x double, y double, i int")
    got = robust.theil_sen(df, ["g"], "x", "y").collect()
    assert [(r["g"], round(r["slope"], 6), round(r["intercept"], 6)) for r in got] == [(1, 0.4, 1.0)]
    big = spark.range(600).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 0.4 + 1).alias("y"), F.col("id").alias("i"))
    assert robust.theil_sen(big, ["g"], "x", "y").first()["slope"] == pytest.approx(0.4)


def test_only_gross_anomalies(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randint(8, 220))) for i in range(200)]
    rows = [(i, n, (1.0 + 0.4 * n) * rng.uniform(0.75, 1.25)) for i, n in rows]
    for i, y in ((5, 0.1), (50, rows[50][2] * 3.0), (90, rows[90][2] * 0.3)):
        rows[i] = (rows[i][0], rows[i][1], y)
    df = spark.createDataFrame([("r", *r) for r in rows], "reciter string, i int, letters double, seconds double")
    fit = robust.theil_sen(df, ["reciter"], "letters", "seconds")
    found = robust.outliers(df, fit, ["reciter"], "letters", "seconds", min_abs=0.4, mad_k=6.0, ratio_low=0.5, ratio_high=2.0).where("outlier").collect()
    by = {r["i"]: r["reason"] for r in found}
    assert by[5] == "too_short_abs" and by.get(50) in ("too_long", None) and set(by) <= {5, 50, 90}


# ---- keys, text ----
@pytest.mark.parametrize("name, audit, batch", [("001007.mp3", "1:7", "1:7"), ("2_255.wav", None, "2:255"), ("recite-112-1.wav", None, "112:1"), ("my_002255_take2.wav", None, "2:255"), ("999001.mp3", None, None), ("12345", None, None), ("noname", None, None), ("999_1", None, None)])
def test_file_keys(spark, name, audit, batch):
    assert value(spark, keys.key_of_digits(F.lit(name))) == audit
    assert value(spark, keys.key_of_recording(F.lit(name))) == batch


def test_conventions(spark):
    assert value(spark, keys.key_by_pattern(F.lit("a-2x255.mp3"), r"([0-9]+)x([0-9]+)")) == "2:255"
    assert value(spark, keys.reciter_of(F.lit("x.mp3"))) == "_root"


def test_normalisation(spark):
    assert value(spark, text.normalize(F.lit("  ٱلرَّحْمَـٰنِ   أُمَّةٌ "))) == "الرحمن امه"
    assert value(spark, text.letters_only(F.lit("بِسْمِ ٱللَّهِ"))) == "بسمالله"
    assert value(spark, text.has_formula(F.lit("بِسْمِ ٱللَّهِ ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ قُلْ")))


def test_words_and_slices(spark):
    got = value(spark, text.words(F.lit("  ab c\nd ")))
    assert [(w["word"], w["start"], w["end"]) for w in got] == [("ab", 2, 4), ("c", 5, 6), ("d", 7, 8)]
    assert value(spark, text.words(F.lit(""))) == []
    assert value(spark, text.enclosing_word(F.lit("one two three"), F.lit(5), F.lit(9))) == "two three"
    assert value(spark, text.slice_text(F.lit("abc"), F.lit(1), F.lit(9))) == "bc"


@pytest.mark.parametrize("hyp, ref, want", [("abc", "abc", 0.0), ("", "", 0.0), ("x", "", 1.0), ("", "ab", 1.0), ("abcd", "ab", 1.0)])
def test_error_rate(spark, hyp, ref, want):
    assert value(spark, text.error_rate(F.lit(hyp), F.lit(ref))) == want


def test_fits_agree_with_the_arrow_version(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 7))), "".join(rng.choices("abc", k=rng.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "h string, w string")
    both = F.least(text.prefix_fit(F.col("h"), F.col("w")), text.suffix_fit(F.col("h"), F.col("w")))
    for r in df.select(both.alias("a"), alignment.fit_udf("h", "w").alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"])


def test_bag_overlap(spark):
    assert value(spark, text.bag_overlap(text.bigrams(F.lit("aaab")), text.bigrams(F.lit("aab")))) == 2
    assert value(spark, text.bag_overlap(text.bigrams(F.lit("")), text.bigrams(F.lit("a")))) == 0


def test_formatting(spark):
    assert value(spark, scalars.pad_key(F.lit(2), F.lit(255))) == "002255"
    assert value(spark, scalars.days_until_label(F.lit(5), F.lit(5))) == "due now"
    assert value(spark, scalars.hours_until(F.lit(0), F.lit(1))) == 1


# ---- alignment ----
def test_alignment_positions():
    assert alignment.matched_positions("abd", "abcd") == [0, 1, None, 2]
    assert alignment.reached_region("cde", "abcdefg") == (2, 4)
    assert alignment.reached_region("", "ab") is None
    assert alignment.word_ratios("abcdef", "abcdefghijklmnop", [(0, 3), (3, 6), (13, 16)]) == [1.0, 1.0, None]
    assert alignment.low_share([0.0] * 10, 16000) is None


# ---- locate ----
def test_locate_prefers_the_narrow_run(spark):
    verses = [(1, i, t) for i, t in enumerate(["qulhuwallahuahad", "allahussamad", "lamyalidwalamyulad", "walamyakunlahu"])]
    clips = [(1, "second", 1, "allahussamad"), (1, "both", None, "qulhuwallahuahadallahussamad"), (1, "tail", None, "yakunlahu"), (1, "none", None, "zzzzzzzzzzzzzzzz"), (1, "empty", None, "")]
    got = {r["clip"]: (r["from"], r["to"]) for r in locate.locate(spark.createDataFrame(clips, "s int, clip string, near int, decoded string"), spark.createDataFrame(verses, "s int, pos int, letters string"), ["s"]).collect()}
    assert got["second"] == (1, 1) and got["both"] == (0, 1) and got["tail"] == (3, 3) and "none" not in got and "empty" not in got


# ---- intervals ----
def test_binned_overlap_equals_plain(spark):
    rng = random.Random(4)
    a = spark.createDataFrame([(i % 3, i, s, s + rng.randint(1, 40)) for i in range(80) for s in [rng.randint(0, 300)]], "k int, a int, a0 int, a1 int")
    b = spark.createDataFrame([(i % 3, i, s, s + rng.randint(1, 90)) for i in range(80) for s in [rng.randint(0, 300)]], "k int, b int, b0 int, b1 int")
    pairs = lambda w: sorted((r["a"], r["b"]) for r in intervals.overlap_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), bin_width=w).collect())
    assert pairs(None) == pairs(25) and len(pairs(25)) == len(set(pairs(25)))


def test_carry_forward_crosses_blocks(spark):
    rows = [(1, t, v) for t, v in enumerate([None, 5, None, None, None, None, 7, None, None, None])]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = [r["c"] for r in intervals.carry_forward(df, ["k"], ["t"], "v", "c", F.floor(F.col("t") / 3)).orderBy("t").collect()]
    assert got == [None, 5, 5, 5, 5, 5, 7, 7, 7, 7]


def test_confirmed_prefix(spark):
    rows = [("full", 1, 1.0), ("full", 2, 0.5), ("rescue", 1, 0.0), ("rescue", 2, 1.0), ("none", 1, 0.1)]
    got = {r["k"]: (r["n_confirmed"], r["resume_at"]) for r in intervals.confirmed_prefix(spark.createDataFrame(rows, "k string, a int, r double"), ["k"], "a", "r", 0.5, 0.6).collect()}
    assert got == {"full": (2, None), "rescue": (0, 3), "none": (0, None)}


def test_juz_bounds(spark):
    counts = spark.createDataFrame([(s, 10 * s) for s in range(1, 115)], "surah int, ayah_count int")
    got = {r["juz"]: r for r in dimensions.juz(spark, counts).collect()}
    assert (got[1]["end_surah"], got[1]["end_ayah"]) == (2, 141)
    assert (got[13]["end_surah"], got[13]["end_ayah"]) == (14, 140)  # the next starts at 15:1
    assert (got[30]["end_surah"], got[30]["end_ayah"]) == (114, 1140)


# ---- quality ----
def test_inventory_and_coverage(spark):
    canonical = spark.createDataFrame([(1, a) for a in range(1, 5)], "s int, a int")
    present = spark.createDataFrame([(1, 1), (1, 2), (9, 9), (1, 1)], "s int, a int")
    got = {(r["s"], r["a"]): r["side"] for r in quality.missing_and_extra(canonical, present, ["s", "a"]).collect()}
    assert got == {(1, 3): "missing", (1, 4): "missing", (9, 9): "extra"}
    groups = spark.createDataFrame([("x",), ("y",)], "g string")
    cover = quality.coverage(groups, canonical, present.withColumn("g", F.lit("x")), ["g"], ["s", "a"]).collect()
    assert {(r["g"], r["n_present"], r["n_missing"]) for r in cover} == {("x", 2, 2), ("y", 0, 4)}


@pytest.mark.parametrize("row, want", [((None, 1.0, True), "missing"), ((0, 1.0, True), "empty"), ((100, 1.0, True), "tiny"), ((4096, None, False), "unreadable"), ((4096, None, True), "corrupt"), ((4096, 0.0, True), "zero_duration"), ((4096, 2.0, True), "ok")])
def test_integrity_ladder(spark, row, want):
    df = spark.createDataFrame([row], "n long, d double, ok boolean")
    assert one(df.select(quality.integrity(F.col("n"), F.col("d"), F.col("ok"), 1024))) == want


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"], r["n_duplicates"]) for r in quality.first_wins(df, ["k"], ["o"]).collect()} == {("a", "y", 1), ("b", "z", 0)}
    assert {(r["k"], r["v"]) for r in quality.last_wins(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", "z")}


# ---- progress ----
def plain_sm2(qualities):
    ease, interval, reps, streak, status = 2.5, 0.0, 0, 0, "learning"
    for q in qualities:
        q = max(0, min(5, q))
        if q >= 3:
            interval = 1.0 if reps == 0 else 6.0 if reps == 1 else float(int(interval * ease + 0.5))
            reps, streak = reps + 1, streak + 1
            status = "mastered" if streak >= 7 else "reviewing" if streak >= 3 else "learning"
        else:
            interval, reps, streak = 1.0, 0, 0
        ease = max(1.3, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    return round(ease, 9), interval, reps, streak, status


def test_sm2_fold(spark):
    rng = random.Random(1)
    logs = {u: [rng.randint(-1, 6) if u % 2 else rng.randint(3, 5) for _ in range(rng.randint(1, 20))] for u in range(30)}
    df = spark.createDataFrame([(u, t, q) for u, qs in logs.items() for t, q in enumerate(qs)], "u int, t long, q int")
    got = {r["u"]: (round(r["ease"], 9), r["interval"], r["repetitions"], r["streak"], r["status"]) for r in progress.sm2(df, ["u"], ["t"], "t", "q").collect()}
    assert got == {u: plain_sm2(qs) for u, qs in logs.items()}


def test_streak_joker(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06", "2024-01-07", "2024-01-09", "2024-01-10", "2024-01-12"]
    df = spark.createDataFrame([(1, d) for d in days], "u int, d string").select("u", F.to_date("d").alias("d"))
    r = progress.streaks(df, ["u"], "d").first()
    assert (r["current"], r["longest"], r["jokers"], r["n_bridged"]) == (1, 9, 0, 1)


def test_slot_ledger(spark):
    hour = 3_600_000_000
    ops = [(i, "claim", i) for i in range(7)] + [(10, "step_back", 0), (11, "claim", 7), (83, "claim", 8), (84, "release", 1), (85, "claim", 9), (86, "claim", 9)]
    df = spark.createDataFrame([(1, t * hour, op, item) for t, op, item in ops], "u int, t long, op string, item long")
    r = progress.slot_ledger(df, ["u"], ["t"], "t", "op", "item").first()
    assert r["active"] == [2, 3, 4, 5, 8, 9] and r["n_refused"] == 2 and r["cooling_until"] == []


# ---- grading ----
SPAN = "array<struct<t0: double, t1: double>>"


def recordings(spark, rows):
    return spark.createDataFrame(rows, f"clip int, surah int, ayah int, text string, spans {SPAN}, duration double, decoded string")


def test_unit_and_long_rule(spark):
    spans = [(0.0, 0.4), (0.4, 1.6), (1.6, 2.0)]
    recs = recordings(spark, [(1, 5, 5, "abc", spans, 2.0, "abc"), (2, 5, 6, "abc", [(0.0, 0.4), (0.4, 0.8), (0.8, 1.0)], 1.0, None)])
    segs = spark.createDataFrame([(5, 5, "madd_2", 0, 1), (5, 5, "madd_6", 1, 2), (5, 5, "silent", 2, 3), (5, 6, "madd_2", 0, 1), (5, 6, "madd_6", 1, 2)], "surah int, ayah int, rule string, start int, end int")
    assert {r["clip"]: r["unit"] for r in grading.units(recs, segs).collect()} == {1: 0.2, 2: 0.2}
    got = {(r["clip"], r["rule"]): (round(r["measured"], 6), r["status"]) for r in grading.measure(recs, segs).collect()}
    assert got == {(1, "madd_2"): (2.0, "ok"), (1, "madd_6"): (6.0, "ok"), (2, "madd_2"): (2.0, "ok"), (2, "madd_6"): (2.0, "warn")}


def test_mark_takes_the_letter_before(spark):
    recs = recordings(spark, [(1, 5, 5, "abm", [(0.0, 0.4), (0.4, 1.6), None], 2.0, None)])
    segs = spark.createDataFrame([(5, 5, "madd_2", 0, 1), (5, 5, "madd_6", 2, 3)], "surah int, ayah int, rule string, start int, end int")
    got = {r["rule"]: r for r in grading.measure(recs, segs).collect()}
    assert got["madd_6"]["measured"] == pytest.approx(6.0) and got["madd_6"]["status"] == "ok"


def test_calibration_overrides_and_reclass(spark):
    recs = recordings(spark, [(1, 2, 1, "ab", [(0.0, 0.4), (0.4, 2.0)], 2.0, None)])
    segs = spark.createDataFrame([(2, 1, "madd_2", 0, 1), (2, 1, "madd_muttasil", 1, 2), (2, 1, "madd_6", 1, 2)], "surah int, ayah int, rule string, start int, end int")
    learnt = spark.createDataFrame([("madd_muttasil", 6.0, 10.0, None)], "rule string, lo double, hi double, nasal_lo double")
    book = {r["rule"]: r["status"] for r in grading.measure(recs, segs).collect()}
    ours = {r["rule"]: r["status"] for r in grading.measure(recs, segs, learnt).collect()}
    assert book["madd_muttasil"] == "warn" and ours["madd_muttasil"] == "ok" and book["madd_6_muqattaat"] == "ok"


def test_length_guard(spark):
    with pytest.raises(Exception, match="differ in length"):
        grading.checked(recordings(spark, [(1, 1, 1, "abc", [(0.0, 1.0)], 1.0, None)])).collect()


def test_report(spark):
    spans = [(i * 0.1, i * 0.1 + 0.1) for i in range(11)]
    recs = recordings(spark, [(1, 5, 5, "hello world", spans, 1.1, "hello world"), (2, 5, 5, "hello world", spans, 1.1, "qqqqzzzzkkkk"), (3, 5, 5, "hello world", spans, 1.1, "hello wxxxx")])
    segs = spark.createDataFrame([(5, 5, "madd_2", 0, 1), (5, 5, "madd_6", 1, 2)], "surah int, ayah int, rule string, start int, end int")
    got = {r["clip"]: r for r in grading.reports(recs, segs).collect()}
    assert got[1]["content_status"] == "ok" and [w["verdict"] for w in got[1]["word_scores"]] == ["yellow", "green"]
    assert got[2]["content_status"] == "mismatch" and got[2]["segments"] is None and got[2]["n_ok"] == 0
    assert got[3]["word_scores"][1]["verdict"] == "red"


def test_roll_up(spark):
    rows = [("madd_2", "ok"), ("madd_6", "warn"), ("madd_6_muqattaat", "ok"), ("iqlab", "ok"), ("iqlab", "missing_audio")]
    got = scoring.roll_up(spark.createDataFrame(rows, "rule string, status string"), "rule", advisory=("madd_6_muqattaat",)).collect()
    graded = [r for r in got if not r["advisory"]]
    assert sum(r["n_ok"] for r in graded) == 2 and sum(r["n_warn"] for r in graded) == 1


@pytest.mark.parametrize(
    ("name", "path", "key"),
    [
        ("concat_3_3", "a/002255.mp3", "2:255"), ("concat_3_3", "a/12345/002255x1234567.mp3", "2:255"), ("concat_3_3", "115001.mp3", None), ("concat_3_3", "x.mp3", None),
        ("folder", "2/255.mp3", "2:255"), ("folder", "001/001002.mp3", "1:2"), ("folder", "0002/0255.mp3", "2:255"), ("folder", "12345/2/3.mp3", "2:3"), ("folder", "2/000.mp3", None),
        ("separated", "x_2-255.mp3", "2:255"), ("separated", "1234_5.6", "5:6"), ("separated", "2__3", None), ("separated", "0002_3.mp3", None),
        ("labelled", "sura12_aya3.mp3", "12:3"), ("labelled", "s0001a0002.mp3", "1:2"), ("labelled", "Surah2 Ayah255", "2:255"), ("labelled", "surah_2_ayah_255.mp3", None), ("labelled", "a3s4.mp3", None),
    ],
)
def test_naming_conventions(spark, name, path, key):
    assert value(spark, keys.key_by_convention(F.lit(path), name)) == key


def test_locate_moves_the_ends_of_runs_and_not_their_letters(spark):
    import random

    from tilth.operators import locate

    rng = random.Random(8)
    verses = [(1, p, "".join(rng.choices("abcdefghijklmnop", k=900))) for p in range(300)]
    clips = [(1, p, None, t[5:65]) for _, p, t in verses] + [(1, 301, None, "ab"), (1, 302, None, "")]
    schemas = "s int, clip int, near int, decoded string", "s int, pos int, letters string"

    def shuffled():
        jvm = spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = {r["clip"]: (r["from"], r["to"]) for r in locate.locate(*(spark.createDataFrame(rows, schema) for rows, schema in zip((clips, verses), schemas, strict=True)), ["s"]).collect()}
    assert shuffled() - before < 20 << 20
    assert all(got[p][0] <= p <= got[p][1] for p in range(300)) and 302 not in got


def test_shared_pairs_at_once_are_those_of_each_pair():
    import random

    from tilth.functions import alignment

    rng = random.Random(2)
    some = lambda n, least: ["".join(rng.choices("abc", k=rng.randint(least, 30))) for _ in range(n)]
    clips, runs = some(40, 1), some(60, 0)
    caps = [int(len(c) * 1.3) + 5 for c in clips]
    got = alignment.most_shared(clips, caps, runs, runs)
    for i, c in enumerate(clips):
        assert got[i].tolist() == [max(alignment.shared_bigrams(c, r[: caps[i]]), alignment.shared_bigrams(c, r[-caps[i] :])) for r in runs]
