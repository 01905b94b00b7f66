"""Small literal relations: rules with their grading properties, juz starts, places of revelation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rule key and label.
LABELS = {
    "hamzat_wasl": "Connecting hamza",
    "madd_2": "Natural prolongation (2)",
    "ikhfa": "Hiding",
    "ghunnah": "Nasalization",
    "madd_246": "Prolongation (2/4/6)",
    "silent": "Silent letter",
    "idghaam_ghunnah": "Merging with ghunnah",
    "qalqalah": "Echoing",
    "madd_munfasil": "Separate prolongation",
    "lam_shamsiyyah": "Assimilated lām",
    "madd_muttasil": "Connected prolongation",
    "idghaam_no_ghunnah": "Merging without ghunnah",
    "idghaam_shafawi": "Labial merging",
    "iqlab": "Conversion",
    "ikhfa_shafawi": "Labial hiding",
    "madd_6": "Necessary prolongation (6)",
    "idghaam_mutajanisayn": "Merging (similar)",
    "idghaam_mutaqaribayn": "Merging (close)",
}
# Groups of rules, and what each rule asks for.
GROUPS = {
    "madd": ("madd_2", "madd_246", "madd_munfasil", "madd_muttasil", "madd_6",),
    "ghunnah": ("ghunnah", "idghaam_ghunnah", "idghaam_no_ghunnah", "idghaam_shafawi", "idghaam_mutajanisayn", "idghaam_mutaqaribayn",),
    "ikhfa": ("ikhfa", "iqlab", "ikhfa_shafawi",),
    "qalqalah": ("qalqalah",),
    "special": ("hamzat_wasl", "silent", "lam_shamsiyyah",),
}
DESCRIPTIONS = {
    "hamzat_wasl": "A hamza that is heard at the start of speech and falls away in its middle.",
    "madd_2": "The vowel has its plain length, two beats.",
    "ikhfa": "Before fifteen letters the n is neither clear nor merged: it hums.",
    "ghunnah": "A doubled n or m hums through the nose for two beats.",
    "madd_246": "A pause at the word's end lets the reader lengthen the vowel: two, four or six beats.",
    "silent": "The script has the letter, the voice doesn't.",
    "idghaam_ghunnah": "The n goes into the next letter and leaves its hum.",
    "qalqalah": "A vowelless q, t, b, j or d rebounds.",
    "madd_munfasil": "The long vowel ends a word and a hamza begins the next: four or five beats.",
    "lam_shamsiyyah": "The article's l gives way to the sun letter after it.",
    "madd_muttasil": "Long vowel and hamza share a word: four or five beats.",
    "idghaam_no_ghunnah": "The n vanishes in an l or r, without a hum.",
    "idghaam_shafawi": "A vowelless m joins the m that follows.",
    "iqlab": "Before b the n is spoken as m.",
    "ikhfa_shafawi": "A vowelless m hums before b.",
    "madd_6": "A doubled or vowelless letter after the vowel asks for six beats.",
    "idghaam_mutajanisayn": "Letters formed in one place, different in manner, become one.",
    "idghaam_mutaqaribayn": "Letters formed near each other become one.",
}
RULES = tuple((key, label, next(g for g, of in GROUPS.items() if key in of)) for key, label in LABELS.items())
# Display colour of each rule, and of any other.
COLOURS = {
    "madd_2": "#E8A33D", "madd_246": "#F2C14E", "madd_6": "#E5392B", "madd_munfasil": "#F58B3C", "madd_muttasil": "#E5662E", "ghunnah": "#1E9E8A",
    "idghaam_ghunnah": "#2BB673", "idghaam_no_ghunnah": "#7FB069", "idghaam_shafawi": "#4C9A7A", "idghaam_mutajanisayn": "#5FA8A0", "idghaam_mutaqaribayn": "#6FB3AB",
    "ikhfa": "#3E78B2", "ikhfa_shafawi": "#5B8FD6", "iqlab": "#7E57C2", "qalqalah": "#C2407A", "hamzat_wasl": "#9AA0A6", "lam_shamsiyyah": "#B0883B", "silent": "#C4C7CC",
}
OTHER_COLOUR = "#C9A227"
# Reciter key, display name, style.
RECITERS = (
    ("abdul_basit_murattal", "Abdul Basit Murattal", "Murattal"),
    ("abdullaah_3awwaad_al_juhaynee", "Abdullaah Awwaad Al-Juhaynee", "Murattal"),
    ("abdullah_basfar", "Abdullah Basfar", "Murattal"),
    ("abdulsamad", "Abdul Samad", "Murattal"),
    ("abdurrahmaan_as_sudais", "Abdurrahmaan As-Sudais", "Murattal"),
    ("abu_bakr_ash_shaatree", "Abu Bakr Ash-Shaatree", "Murattal"),
    ("alafasy", "Mishary Alafasy", "Murattal"),
    ("ali_jaber", "Ali Jaber", "Murattal"),
    ("ayman_sowaid", "Ayman Sowaid", "Murattal"),
    ("banna", "Mahmoud Al-Banna", "Murattal"),
    ("fares_abbad", "Fares Abbad", "Murattal"),
    ("ghamadi", "Saad Al-Ghamadi", "Murattal"),
    ("hani_rifai", "Hani Ar-Rifai", "Murattal"),
    ("hudhaify", "Ali Al-Hudhaify", "Murattal"),
    ("husary", "Mahmoud Al-Husary", "Murattal"),
    ("husary_mujawwad", "Mahmoud Al-Husary", "Mujawwad"),
    ("hussary.teacher", "Al-Husary (Teacher)", "Teacher"),
    ("ibrahim_akhdar", "Ibrahim Al-Akhdar", "Murattal"),
    ("minshawy_mujawwad", "Mohamed Al-Minshawy", "Mujawwad"),
    ("minshawy_murattal", "Mohamed Al-Minshawy", "Murattal"),
    ("minshawy_teacher", "Al-Minshawy (Teacher)", "Teacher"),
    ("mostafa_ismail", "Mostafa Ismail", "Murattal"),
    ("muhammad_jibreel", "Muhammad Jibreel", "Murattal"),
    ("muhsin_al_qasim", "Muhsin Al-Qasim", "Murattal"),
    ("nasser_alqatami", "Nasser Al-Qatami", "Murattal"),
    ("saood_ash_shuraym", "Saood Ash-Shuraym", "Murattal"),
    ("tunaiji", "Khalifa Al-Tunaiji", "Murattal"),
    ("warsh_husary", "Al-Husary (Warsh)", "Warsh"),
    ("warsh_yassin", "Yassin Al-Jazairi (Warsh)", "Warsh"),
    ("yasser_ad_dussary", "Yasser Ad-Dussary", "Murattal"),
)
DEFAULT_RECITER = "alafasy"
# Textbook bands in counts.
BANDS = {
    "madd_2": (2.0, 2.0),
    "madd_muttasil": (4.0, 5.0),
    "madd_munfasil": (4.0, 5.0),
    "madd_6": (6.0, 6.0),
    "madd_6_muqattaat": (6.0, 12.0),
    "madd_246": (2.0, 6.0),
}
NASAL, NASAL_BAND, NASAL_SHARE = ("ghunnah", "idghaam_ghunnah", "ikhfa", "iqlab", "ikhfa_shafawi"), (1.3, 2.7), 0.55
# Rules without an upper side, with the floors under which a measurement isn't trusted in grading and in calibration.
LOWER_ONLY = {"madd_6": (1.0, 3.0), "madd_6_muqattaat": (1.0, 3.0), "madd_246": (0.3, 0.8)}
ADVISORY = ("madd_6_muqattaat",)
# Surahs that open with disjoint letters in their first verse; 42 also has them in its second.
DISJOINT_SURAHS = (2, 3, 7, 10, 11, 12, 13, 14, 15, 19, 20, 26, 27, 28, 29, 30, 31, 32, 36, 38, 40, 41, 42, 43, 44, 45, 46, 50, 68)
DISJOINT_EXTRA = (42, 2)
# Where each juz starts (surah, ayah).
JUZ_STARTS = (
    (1, 1), (2, 142), (2, 253), (3, 93), (4, 24), (4, 148), (5, 82), (6, 111), (7, 88), (8, 41),
    (9, 93), (11, 6), (12, 53), (15, 1), (17, 1), (18, 75), (21, 1), (23, 1), (25, 21), (27, 56),
    (29, 46), (33, 31), (36, 28), (39, 32), (41, 47), (46, 1), (51, 31), (58, 1), (67, 1), (78, 1),
)
# Surahs revealed in Medina.
MADANI = (2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("grp", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("nasal", T.BooleanType()),
        T.StructField("lower_only", T.BooleanType()),
        T.StructField("advisory", T.BooleanType()),
        T.StructField("reliable_floor", T.DoubleType()),
        T.StructField("calibration_floor", T.DoubleType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("nasal_share", T.DoubleType()),
    ]
)


def rules(spark: SparkSession) -> DataFrame:
    """A row per rule that can occur, the re-classed one included; no band where a rule isn't measured."""
    rows = []
    for key, label, group in [*RULES, ("madd_6_muqattaat", f"{LABELS['madd_6']} on disjoint letters", "madd")]:
        nasal = key in NASAL
        lo, hi = NASAL_BAND if nasal else BANDS.get(key, (None, None))
        floors = LOWER_ONLY.get(key, (None, 3.0))
        rows.append((key, label, group, DESCRIPTIONS.get(key, DESCRIPTIONS["madd_6"]), nasal, nasal or key in LOWER_ONLY, key in ADVISORY, floors[0], floors[1], lo, hi, NASAL_SHARE if nasal else None))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def reciters(spark: SparkSession) -> DataFrame:
    """The 30 reciters: reciter, name, style."""
    return spark.createDataFrame(RECITERS, "reciter string, name string, style string")


def with_reciter_names(rows: DataFrame, key: str = "reciter") -> DataFrame:
    """``rows`` with ``reciter_name``; a reciter that isn't in the dimension is named by its key, null stays null."""
    names = reciters(rows.sparkSession).select(F.col("reciter").alias("_k"), F.col("name").alias("reciter_name"))
    found = rows.join(F.broadcast(names), F.col(key) == F.col("_k"), "left").drop("_k")  # 30 rows
    return found.withColumn("reciter_name", F.coalesce("reciter_name", F.col(key)))


def rule_colour(rule):
    """Column: a rule's display colour, one default for any other."""
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, rule), F.lit(OTHER_COLOUR))


def effective_rule(rule, surah, ayah):
    """Column: a six-count prolongation on disjoint letters is a rule of its own."""
    disjoint = (surah.isin(*DISJOINT_SURAHS) & (ayah == 1)) | ((surah == DISJOINT_EXTRA[0]) & (ayah == DISJOINT_EXTRA[1]))
    return F.when((rule == "madd_6") & F.coalesce(disjoint, F.lit(False)), "madd_6_muqattaat").otherwise(rule)


def canonical_rule(name):
    """Column: trimmed, lower case, spaces and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), "[ -]", "_")


def revelation_place(surah):
    return F.when(surah.isin(*MADANI), "madani").otherwise("makki")


def bounds(starts: DataFrame, number: str, counts: DataFrame) -> DataFrame:
    """Ranges of verses from their starts: ``number``, start_surah, start_ayah, end_surah, end_ayah.

    A range ends a verse before the next starts, at the last verse of the surah before if that is a
    first verse; the last range at the last verse of the last surah. ``counts``: surah, ayah_count.
    """
    w = Window.orderBy(number)  # at most a few hundred ranges
    nxt = starts.withColumn("_s", F.lead("start_surah").over(w)).withColumn("_a", F.lead("start_ayah").over(w))
    last = counts.agg(F.max(F.struct("surah", "ayah_count")).alias("_last"))
    prev = counts.select((F.col("surah") + 1).alias("_s"), F.col("ayah_count").alias("_n"))
    j = nxt.join(F.broadcast(prev), "_s", "left").crossJoin(F.broadcast(last))  # a row per surah; one row
    first = F.col("_a") == 1
    return j.select(
        number, "start_surah", "start_ayah",
        F.when(F.col("_a").isNull(), F.col("_last.surah")).when(first, F.col("_s") - 1).otherwise(F.col("_s")).alias("end_surah"),
        F.when(F.col("_a").isNull(), F.col("_last.ayah_count")).when(first, F.col("_n")).otherwise(F.col("_a") - 1).alias("end_ayah"),
    )


def juz(spark: SparkSession, counts: DataFrame) -> DataFrame:
    starts = spark.createDataFrame([(i + 1, s, a) for i, (s, a) in enumerate(JUZ_STARTS)], "juz int, start_surah int, start_ayah int")
    return bounds(starts, "juz", counts)
