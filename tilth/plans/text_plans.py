"""Text: normalisation, words, error rates, search, locating, word verdicts, spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions import alignment, scalars, text
from tilth.operators import intervals, locate, scoring, trigrams
from tilth.plans.tables import micros, table
from tilth.sources import shared

ACCENTED, PLAIN = "ÀÂÄÇÉÈÊËÎÏÍÑÔÖÓÙÛÜÚàâäçéèêëîïíñôöóùûüúá", "AAACEEEEIIINOOOUUUUaaaceeeeiiinooouuuua"


def slice_words(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    spans = b.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(7))).alias("start")).withColumn("end", F.col("start") + 5)
    return spans.select("item_id", "start", text.slice_text(F.col("text"), F.col("start"), F.col("end")).alias("segment"), text.enclosing_word(F.col("text"), F.col("start"), F.col("end")).alias("word"))


def normalize_text(spark, sf_dir):
    n = text.normalize(F.col("text"), ACCENTED, PLAIN)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(n, 256).alias("normal_hash"), F.length(n).alias("normal_length"))


def word_offsets(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.words(F.col("text"))).alias("pos", "w"))
    return w.select("item_id", "pos", "w.word", "w.start", "w.end")


def _ascii(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("t"))


def error_rate(spark, sf_dir):
    a = _ascii(spark, sf_dir)
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    rate = text.error_rate(F.col("t"), F.col("u"))
    return a.join(b, "item_id").select("item_id", F.round(rate, 9).alias("cer"), F.when(rate > 0.75, "mismatch").otherwise("ok").alias("content"))


def _name_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))  # each name beside the next part's
    return n.join(n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey").select("a", "b").distinct()


def semi_global_fit(spark, sf_dir):
    p, s = text.prefix_fit(F.col("a"), F.col("b")), text.suffix_fit(F.col("a"), F.col("b"))
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(p, 9).alias("prefix"), F.round(s, 9).alias("suffix"))


def bigram_overlap(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", text.bag_overlap(text.bigrams(F.col("a")), text.bigrams(F.col("b"))).alias("overlap"))


def locate_span(spark, sf_dir):
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    verses = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), text.letters_only(ascii_text).alias("letters"))
    clips = verses.select("conv_id", F.col("pos").alias("clip"), F.when(F.col("pos") % 2 == 0, F.col("pos")).alias("near"), F.substring("letters", 5, 60).alias("decoded"))
    return locate.locate(clips, verses, ["conv_id"])


def word_verdicts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    words = word_offsets(spark, sf_dir).withColumnsRenamed({"start": "w0", "end": "w1"})
    rules = b.select("item_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(9))).alias("r0")).select("item_id", "r0", (F.col("r0") + 3).alias("r1"), (F.floor(F.col("r0") / 9) % 3 == 0).alias("warn"))
    hits = intervals.overlap_join(rules, words, ["item_id"], ("r0", "r1"), ("w0", "w1")).groupBy("item_id", "pos").agg(F.bool_or("warn").alias("any_warn"), F.count(F.lit(1)).alias("n_rules"))
    j = words.join(hits, ["item_id", "pos"], "left")
    return j.select("item_id", "pos", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), scoring.verdict(F.length("word") <= 6, F.coalesce("any_warn", F.lit(False))).alias("verdict"))


def traceback_match(spark, sf_dir):
    p = _name_pairs(spark, sf_dir)
    region = alignment.region_udf("a", "b")
    letters, first = F.replace("b", F.lit(" "), F.lit("")), F.length(F.substring_index("b", " ", 1))
    ratios = alignment.word_ratios_udf(F.replace("a", F.lit(" "), F.lit("")), letters, F.array(F.lit(0), first), F.array(first, F.length(letters)))
    matched = F.array_join(F.transform(alignment.matched_udf("a", "b"), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    found = p.select("a", "b", matched.alias("matched"), region.alias("r"), ratios.alias("w"))
    share = lambda i: F.round(F.get("w", F.lit(i)), 9)
    return found.select("a", "b", "matched", "r.start", "r.end", share(0).alias("first_ratio"), share(1).alias("second_ratio"))


def word_ratio_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(text.words(F.col("text")), lambda w: w["word"]).alias("ws"))
    ends = F.transform("ws", lambda _, i: F.aggregate(F.slice("ws", F.lit(1), i + 1), F.lit(0), lambda acc, w: acc + F.length(w)))
    c = c.select("conv_id", "turn", "ws", ends.alias("ends"), F.array_join("ws", "").alias("ref"))
    starts = F.zip_with("ends", "ws", lambda e, w: e - F.length(w))
    decoded = F.concat(F.left("ref", (F.length("ref") / 3).cast("int")), F.right("ref", (F.length("ref") / 4).cast("int")))
    r = c.select("conv_id", "turn", alignment.word_ratios_udf(decoded, F.col("ref"), starts, F.col("ends")).alias("ratios"))
    graded = F.filter("ratios", lambda x: x.isNotNull())
    return r.select("conv_id", "turn", F.size(graded).alias("n_graded"), F.size(F.filter(graded, lambda x: x >= 0.6)).alias("n_ok"))


def hidden_energy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("signal"))
    return e.select("vec_id", F.round(alignment.low_share_udf(16_000.0)("signal"), 9).alias("low_share"))


def uniform_spans(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("double").alias("duration"), F.posexplode(F.split("text", "")).alias("pos", "c")).where("c <> ''")
    letter = F.col("c").rlike("[A-Za-z]")
    w = Window.partitionBy("item_id").orderBy("pos")
    k = b.withColumn("letter", letter).withColumn("k", F.sum(F.col("letter").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("n", F.sum(F.col("letter").cast("int")).over(Window.partitionBy("item_id")))
    at = lambda x: F.when(F.col("letter"), F.round(x * F.col("duration") / F.col("n"), 6))
    return k.select("item_id", "pos", at(F.col("k")).alias("t0"), at(F.col("k") + 1).alias("t1"))


def letter_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text"), ACCENTED, PLAIN).alias("n"))
    prefix = F.col("n").rlike("^[^ ]+ [^ ]+ [^ ]+ [^ ]+ ")
    rest = F.when(prefix & (F.col("doc_id") != 1), F.regexp_replace("n", "^[^ ]+ [^ ]+ [^ ]+ [^ ]+ ", "")).otherwise(F.col("n"))
    return d.select("doc_id", F.length(F.regexp_replace(rest, " ", "")).alias("letters"), F.col("n").rlike("^[THEANDOFthendof]{1,6}$").alias("disjoint"), F.when(F.col("doc_id").isin(2, 3, 5, 8, 13), "madani").otherwise("makki").alias("place"))


def formatting(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", micros("o_orderdate")).withColumn("next", F.col("at") + F.col("o_custkey") * 3_600_000_000 * 7)
    day = F.to_date("o_orderdate")
    s, a = F.col("o_orderkey") % 114 + 1, F.col("o_custkey") % 286 + 1
    return o.select(
        "o_orderkey", scalars.pad_key(s, a).alias("padded"), scalars.eastern_digits(scalars.colon_key(s, a)).alias("eastern"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        scalars.hours_until(F.col("at"), F.col("next")).alias("hours"), scalars.days_until_label(F.col("at"), F.col("next")).alias("due"), scalars.weekday_letter(day).alias("weekday"),
    )


def name_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    hit = (F.col("c_custkey") == 42) | F.lower("c_name").contains("0077") | F.contains(F.lower(F.translate("n_name", "Éé", "Ee")), F.lit("ni"))
    return c.where(hit).orderBy("c_custkey").limit(6).select("c_custkey", "c_name", "n_name")


def text_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"n1": text.escape_like(F.lit("the_ab")), "n2": text.escape_like(F.lit("thing"))})
    return d.where(F.expr("ilike(text, concat('%', n1, '%')) or ilike(text, concat('%', n2, '%'))")).orderBy("doc_id").limit(50).select("doc_id", "lang")


def trigram_search(spark, sf_dir):
    # through an index of whole texts, made for the query
    path = shared.new_path(spark, "trigrams")
    trigrams.build(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"], ["text"], path)
    found = [trigrams.search(spark, path, ["doc_id"], ["text"], q).select("doc_id", "lang", F.lit(q).alias("query")) for q in ("Lizenz", "password", "thing", "o_u")]
    return reduce(DataFrame.unionByName, found)


def jump_intents(spark, sf_dir):
    u = table(spark, sf_dir, "pages")
    q = F.when(F.col("page_id") % 3 == 0, F.concat((F.col("page_id") % 114 + 1).cast("string"), F.lit(":"), (F.col("page_id") % 7 + 1).cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("juz "), (F.col("page_id") % 30 + 1).cast("string"))).otherwise(F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    verse = r"^\s*(\d{1,3})\s*:\s*(\d{1,3})\s*$"
    kind = F.when(q.rlike(verse), "verse").when(q.rlike(r"(?i)^\s*juz\s+\d+\s*$"), "juz").when(q.rlike(r"(?i)^\s*page\s+\d+\s*$"), "page")
    return u.select("page_id", q.alias("query"), kind.alias("kind"), F.regexp_extract(q, r"(\d+)", 1).try_cast("int").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        slice_words, normalize_text, word_offsets, error_rate, semi_global_fit, bigram_overlap, locate_span, word_verdicts, traceback_match,
        word_ratio_scores, hidden_energy, uniform_spans, letter_counts, formatting, name_search, text_search, trigram_search, jump_intents,
    )
}

_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{08D3}-\x{08FF}\x{0640}]"
_NORMAL = (
    f"trim(regexp_replace(translate(regexp_replace(text, '{_MARKS}', '', 'g'), '" + text.LETTERS_FROM + ACCENTED + "', '" + text.LETTERS_TO + PLAIN + r"'), '[\s\x{0B}]+', ' ', 'g'))"
)
_WORDS = r"""p AS (SELECT item_id, generate_subscripts(string_split_regex(text, '\s'), 1) AS k, unnest(string_split_regex(text, '\s')) AS word FROM benchmark),
o AS (SELECT item_id, word, k, coalesce(sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS s FROM p),
w AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY k) - 1)::int AS pos, word, s AS w0, (s + length(word))::int AS w1 FROM o WHERE word <> '')"""
_PAIRS = "n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


def _back(pairs: str, name: str, free_start: bool) -> str:
    """CTEs: the way back through the edit distances of ``pairs`` (h, r): diagonal, then deletion, then insertion."""
    if free_start:
        d = lambda i, j: f"list_min(list_transform(range(0, {j} + 1), lambda k: levenshtein(left(h, {i}), substr(r, k + 1, {j} - k))))"
        end = f"length(r) - list_position(list_transform(range(0, length(r) + 1), lambda x: {d('length(h)', 'length(r) - x')}), list_min(list_transform(range(0, length(r) + 1), lambda x: {d('length(h)', 'length(r) - x')}))) + 1"
    else:
        d = lambda i, j: f"levenshtein(left(h, {i}), left(r, {j}))"
        end = "length(r)"
    same = "substr(h, i, 1) = substr(r, j, 1)"
    return f"""{name} AS (SELECT h, r, length(h)::int AS i, ({end})::int AS j, NULL::int AS hit, 0 AS n FROM {pairs} UNION ALL
SELECT h, r, CASE WHEN move = 'left' THEN i ELSE i - 1 END, CASE WHEN move = 'up' THEN j ELSE j - 1 END, CASE WHEN move = 'both' AND {same} THEN j - 1 END, n + 1
FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND {d('i', 'j')} = {d('i - 1', 'j - 1')} + ({same})::int * -1 + 1 THEN 'both'
WHEN j > 0 AND {d('i', 'j')} = {d('i', 'j - 1')} + 1 THEN 'left' ELSE 'up' END AS move FROM {name} WHERE i > 0{'' if free_start else ' OR j > 0'}))"""


_FIT = "list_min(list_transform(range(0, least(length(run), 2 * length(decoded)) + 1), lambda k: levenshtein({}, left({}, k))))"
SQL = {
    "slice_words": r"""WITH s AS (SELECT item_id, text, unnest(range(0, 41, 7))::int AS s FROM benchmark)
SELECT item_id, s AS start, substr(text, s + 1, 5) AS segment, regexp_extract(left(text, s), '([^ ]*)$', 1) || substr(text, s + 1, 5) || regexp_extract(substr(text, s + 6), '^([^ ]*)', 1) AS word FROM s""",
    "normalize_text": f"SELECT doc_id, sha256({_NORMAL}) AS normal_hash, length({_NORMAL})::int AS normal_length FROM documents",
    "word_offsets": f'WITH {_WORDS} SELECT item_id, pos, word, w0 AS start, w1 AS "end" FROM w',
    "error_rate": r"""WITH a AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM benchmark),
r AS (SELECT a.item_id, CASE WHEN length(b.t) = 0 THEN CASE WHEN length(a.t) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(a.t, b.t) / length(b.t)::double END AS r FROM a JOIN a b ON b.item_id = a.item_id + 1)
SELECT item_id, round(r, 9) AS cer, CASE WHEN r > 0.75 THEN 'mismatch' ELSE 'ok' END AS content FROM r""",
    "semi_global_fit": f"""WITH {_PAIRS} SELECT a, b, round(list_min(list_transform(range(0, length(b) + 1), lambda k: levenshtein(a, left(b, k)))) / length(a)::double, 9) AS prefix,
round(list_min(list_transform(range(0, length(b) + 1), lambda k: levenshtein(reverse(a), left(reverse(b), k)))) / length(a)::double, 9) AS suffix FROM q""",
    "bigram_overlap": f"""WITH {_PAIRS}, g AS (SELECT name, substr(name, i, 2) AS g, count(*) AS c FROM n, range(1, 100) t(i) WHERE i < greatest(length(name), 2) GROUP BY 1, 2)
SELECT a, b, coalesce(sum(CASE WHEN y.c IS NOT NULL THEN least(x.c, y.c) END), 0)::int AS overlap FROM q LEFT JOIN g x ON x.name = a LEFT JOIN g y ON y.name = b AND y.g = x.g GROUP BY 1, 2""",
    "traceback_match": f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT *, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y, length(split_part(b, ' ', 1))::int AS w FROM q),
spans AS (SELECT a AS h, b AS r FROM l UNION SELECT x, y FROM l), {_back("spans", "free", True)},
region AS (SELECT h, r, min(j) AS lo, greatest(min(j), max(j) - 1) AS hi FROM free GROUP BY 1, 2),
c AS (SELECT l.*, greatest(0, lo - 4) AS lo, least(length(y), hi + 5)::int AS hi FROM l JOIN region ON h = x AND r = y),
whole AS (SELECT a AS h, b AS r FROM c UNION SELECT x, substr(y, lo + 1, hi - lo) FROM c), {_back("whole", "fixed", False)},
hits AS (SELECT h, r, hit AS spot, i AS place FROM fixed WHERE hit IS NOT NULL),
m AS (SELECT a, b, string_agg(coalesce(place::varchar, '-'), ',' ORDER BY k) AS matched FROM (SELECT a, b, unnest(range(length(b)))::int AS k FROM q) LEFT JOIN hits ON h = a AND r = b AND spot = k GROUP BY 1, 2),
e AS (SELECT c.*, 1 AS nth, 0 AS s, w AS t FROM c UNION ALL SELECT c.*, 2, w, length(y)::int FROM c),
g AS (SELECT a, b, nth, any_value(s) AS s, any_value(t) AS t, any_value(lo) AS lo, any_value(hi) AS hi, count(place) AS n, max(place) - min(place) + 1 - count(place) AS gap
FROM e LEFT JOIN hits ON h = x AND r = substr(y, lo + 1, hi - lo) AND spot + lo >= s AND spot + lo < t GROUP BY 1, 2, 3),
v AS (SELECT a, b, nth, CASE WHEN t <= lo OR s >= hi THEN NULL WHEN s = t THEN 1.0 WHEN n = 0 OR gap > 1 THEN 0.0 ELSE round(n::double / (t - s), 9) END AS v FROM g)
SELECT m.a, m.b, matched, region.lo AS start, region.hi AS "end", v1.v AS first_ratio, v2.v AS second_ratio FROM m JOIN region ON region.h = m.a AND region.r = m.b
JOIN v v1 ON v1.a = m.a AND v1.b = m.b AND v1.nth = 1 JOIN v v2 ON v2.a = m.a AND v2.b = m.b AND v2.nth = 2""",
    "locate_span": rf"""WITH v AS (SELECT conv_id, turn::int AS pos, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[\s\x{{0B}}]', '', 'g') AS letters FROM conversations),
c AS (SELECT conv_id, pos AS clip, CASE WHEN pos % 2 = 0 THEN pos END AS near, substr(letters, 5, 60) AS decoded FROM v),
runs AS (SELECT x.conv_id, x.pos AS i, y.pos AS j, string_agg(z.letters, '' ORDER BY z.pos) AS run FROM v x JOIN v y ON y.conv_id = x.conv_id AND y.pos BETWEEN x.pos AND x.pos + 5
JOIN v z ON z.conv_id = x.conv_id AND z.pos BETWEEN x.pos AND y.pos GROUP BY 1, 2, 3),
p AS (SELECT c.*, i, j, run, (floor(length(decoded) * 1.3) + 5)::int AS cap FROM c JOIN runs USING (conv_id) WHERE length(decoded) > 0),
sides AS (SELECT conv_id, clip, i, j, side, unnest(list_transform(range(1, greatest(length(t), 2)), lambda k: substr(t, k, 2))) AS g
FROM (SELECT conv_id, clip, i, j, 'head' AS side, left(run, cap) AS t FROM p UNION ALL SELECT conv_id, clip, i, j, 'tail', right(run, cap) FROM p) WHERE t <> ''),
own AS (SELECT conv_id, clip, g, count(*) AS n FROM (SELECT conv_id, clip, unnest(list_transform(range(1, greatest(length(decoded), 2)), lambda k: substr(decoded, k, 2))) AS g FROM c WHERE decoded <> '') GROUP BY 1, 2, 3),
bags AS (SELECT conv_id, clip, i, j, side, g, count(*) AS n FROM sides GROUP BY ALL),
met AS (SELECT conv_id, clip, i, j, max(n) AS shared FROM (SELECT bags.conv_id, bags.clip, i, j, side, sum(least(bags.n, own.n)) AS n FROM bags JOIN own ON own.conv_id = bags.conv_id AND own.clip = bags.clip AND own.g = bags.g GROUP BY ALL) GROUP BY ALL),
kinds AS (SELECT conv_id, clip, count(*) AS n FROM own GROUP BY ALL),
scored AS (SELECT p.*, row_number() OVER (PARTITION BY p.conv_id, p.clip ORDER BY coalesce(shared, 0)::double / greatest(kinds.n, least(length(run), cap), 1) DESC, p.i, p.j) AS place
FROM p JOIN kinds ON kinds.conv_id = p.conv_id AND kinds.clip = p.clip LEFT JOIN met ON met.conv_id = p.conv_id AND met.clip = p.clip AND met.i = p.i AND met.j = p.j),
f AS (SELECT conv_id, clip, near, i, j, least({_FIT.format("decoded", "run")}, {_FIT.format("reverse(decoded)", "reverse(run)")}) / length(decoded)::double AS cer FROM scored WHERE place <= 6 OR length(decoded) < 12),
u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f n WHERE n.conv_id = f.conv_id AND n.clip = f.clip AND n.cer <= f.cer + 1e-9 AND n.i >= f.i AND n.j <= f.j AND n.j - n.i < f.j - f.i)),
w AS (SELECT *, min(cer) OVER (PARTITION BY conv_id, clip) AS low FROM u)
SELECT conv_id, clip, i AS "from", j AS "to", cer FROM w WHERE low <= 0.75 AND cer <= low + CASE WHEN near IS NULL THEN 0 ELSE 0.05 END
QUALIFY row_number() OVER (PARTITION BY conv_id, clip ORDER BY coalesce(abs(i - near), 0), cer, i, j) = 1""",
    "word_verdicts": f"""WITH {_WORDS}, r AS (SELECT item_id, unnest(range(0, length(text), 9)) AS r0 FROM benchmark),
h AS (SELECT w.item_id, w.pos, bool_or((r0 // 9) % 3 = 0) AS warn, count(*) AS n FROM w JOIN r ON r.item_id = w.item_id AND r0 < w1 AND r0 + 3 > w0 GROUP BY 1, 2)
SELECT w.item_id, w.pos, coalesce(n, 0) AS n_rules, CASE WHEN length(word) > 6 THEN 'red' WHEN coalesce(warn, false) THEN 'yellow' ELSE 'green' END AS verdict FROM w LEFT JOIN h ON h.item_id = w.item_id AND h.pos = w.pos""",
    "uniform_spans": """WITH c AS (SELECT item_id, length(text) AS d, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS c FROM benchmark),
l AS (SELECT *, regexp_matches(c, '[A-Za-z]') AS l FROM c WHERE c <> ''),
k AS (SELECT *, sum(l::int) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS k, sum(l::int) OVER (PARTITION BY item_id) AS n FROM l)
SELECT item_id, pos::int AS pos, CASE WHEN l THEN round(k::double * d / n, 6) END AS t0, CASE WHEN l THEN round((k + 1)::double * d / n, 6) END AS t1 FROM k""",
    "letter_counts": f"""WITH d AS (SELECT doc_id, {_NORMAL} AS n FROM documents)
SELECT doc_id, length(regexp_replace(CASE WHEN doc_id <> 1 THEN regexp_replace(n, '^[^ ]+ [^ ]+ [^ ]+ [^ ]+ ', '') ELSE n END, ' ', '', 'g'))::int AS letters,
regexp_matches(n, '^[THEANDOFthendof]{{1,6}}$') AS disjoint, CASE WHEN doc_id IN (2, 3, 5, 8, 13) THEN 'madani' ELSE 'makki' END AS place FROM d""",
    "formatting": """WITH o AS (SELECT *, o_orderkey % 114 + 1 AS s, o_custkey % 286 + 1 AS a FROM orders)
SELECT o_orderkey, lpad(s::varchar, 3, '0') || lpad(a::varchar, 3, '0') AS padded, translate(s || ':' || a, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS eastern, datediff('day', DATE '1995-01-01', o_orderdate::date)::int AS days,
greatest(1, floor(o_custkey * 7 + 0.5)::bigint) AS hours, CASE WHEN ceil(o_custkey * 7 / 24) <= 0 THEN 'due now' ELSE ceil(o_custkey * 7 / 24)::bigint || 'd' END AS due, substr('SMTWTFS', dayofweek(o_orderdate)::int + 1, 1) AS weekday FROM o""",
    "name_search": """SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 42 OR lower(c_name) LIKE '%0077%' OR lower(translate(n_name, 'Éé', 'Ee')) LIKE '%ni%' ORDER BY c_custkey LIMIT 6""",
    "trigram_search": r"""SELECT doc_id, lang, q AS query FROM documents JOIN (VALUES ('Lizenz', '%Lizenz%'), ('password', '%password%'), ('thing', '%thing%'), ('o_u', '%o\_u%')) v(q, p) ON text ILIKE p ESCAPE '\'""",
    "text_search": r"SELECT doc_id, lang FROM documents WHERE text ILIKE '%the\_ab%' ESCAPE '\' OR text ILIKE '%thing%' ORDER BY doc_id LIMIT 50",
    "hidden_energy": """WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS n, unnest(embedding)::double AS x, len(embedding) AS size FROM embeddings),
w AS (SELECT vec_id, n, size, x * (0.5 - 0.5 * cos(2 * pi() * n / (size - 1))) AS x FROM s WHERE size >= 32),
m AS (SELECT vec_id, k, any_value(size) AS size, sqrt(pow(sum(x * cos(2 * pi() * k * n / size)), 2) + pow(sum(x * sin(2 * pi() * k * n / size)), 2)) AS m FROM w, range(1000) t(k) WHERE k <= size // 2 GROUP BY 1, 2)
SELECT vec_id, round(coalesce(sum(m) FILTER (k * 16000.0 / size < 1000), 0) / sum(m), 9) AS low_share FROM m GROUP BY 1""",
    "jump_intents": r"""WITH q AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN (page_id % 114 + 1) || ':' || (page_id % 7 + 1) WHEN 1 THEN 'juz ' || (page_id % 30 + 1) ELSE 'Page ' || page_id END AS q FROM pages)
SELECT page_id, q AS query, CASE page_id % 3 WHEN 0 THEN 'verse' WHEN 1 THEN 'juz' ELSE 'page' END AS kind, try_cast(regexp_extract(q, '(\d+)', 1) AS int) AS first FROM q""",
}
