"""Audit, keys, duplicates, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions import keys
from tilth.operators import quality
from tilth.plans.tables import table
from tilth.sources import dimensions


def inventory_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select((F.col("o_custkey") + 20).alias("key"))
    return quality.missing_and_extra(c, o, ["key"])


def coverage_matrix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).where("o_totalprice > 300000")
    seen = o.select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority", F.year("o_orderdate").alias("year"))
    items = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"))
    return quality.coverage(table(spark, sf_dir, "nation"), items, seen, ["n_nationkey"], ["o_orderpriority", "year"])


def integrity_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = quality.integrity(F.col("n_chars"), F.when(F.col("doc_id") % 17 != 0, F.col("n_chars") - 300), F.col("doc_id") % 13 != 0, 50)
    return d.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def name_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 114 + 1).alias("s"), (F.col("c_custkey") % 286 + 1).alias("a"))
    six = F.concat(F.lpad(F.col("s").cast("string"), 3, "0"), F.lpad(F.col("a").cast("string"), 3, "0"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("take_"), six, F.lit(".wav"))).when(F.col("c_custkey") % 3 == 1, F.concat_ws("_", F.col("s").cast("string"), F.col("a").cast("string"))).otherwise(F.col("c_name"))
    c = c.withColumn("file", name)
    return c.select("c_custkey", "file", keys.key_of_digits(F.col("file")).alias("audit_key"), keys.key_of_recording(F.col("file")).alias("batch_key"))


def pattern_vote(spark, sf_dir):
    number = lambda m: F.lpad((F.col("page_id") % m + 1).cast("string"), 3, "0")
    p = table(spark, sf_dir, "pages")
    # a page's recording, named in one of three ways
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/"), number(114), number(200), F.lit(".mp3"))).when(F.col("page_id") % 3 == 1, F.concat(number(114), F.lit("/"), number(200), F.lit(".mp3"))).otherwise(F.col("url"))
    return keys.votes(p.select(url.alias("url")), "url")


def first_wins_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    return quality.first_wins(d, ["text_hash"], ["doc_id"])


def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return quality.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def precedence_merge(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    toxic = l.where("toxic = 1").select("doc_id", F.lit(0).alias("rank"), F.lit("toxic").alias("reason"))
    low = l.where("quality = 0").select("doc_id", F.lit(1).alias("rank"), F.lit("low_quality").alias("reason"))
    return quality.precedence(toxic.unionByName(low), ["doc_id"], "rank", "reason")


def index_rewrite(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    bad = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1")
    before = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_before"))
    after = quality.without(d, bad, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_after"))
    n = F.coalesce("n_after", F.lit(0)).cast("long")
    return before.join(after, "source", "left").select("source", "n_before", n.alias("n_after"), (F.lit(6236) - n).alias("n_missing"))


def map_enrich(spark, sf_dir):
    # the files of each verse as a map reciter -> path, then flat again without empty paths
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("verse"), "source", F.when(F.col("doc_id") % 7 != 0, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("path"))
    index = d.groupBy("verse", "source").agg(F.min("path").alias("path")).groupBy("verse").agg(F.map_from_entries(F.collect_list(F.struct("source", "path"))).alias("files"))
    return index.select("verse", F.explode("files").alias("source", "path")).where("path is not null and path <> ''")


def repair_worklist(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    missing = d.join(l, "doc_id", "left_anti").where("n_chars > 5000").select("source", "doc_id", F.lit("missing").alias("reason"))
    bad = d.join(l.where("quality = 0"), "doc_id", "left_semi").select("source", "doc_id", F.lit("low_quality").alias("reason"))
    short = d.where("n_chars < 20").select("source", "doc_id", F.lit("tiny").alias("reason"))
    return quality.worklist([missing, bad, short])


def dead_letter_split(spark, sf_dir):
    from tilth.sources.readers import split_lines

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("line"))
    good, bad = split_lines(e, "line", "k int")
    return good.groupBy(F.lit("good").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("record.k").alias("total")).unionByName(
        bad.groupBy(F.lit("bad").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("total"))
    )


def left_enrich(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(l, "doc_id", "left").withColumn("q", F.coalesce("quality", F.lit(0)))
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.sum("q").alias("n_good"), F.count_if((F.col("q") > 0) & (F.col("n_chars") > 0)).alias("n_kept")).withColumn("capped", F.col("n") - F.col("n_labelled") > 10)


def resume_work(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    done = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).where("o_totalprice > 485000").select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority")
    return n.crossJoin(F.broadcast(r)).join(done, ["n_nationkey", "o_orderpriority"], "left_anti")  # two dimensions: nations x priorities


def key_differences(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("key"))
    return p.subtract(l).withColumn("side", F.lit("unordered")).unionByName(l.subtract(p).withColumn("side", F.lit("unknown")))


def flag_update(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(False).alias("verified"), F.lit("toxic").alias("flag_reason"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(bad, "doc_id", "left")
    return d.select("doc_id", "source", F.col("verified"), "flag_reason", (~F.col("verified").eqNullSafe(False)).alias("shown"))


def hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return quality.per_group_sample(d, ["source"], (F.col("doc_id") * 48271) % 2147483647, 5, ["doc_id"])


def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return p.select(
        "page_id", keys.reciter_of(rel).alias("host"), keys.stem(F.col("url")).alias("stem"),
        keys.join_path(F.lit("https://cdn.example/"), F.regexp_extract(rel, "^[^/]*/(.*)$", 1)).alias("rebuilt"),
        F.regexp_extract("url", r"(\d+)", 1).try_cast("int").alias("first_number"),
    )


def reclass_floor(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    special = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size")).distinct()
    j = p.join(F.broadcast(special.withColumn("hit", F.lit(True))), "p_size", "left")  # at most 50 rows
    cls = F.when(F.col("hit") & (F.col("p_type") == "STANDARD"), "STANDARD_SUB").otherwise(F.col("p_type"))
    floor = F.when(cls == "STANDARD_SUB", 3.0).when(cls == "PROMO", 2.0).otherwise(1.0)
    return j.select("p_partkey", cls.alias("class"), floor.alias("floor"), F.col("p_type").isin("STANDARD", "PROMO", "SMALL").alias("lower_only"))


def vocabulary_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.initcap(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("raw"))
    rule = F.regexp_replace(F.lower(F.trim("raw")), "[ -]", "_")
    dim = spark.createDataFrame([("click", "Click", 1), ("view", "View", 1), ("purchase", "Purchase", 2)], "rule string, label string, grp int")
    j = e.withColumn("rule", rule).join(F.broadcast(dim), "rule", "left")
    return j.groupBy("rule", F.coalesce("label", F.lit("other")).alias("label"), F.col("grp").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))


def display_names(spark, sf_dir):
    """Events as plays of a reciter's verse with a rule: both by number, some outside the dimensions."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n).cast("int"))
    e = table(spark, sf_dir, "events").select(
        F.coalesce(pick([r[0] for r in dimensions.RECITERS], 33), F.lit("guest")).alias("reciter"), F.coalesce(pick(dimensions.COLOURS, 20), F.lit("other")).alias("rule")
    )
    named = dimensions.with_reciter_names(e.groupBy("reciter", "rule").agg(F.count(F.lit(1)).alias("n")))
    return named.select("reciter", "reciter_name", "rule", dimensions.rule_colour(F.col("rule")).alias("colour"), "n")


def nested_explode(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    nested = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "size"))).alias("turns"))
    return nested.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.turn", "t.role", "t.size")


def slot_counts(spark, sf_dir):
    # present keys per source with capped, sorted example lists
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    w = Window.partitionBy("source").orderBy("doc_id")
    top = d.withColumn("rn", F.row_number().over(w))
    return top.groupBy("source").agg(F.count(F.lit(1)).alias("n_present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("doc_id")))), ",").alias("examples"))


QUERIES = {
    f.__name__: f
    for f in (
        inventory_gaps, coverage_matrix, integrity_status, name_keys, pattern_vote, first_wins_dedup, upsert_last_wins, precedence_merge,
        index_rewrite, map_enrich, repair_worklist, dead_letter_split, left_enrich, resume_work, key_differences, flag_update, hash_sample,
        path_parts, reclass_floor, vocabulary_filter, display_names, nested_explode, slot_counts,
    )
}

SQL = {
    "inventory_gaps": """WITH o AS (SELECT o_custkey + 20 AS key FROM orders WHERE o_totalprice > 250000)
SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT key FROM o)
UNION ALL SELECT DISTINCT key, 'extra' FROM o WHERE key NOT IN (SELECT c_custkey FROM customer)""",
    "coverage_matrix": """WITH items AS (SELECT DISTINCT o_orderpriority p, year(o_orderdate) y FROM orders),
seen AS (SELECT DISTINCT c_nationkey k, o_orderpriority p, year(o_orderdate) y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000),
c AS (SELECT k, count(*) n FROM seen GROUP BY 1)
SELECT n_nationkey, coalesce(n, 0) AS n_present, (SELECT count(*) FROM items) - coalesce(n, 0) AS n_missing FROM nation LEFT JOIN c ON k = n_nationkey""",
    "integrity_status": """SELECT source, CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 50 THEN 'tiny' WHEN doc_id % 13 = 0 THEN 'unreadable'
WHEN doc_id % 17 = 0 THEN 'corrupt' WHEN n_chars - 300 <= 0 THEN 'zero_duration' ELSE 'ok' END AS status, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY 1, 2""",
    "name_keys": r"""WITH c AS (SELECT c_custkey, c_name, c_custkey % 114 + 1 AS s, c_custkey % 286 + 1 AS a FROM customer),
f AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'take_' || lpad(s::varchar, 3, '0') || lpad(a::varchar, 3, '0') || '.wav' WHEN 1 THEN s || '_' || a ELSE c_name END AS file FROM c),
g AS (SELECT *, regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '[^0-9]', '', 'g') AS digits FROM f)
SELECT c_custkey, file, CASE WHEN length(digits) = 6 AND try_cast(left(digits, 3) AS int) BETWEEN 1 AND 114 AND try_cast(right(digits, 3) AS int) >= 1
  THEN try_cast(left(digits, 3) AS int) || ':' || try_cast(right(digits, 3) AS int) END AS audit_key,
  CASE WHEN c_custkey % 3 IN (0, 1) THEN s || ':' || a END AS batch_key FROM g""",
    "pattern_vote": r"""WITH n AS (SELECT page_id % 3 AS k, url FROM pages),
v AS (SELECT 'concat_3_3' AS pattern, 0 AS o, count(*) FILTER (k = 0) AS hits FROM n UNION ALL SELECT 'folder', 1, count(*) FILTER (k = 1) FROM n)
SELECT pattern, hits FROM v WHERE hits > 0 ORDER BY hits DESC, o LIMIT 1""",
    "first_wins_dedup": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) - 1 AS n_duplicates FROM documents GROUP BY 1",
    "upsert_last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "precedence_merge": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END AS reason FROM labels WHERE toxic = 1 OR quality = 0",
    "index_rewrite": """SELECT source, count(*) AS n_before, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)) AS n_after,
6236 - count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)) AS n_missing FROM documents GROUP BY 1""",
    "map_enrich": """SELECT doc_id % 100 AS verse, source, min(CASE WHEN doc_id % 7 <> 0 THEN source || '/' || doc_id END) AS path FROM documents GROUP BY 1, 2
HAVING min(CASE WHEN doc_id % 7 <> 0 THEN source || '/' || doc_id END) IS NOT NULL""",
    "repair_worklist": """SELECT source, doc_id, 'missing' AS reason FROM documents WHERE n_chars > 5000 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT source, doc_id, 'low_quality' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT source, doc_id, 'tiny' FROM documents WHERE n_chars < 20""",
    "dead_letter_split": """WITH l AS (SELECT CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 3) ELSE props END AS line FROM events)
SELECT 'good' AS side, count(*) AS n, sum((line::json->>'k')::int)::bigint AS total FROM l WHERE json_valid(line) UNION ALL SELECT 'bad', count(*), NULL FROM l WHERE NOT json_valid(line)""",
    "left_enrich": """SELECT source, count(*) AS n, count(quality) AS n_labelled, sum(coalesce(quality, 0))::bigint AS n_good, count(*) FILTER (coalesce(quality, 0) > 0 AND n_chars > 0) AS n_kept,
count(*) - count(quality) > 10 AS capped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "resume_work": """SELECT n_nationkey, p.o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority FROM orders) p
WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 485000 AND c_nationkey = n_nationkey AND o.o_orderpriority = p.o_orderpriority)""",
    "key_differences": """SELECT p_partkey AS key, 'unordered' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)
UNION ALL SELECT DISTINCT l_partkey, 'unknown' FROM lineitem WHERE l_quantity > 48 AND l_partkey NOT IN (SELECT p_partkey FROM part)""",
    "flag_update": """SELECT d.doc_id, source, CASE WHEN toxic = 1 THEN false END AS verified, CASE WHEN toxic = 1 THEN 'toxic' END AS flag_reason, coalesce(toxic, 0) <> 1 AS shown
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "hash_sample": "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 48271) % 2147483647, doc_id) AS rn FROM documents) WHERE rn <= 5",
    "path_parts": r"""WITH p AS (SELECT *, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages)
SELECT page_id, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE '_root' END AS host, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem,
CASE WHEN length(regexp_extract(rel, '^[^/]*/(.*)$', 1)) > 0 THEN 'https://cdn.example/' || regexp_extract(rel, '^[^/]*/(.*)$', 1) END AS rebuilt,
try_cast(regexp_extract(url, '(\d+)', 1) AS int) AS first_number FROM pages JOIN p USING (page_id, url, html)""",
    "reclass_floor": """WITH s AS (SELECT DISTINCT s_suppkey % 50 + 1 AS z FROM supplier WHERE s_acctbal < 0),
c AS (SELECT *, CASE WHEN p_type = 'STANDARD' AND p_size IN (SELECT z FROM s) THEN 'STANDARD_SUB' ELSE p_type END AS class FROM part)
SELECT p_partkey, class, CASE class WHEN 'STANDARD_SUB' THEN 3.0 WHEN 'PROMO' THEN 2.0 ELSE 1.0 END::double AS floor, p_type IN ('STANDARD','PROMO','SMALL') AS lower_only FROM c""",
    "vocabulary_filter": """SELECT event_type AS rule, CASE WHEN event_type IN ('click','view','purchase') THEN upper(left(event_type, 1)) || substr(event_type, 2) ELSE 'other' END AS label,
event_type IN ('click','view','purchase') AS known, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "display_names": """WITH r AS (SELECT * FROM (VALUES
    (0, 'abdul_basit_murattal', 'Abdul Basit Murattal'), (1, 'abdullaah_3awwaad_al_juhaynee', 'Abdullaah Awwaad Al-Juhaynee'), (2, 'abdullah_basfar', 'Abdullah Basfar'),
    (3, 'abdulsamad', 'Abdul Samad'), (4, 'abdurrahmaan_as_sudais', 'Abdurrahmaan As-Sudais'), (5, 'abu_bakr_ash_shaatree', 'Abu Bakr Ash-Shaatree'),
    (6, 'alafasy', 'Mishary Alafasy'), (7, 'ali_jaber', 'Ali Jaber'), (8, 'ayman_sowaid', 'Ayman Sowaid'),
    (9, 'banna', 'Mahmoud Al-Banna'), (10, 'fares_abbad', 'Fares Abbad'), (11, 'ghamadi', 'Saad Al-Ghamadi'),
    (12, 'hani_rifai', 'Hani Ar-Rifai'), (13, 'hudhaify', 'Ali Al-Hudhaify'), (14, 'husary', 'Mahmoud Al-Husary'),
    (15, 'husary_mujawwad', 'Mahmoud Al-Husary'), (16, 'hussary.teacher', 'Al-Husary (Teacher)'), (17, 'ibrahim_akhdar', 'Ibrahim Al-Akhdar'),
    (18, 'minshawy_mujawwad', 'Mohamed Al-Minshawy'), (19, 'minshawy_murattal', 'Mohamed Al-Minshawy'), (20, 'minshawy_teacher', 'Al-Minshawy (Teacher)'),
    (21, 'mostafa_ismail', 'Mostafa Ismail'), (22, 'muhammad_jibreel', 'Muhammad Jibreel'), (23, 'muhsin_al_qasim', 'Muhsin Al-Qasim'),
    (24, 'nasser_alqatami', 'Nasser Al-Qatami'), (25, 'saood_ash_shuraym', 'Saood Ash-Shuraym'), (26, 'tunaiji', 'Khalifa Al-Tunaiji'),
    (27, 'warsh_husary', 'Al-Husary (Warsh)'), (28, 'warsh_yassin', 'Yassin Al-Jazairi (Warsh)'), (29, 'yasser_ad_dussary', 'Yasser Ad-Dussary')) t(i, k, name)),
c AS (SELECT * FROM (VALUES
    (0, 'madd_2', '#E8A33D'), (1, 'madd_246', '#F2C14E'), (2, 'madd_6', '#E5392B'),
    (3, 'madd_munfasil', '#F58B3C'), (4, 'madd_muttasil', '#E5662E'), (5, 'ghunnah', '#1E9E8A'),
    (6, 'idghaam_ghunnah', '#2BB673'), (7, 'idghaam_no_ghunnah', '#7FB069'), (8, 'idghaam_shafawi', '#4C9A7A'),
    (9, 'idghaam_mutajanisayn', '#5FA8A0'), (10, 'idghaam_mutaqaribayn', '#6FB3AB'), (11, 'ikhfa', '#3E78B2'),
    (12, 'ikhfa_shafawi', '#5B8FD6'), (13, 'iqlab', '#7E57C2'), (14, 'qalqalah', '#C2407A'),
    (15, 'hamzat_wasl', '#9AA0A6'), (16, 'lam_shamsiyyah', '#B0883B'), (17, 'silent', '#C4C7CC')) t(i, rule, colour))
SELECT coalesce(r.k, 'guest') AS reciter, coalesce(r.name, 'guest') AS reciter_name, coalesce(c.rule, 'other') AS rule, coalesce(c.colour, '#C9A227') AS colour, count(*) AS n
FROM events LEFT JOIN r ON r.i = event_id % 33 LEFT JOIN c ON c.i = event_id % 20 GROUP BY 1, 2, 3, 4""",
    "nested_explode": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1)::int AS pos, turn, role, length(text)::int AS size FROM conversations",
    "slot_counts": """SELECT source, count(*) AS n_present, string_agg(CASE WHEN rn <= 3 THEN doc_id::varchar END, ',' ORDER BY doc_id) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""",
}
