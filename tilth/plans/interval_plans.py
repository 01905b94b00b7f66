"""Ranges, as-of lookups, interval joins, runs and ordered reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.operators import intervals
from tilth.plans.tables import micros, table

DAY = 86_400_000_000


def range_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    nxt = intervals.next_boundary(o, ["o_custkey"], ["start", "o_orderkey"], "start")
    return nxt.select("o_custkey", "o_orderkey", "start", F.coalesce(F.date_sub("next_start", 1), F.lit("1999-12-31").cast("date")).alias("end"))


def page_bounds(spark, sf_dir):
    # a range ends where the next begins; if that is a group's first row, at the end of the group before
    l = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    w = Window.partitionBy((F.col("conv_id") / 50).cast("long")).orderBy("conv_id", "turn")
    nxt = l.withColumn("nc", F.lead("conv_id").over(w)).withColumn("nt", F.lead("turn").over(w)).join(last, "conv_id")
    return nxt.select("conv_id", "turn", F.when((F.col("nc") == F.col("conv_id")) & (F.col("nt") > 0), F.col("nt") - 1).otherwise(F.col("n")).alias("end_turn"))


def lexi_range(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    inside = intervals.lexicographic_between([F.col("l_orderkey"), F.col("l_linenumber")], [100, 3], [140, 5])
    return l.where(inside).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def lexi_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") / 40).cast("long").alias("page"))
    first, last = F.min(F.struct("l_orderkey", "l_linenumber")), F.max(F.struct("l_orderkey", "l_linenumber"))
    pages = l.agg(first.alias("p0"), last.alias("p1"))
    chapters = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") / 70).cast("long").alias("chapter")).agg(first.alias("c0"), last.alias("c1"))
    # both sides are small dimensions; the blocks of 280 orders they fall in are the equi key
    blocks = lambda s, e: F.explode(F.sequence(F.floor(s["l_orderkey"] / 280), F.floor(e["l_orderkey"] / 280)))
    j = pages.withColumn("block", blocks(F.col("p0"), F.col("p1"))).join(chapters.withColumn("block", blocks(F.col("c0"), F.col("c1"))), "block")
    return j.where(intervals.lexicographic_overlap(F.col("p0"), F.col("p1"), F.col("c0"), F.col("c1"))).select("page", "chapter").distinct()


def asof_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    buys = e.where("event_type = 'purchase'").select("user_id", "at", "event_id", "value")
    signups = e.where("event_type = 'signup'").groupBy("user_id", "at").agg(F.max("event_id").alias("signup_id"))
    return intervals.asof_join(buys, signups, ["user_id"], "at", "signup_id", "signup_id", F.floor(F.col("at") / (7 * DAY)))


def carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts")).withColumn("marker", F.when(F.col("event_type") == "error", F.col("value")))
    return intervals.carry_forward(e.select("user_id", "event_id", "at", "marker"), ["user_id"], ["at", "event_id"], "marker", "carried", F.floor(F.col("at") / (7 * DAY)), inclusive=False).select("user_id", "event_id", "carried")


def _spans(spark, sf_dir, kind, width, names):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind).withColumn("at", micros("ts"))
    return e.select("user_id", F.col("event_id").alias(names[0]), F.col("at").alias(names[1]), (F.col("at") + width).alias(names[2]))


def interval_overlap(spark, sf_dir):
    a = _spans(spark, sf_dir, "view", 3_600_000_000, ("view_id", "v0", "v1"))
    b = _spans(spark, sf_dir, "click", 7_200_000_000, ("click_id", "c0", "c1"))
    return intervals.overlap_join(a, b, ["user_id"], ("v0", "v1"), ("c0", "c1"), bin_width=DAY).select("user_id", "view_id", "click_id")


def contained_spans(spark, sf_dir):
    a = _spans(spark, sf_dir, "view", 3_600_000_000, ("view_id", "v0", "v1"))
    b = _spans(spark, sf_dir, "signup", 43_200_000_000, ("signup_id", "s0", "s1"))
    found = intervals.contained_join(a, b, ["user_id"], ("v0", "v1"), ("s0", "s1"))
    return found.groupBy("user_id", "signup_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("v0") - F.col("s0")).alias("first_offset"))


def concat_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return intervals.running_offsets(c, ["conv_id"], ["turn"], F.col("len"), F.floor(F.col("turn") / 1024)).select("conv_id", "turn", "start", "end")


def point_in_span(spark, sf_dir):
    spans = concat_offsets(spark, sf_dir)
    points = spans.groupBy("conv_id").agg(F.max("end").alias("size")).select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), F.col("size")).select("conv_id", F.floor(F.col("size") * F.col("k") / 10).alias("offset"))
    found = intervals.point_join(points.distinct(), spans, ["conv_id"], "offset", ("start", "end"), "turn", ["offset"])
    return found.select("conv_id", "offset", "turn", (F.col("offset") - F.col("start")).alias("rebased"))


def onset_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts")).select("user_id", "event_id", "event_type", "at", F.lit(1706745600000000).alias("stop"))
    return intervals.onset_spans(e, ["user_id"], ["at", "event_id"], "event_type", "error", "at", "stop", F.floor(F.col("at") / (7 * DAY))).select("user_id", "event_id", "event_type", (F.col("span_end") - F.col("at")).alias("lasts"))


def _daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), (F.col("event_type") == "purchase").cast("double").alias("buy"))
    return e.groupBy("user_id", "day").agg(F.avg("buy").alias("ratio"))


def confirmed_prefix(spark, sf_dir):
    return intervals.confirmed_prefix(_daily(spark, sf_dir), ["user_id"], "day", "ratio", 0.1, 0.6)


def islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts")).select("user_id", "event_id", "event_type", "at")
    return intervals.islands(e, ["user_id"], ["at", "event_id"], "event_type", F.floor(F.col("at") / (7 * DAY))).select("user_id", "run", "event_type", "n")


def run_modes(spark, sf_dir):
    # later overlapping spans win, then runs of one of four modes
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    mode = F.when(F.col("event_type") == "error", "hidden").when(F.col("value") < 5, "hint").when(F.col("event_type") == "view", "plain").otherwise("graded")
    return intervals.islands(e.select("user_id", "event_id", "at", mode.alias("mode")), ["user_id"], ["at", "event_id"], "mode", F.floor(F.col("at") / (7 * DAY))).groupBy("user_id", "mode").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


def topk_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    by = lambda g: intervals.top_per_group(d, [g], ["n_chars", "doc_id"], 3).select("doc_id", "n_chars")
    return by("lang").unionByName(by("source")).distinct()


def top_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / F.col("p_size"), 2).alias("score"))
    return intervals.top_per_group(p, ["p_brand"], [F.desc("score"), "p_partkey"], 6)


def session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts")).select("user_id", "event_id", "at")
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) >= 1_800_000_000, F.lit(True)).cast("int")
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("lasts"))


def first_unmet(spark, sf_dir):
    # earliest expected turn whose role isn't the user's; turns that don't exist count
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.max("turn").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1)).alias("turn"))
    j = n.join(c.select("conv_id", "turn", "role"), ["conv_id", "turn"], "left")
    return j.where(~F.col("role").eqNullSafe("user")).groupBy("conv_id").agg(F.min("turn").alias("first_unmet"))


def pair_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "conversations").where("length(text) > 400 and turn < 3").select("conv_id", "turn").distinct()
    return table(spark, sf_dir, "conversations").join(wanted, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role")


def drill_examples(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(60)
    firsts = l.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("s")).orderBy("l_orderkey").limit(20)
    j = firsts.select("l_orderkey", F.col("s.l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").where("p_name <> ''")
    return j.orderBy(F.length("p_name"), "l_orderkey").limit(5).select("l_orderkey", "p_name")


def ordered_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey between 10 and 90 and o_orderstatus = 'F'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


def latest_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", micros("o_orderdate").alias("at"), "o_orderkey", "o_orderpriority")
    return o.groupBy("o_custkey").agg(F.max(F.struct("at", (-F.col("o_orderkey")).alias("first"), "o_orderpriority")).alias("b")).select("o_custkey", (-F.col("b.first")).alias("o_orderkey"), "b.o_orderpriority")


def group_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("turns"))


def session_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.substring("props", 1, 7).alias("message"))
    first = e.groupBy("user_id", "message").agg(F.min("event_id").alias("event_id"))
    return intervals.top_per_group(first, ["user_id"], ["event_id"], 5).select("user_id", "event_id", "message")


def dimension_stats(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_due"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n_mastered"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey")


QUERIES = {
    f.__name__: f
    for f in (
        range_bounds, page_bounds, lexi_range, lexi_overlap, asof_lookup, carry_forward, interval_overlap, contained_spans, concat_offsets,
        point_in_span, onset_spans, confirmed_prefix, islands, run_modes, topk_union, top_candidates, session_gaps, first_unmet, pair_lookup,
        drill_examples, ordered_lookup, latest_pick, group_lists, session_cap, dimension_stats,
    )
}

_RUNS = """m AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM m)"""
SQL = {
    "range_bounds": """SELECT o_custkey, o_orderkey, o_orderdate::date AS start, coalesce((lead(o_orderdate::date) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::date, o_orderkey) - 1)::date, DATE '1999-12-31') AS "end" FROM orders""",
    "page_bounds": """WITH n AS (SELECT conv_id, turn, lead(conv_id) OVER w AS nc, lead(turn) OVER w AS nt FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id // 50 ORDER BY conv_id, turn))
SELECT n.conv_id, turn, CASE WHEN nc = n.conv_id AND nt > 0 THEN nt - 1 ELSE l.n END AS end_turn FROM n JOIN (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1) l ON l.conv_id = n.conv_id""",
    "lexi_range": "SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey * 100000 + l_linenumber BETWEEN 10000003 AND 14000005 GROUP BY 1, 2",
    "lexi_overlap": """WITH l AS (SELECT l_orderkey o, l_linenumber n FROM lineitem),
p AS (SELECT o // 40 AS page, min(o * 100000 + n) AS p0, max(o * 100000 + n) AS p1 FROM l GROUP BY 1), c AS (SELECT o // 70 AS chapter, min(o * 100000 + n) AS c0, max(o * 100000 + n) AS c1 FROM l GROUP BY 1)
SELECT page, chapter FROM p JOIN c ON NOT p1 < c0 AND NOT p0 > c1""",
    "asof_lookup": """WITH s AS (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT b.user_id, epoch_us(b.ts) AS "at", b.event_id, b.value, s.signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts >= s.ts""",
    "carry_forward": "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM events",
    "interval_overlap": """SELECT a.user_id, a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
AND a.ts < b.ts + INTERVAL 2 HOUR AND a.ts + INTERVAL 1 HOUR > b.ts""",
    "contained_spans": """SELECT a.user_id, b.event_id AS signup_id, count(*) AS n, min(epoch_us(a.ts) - epoch_us(b.ts)) AS first_offset FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view'
AND b.event_type = 'signup' AND a.ts >= b.ts AND a.ts + INTERVAL 1 HOUR <= b.ts + INTERVAL 12 HOUR GROUP BY 1, 2""",
    "concat_offsets": """SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER w, 0)::bigint AS start, coalesce(sum(length(text) + 1) OVER w, 0)::bigint + length(text) AS "end" FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "point_in_span": """WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER w, 0)::bigint AS s0, coalesce(sum(length(text) + 1) OVER w, 0)::bigint + length(text) AS s1 FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT DISTINCT conv_id, floor(n * k / 10)::bigint AS o FROM (SELECT conv_id, max(s1) AS n FROM s GROUP BY 1), range(10) t(k))
SELECT p.conv_id, o AS "offset", turn, o - s0 AS rebased FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s0 <= o AND o < s1""",
    "onset_spans": """WITH o AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id, event_type, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 1706745600000000) - epoch_us(ts) AS lasts FROM o WHERE event_type <> 'error' AND event_type IS DISTINCT FROM b""",
    "confirmed_prefix": """WITH d AS (SELECT user_id, day(ts)::int AS d, avg((event_type = 'purchase')::int) AS r FROM events GROUP BY 1, 2),
l AS (SELECT *, min((r >= 0.1)::int) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) = 1 AS led FROM d)
SELECT user_id, count(*) FILTER (led) AS n_confirmed, max(d) FILTER (NOT led AND r >= 0.6) + 1 AS resume_at FROM l GROUP BY 1""",
    "islands": "WITH e AS (SELECT *, event_type AS s FROM events), " + _RUNS + " SELECT user_id, run, s AS event_type, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "run_modes": "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'hidden' WHEN value < 5 THEN 'hint' WHEN event_type = 'view' THEN 'plain' ELSE 'graded' END AS s FROM events), "
    + _RUNS
    + ", g AS (SELECT user_id, run, s, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT user_id, s AS mode, count(*) AS runs, max(n) AS longest FROM g GROUP BY 1, 2",
    "topk_union": """SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS b FROM documents) WHERE a <= 3 OR b <= 3""",
    "top_candidates": "SELECT p_brand, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rn FROM (SELECT p_brand, p_partkey, round(p_retailprice / p_size, 2) AS score FROM part)) WHERE rn <= 6",
    "session_gaps": """WITH m AS (SELECT user_id, event_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000)::int, 1) AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS session FROM m)
SELECT user_id, session, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS lasts FROM s GROUP BY 1, 2""",
    "first_unmet": """WITH n AS (SELECT conv_id, unnest(range(max(turn) + 2)) AS turn FROM conversations GROUP BY 1)
SELECT n.conv_id, min(n.turn) AS first_unmet FROM n LEFT JOIN conversations c ON c.conv_id = n.conv_id AND c.turn = n.turn WHERE c.role IS DISTINCT FROM 'user' GROUP BY 1""",
    "pair_lookup": "SELECT conv_id, turn, role FROM conversations c WHERE (conv_id, turn) IN (SELECT conv_id, turn FROM conversations WHERE length(text) > 400 AND turn < 3)",
    "drill_examples": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 ORDER BY 1, 2, 3 LIMIT 60),
f AS (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM l) WHERE rn = 1 ORDER BY 1 LIMIT 20)
SELECT l_orderkey, p_name FROM f JOIN part ON p_partkey = l_partkey WHERE p_name <> '' ORDER BY length(p_name), l_orderkey LIMIT 5""",
    "ordered_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 90 AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "latest_pick": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "group_lists": "SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1",
    "session_cap": """SELECT user_id, event_id, message FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM
(SELECT user_id, substr(props, 1, 7) AS message, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2)) WHERE rn <= 5""",
    "dimension_stats": "SELECT n_nationkey, n_name, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_due, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_mastered FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
}
