"""Learner progress, streaming-shaped folds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.functions import text
from tilth.operators import intervals, progress, scoring
from tilth.plans.tables import micros, table
from tilth.streaming import pauses, windows

AS_OF = 1_706_000_000_000_000


def _reviews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", micros("ts").alias("at"), F.floor(F.col("value") % 6).cast("int").alias("q"))


def _schedule(spark, sf_dir):
    return progress.sm2(_reviews(spark, sf_dir), ["user_id", "event_type"], ["at", "event_id"], "at", "q")


def sm2_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir).select("user_id", "event_type", F.round("ease", 6).alias("ease"), "interval", "repetitions", "streak", "status", "next_at")


def streak_state(spark, sf_dir):
    return progress.streaks(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")


def week_strip(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    today = F.lit("2024-01-25").cast("date")
    week = days.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(today, 6), today)).alias("day"))
    j = week.join(days.withColumn("hit", F.lit(True)), ["user_id", "day"], "left")
    return j.select("user_id", "day", F.when(F.col("hit"), "done").when(F.col("day") == today, "today").otherwise("missed").alias("state"))


def status_pivot(spark, sf_dir):
    return progress.tiers(_schedule(spark, sf_dir), ["user_id"], F.lit(5)).withColumn("ratio", F.round("ratio", 6))


def due_urgency(spark, sf_dir):
    s = _schedule(spark, sf_dir).where(progress.is_due(F.col("next_at"), F.lit(AS_OF)))
    u = progress.urgency(F.col("streak"), F.col("status"))
    rank = F.when(u == "urgent", 0).when(u == "due", 1).otherwise(2)
    return s.groupBy("user_id").agg(F.min(rank).alias("worst"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("due"))


def next_due(spark, sf_dir):
    s = _schedule(spark, sf_dir)
    due = progress.is_due(F.col("next_at"), F.lit(AS_OF))
    return s.groupBy("user_id").agg(F.min(F.when(~due, F.col("next_at"))).alias("next_at"), F.count_if(due).alias("n_due"))


def slot_ledger(spark, sf_dir):
    e = _reviews(spark, sf_dir).withColumn("item", F.col("event_id") % 9)
    op = F.when(F.col("event_type").isin("view", "click", "purchase"), "claim").when(F.col("event_type") == "error", "step_back").otherwise("release")
    s = progress.slot_ledger(e.withColumn("op", op), ["user_id"], ["at", "event_id"], "at", "op", "item")
    return s.select("user_id", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"), "n_refused", F.size("cooling_until").alias("n_cooling"), "next_opens")


def pause_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(micros("ts") / 60_000_000).alias("minute"), (F.col("value") / 200).alias("rms"))
    return pauses.segments(e, ["user_id"], ["minute", "event_id"], "minute", "rms", pauses.PauseConfig(speech=0.05, pause=200, shortest=600, longest=4000))


def sliding_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    return windows.sliding_levels(e, F.col("at"), ["event_type"], "value", 3_200_000_000, 1_700_000_000, least=2).withColumn("rms", F.round("rms", 9))


def sticky_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") > 20, "green").when(F.col("value") > 8, "yellow").otherwise("red").alias("verdict"))
    return windows.sticky_verdicts(e, ["user_id", "event_type"], "event_id", F.col("verdict") != "red", "verdict")


def unit_estimate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return scoring.unit_estimate(l, ["l_orderkey"], F.col("l_returnflag") == "R", "l_quantity")


def pass_gate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", text.word_count(F.col("text")).alias("n"), F.trim("text").alias("t"))
    c = c.where(F.length("t") >= 3).groupBy("conv_id").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("role") == "user", F.col("n"))).alias("ok"), F.count(F.lit(1)).alias("turns"), F.bool_or(F.col("n") < 5).alias("any_red"))
    ok = F.coalesce("ok", F.lit(0))
    return c.select("conv_id", "words", ((F.col("words") >= 1) & (F.col("words") >= 50 * F.col("turns") - 1) & (ok / F.col("words") >= 0.5)).alias("clean"), (~F.col("any_red")).alias("passed"))


def session_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fails"), F.count(F.lit(1)).alias("n"))
    q = F.when(F.col("fails") * 4 > F.col("n"), 2).when(F.col("fails") * 5 > F.col("n"), 4).otherwise(5)
    return e.select("user_id", q.alias("quality"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ayah"))


def nested_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    s = l.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") >= 10).alias("n_ok"), F.count_if(F.col("l_quantity") < 10).alias("n_warn"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("segments"))
    return s.select("l_orderkey", F.to_json(F.struct("n_ok", "n_warn", "segments")).alias("report"))


def guided_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", (F.col("event_type") != "error").alias("ok"), F.col("props").alias("decoded"))
    return progress.guided_chunks(e, ["user_id", "day"], ["event_id"], "ok", "decoded")


def span_of_range(spark, sf_dir):
    # first start and last end of the timed turns between two positions, null if none
    c = intervals.running_offsets(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("len")), ["conv_id"], ["turn"], F.col("len"), F.floor(F.col("turn") / 1024))
    return c.groupBy("conv_id").agg(F.min(F.when((F.col("role") == "assistant") & F.col("turn").between(1, 4), F.col("start"))).alias("t0"), F.max(F.when((F.col("role") == "assistant") & F.col("turn").between(1, 4), F.col("end"))).alias("t1"))


QUERIES = {
    f.__name__: f
    for f in (
        sm2_schedule, streak_state, week_strip, status_pivot, due_urgency, next_due, slot_ledger, pause_sessions, sliding_levels, sticky_merge,
        unit_estimate, pass_gate, session_quality, nested_report, span_of_range, guided_chunks,
    )
}

_SM2 = """ev AS (SELECT user_id, event_type, epoch_us(ts) AS at, floor(value % 6)::int AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
RECURSIVE_SM2 AS (
  SELECT user_id, event_type, 0::bigint AS k, 2.5::double AS ease, 0.0::double AS iv, 0 AS reps, 0 AS streak, 'learning' AS status, 0::bigint AS last_at FROM (SELECT DISTINCT user_id, event_type FROM ev)
  UNION ALL
  SELECT s.user_id, s.event_type, e.k, greatest(1.3::double, s.ease + (0.1::double - (5 - e.q) * (0.08::double + (5 - e.q) * 0.02::double))),
    CASE WHEN e.q < 3 THEN 1.0 WHEN s.reps = 0 THEN 1.0 WHEN s.reps = 1 THEN 6.0 ELSE floor(s.iv * s.ease + 0.5) END::double,
    CASE WHEN e.q >= 3 THEN s.reps + 1 ELSE 0 END, CASE WHEN e.q >= 3 THEN s.streak + 1 ELSE 0 END,
    CASE WHEN e.q >= 3 THEN CASE WHEN s.streak + 1 >= 7 THEN 'mastered' WHEN s.streak + 1 >= 3 THEN 'reviewing' ELSE 'learning' END ELSE s.status END, e.at
  FROM RECURSIVE_SM2 s JOIN ev e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.k = s.k + 1),
sm2 AS (SELECT *, last_at + (iv * 86400000000)::bigint AS next_at FROM RECURSIVE_SM2 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) = 1)"""
SQL = {
    "sm2_schedule": f"WITH RECURSIVE {_SM2} SELECT user_id, event_type, round(ease, 6) AS ease, iv AS interval, reps AS repetitions, streak, status, next_at FROM sm2",
    "streak_state": """WITH RECURSIVE d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM (SELECT DISTINCT user_id, ts::date AS day FROM events)),
s AS (SELECT user_id, k, day, 1 AS cur, 1 AS longest, 0 AS jokers, 0 AS bridged FROM d WHERE k = 1
UNION ALL SELECT user_id, k, day, cur, greatest(longest, cur), j0 + CASE WHEN cur % 7 = 0 AND j0 < 2 THEN 1 ELSE 0 END, bridged FROM (
  SELECT s.user_id, d.k, d.day, CASE WHEN d.day - s.day = 1 OR (d.day - s.day = 2 AND s.jokers > 0) THEN s.cur + 1 ELSE 1 END AS cur, s.longest,
  s.jokers - CASE WHEN d.day - s.day = 2 AND s.jokers > 0 THEN 1 ELSE 0 END AS j0, s.bridged + CASE WHEN d.day - s.day = 2 AND s.jokers > 0 THEN 1 ELSE 0 END AS bridged
  FROM s JOIN d ON d.user_id = s.user_id AND d.k = s.k + 1))
SELECT user_id, cur AS current, longest, day AS last_day, jokers, bridged AS n_bridged FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
    "week_strip": """WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT user_id, ts::date AS day FROM events), w AS (SELECT user_id, (DATE '2024-01-19' + i::int)::date AS day FROM u, range(7) t(i))
SELECT w.user_id, w.day, CASE WHEN d.day IS NOT NULL THEN 'done' WHEN w.day = DATE '2024-01-25' THEN 'today' ELSE 'missed' END AS state FROM w LEFT JOIN d ON d.user_id = w.user_id AND d.day = w.day""",
    "status_pivot": f"""WITH RECURSIVE {_SM2} SELECT user_id, count(*) FILTER (status = 'learning') AS learning, count(*) FILTER (status = 'reviewing') AS reviewing, count(*) FILTER (status = 'mastered') AS mastered,
5 - count(*) AS untouched, round(least(1.0, sum(CASE status WHEN 'learning' THEN 0.34 WHEN 'reviewing' THEN 0.67 ELSE 1.0 END::double) / 5), 6) AS ratio, CASE WHEN count(*) FILTER (status = 'mastered') >= 5 THEN 'retained' ELSE 'started' END AS tier FROM sm2 GROUP BY 1""",
    "due_urgency": f"""WITH RECURSIVE {_SM2} SELECT user_id, min(CASE WHEN streak = 0 THEN 0 WHEN status IN ('reviewing', 'mastered') THEN 2 ELSE 1 END) AS worst, string_agg(event_type, ',' ORDER BY event_type) AS due
FROM sm2 WHERE next_at <= {AS_OF} GROUP BY 1""",
    "next_due": f"WITH RECURSIVE {_SM2} SELECT user_id, min(next_at) FILTER (next_at > {AS_OF}) AS next_at, count(*) FILTER (next_at <= {AS_OF}) AS n_due FROM sm2 GROUP BY 1",
    "sliding_levels": """WITH k AS (SELECT event_type, value, unnest(range(((epoch_us(ts) - 3200000000) // 1700000000) + 1, epoch_us(ts) // 1700000000 + 1)) AS k FROM events)
SELECT event_type, k * 1700000000 AS window_start, count(*) AS n, round(sqrt(avg(value * value)), 9) AS rms FROM k GROUP BY 1, 2 HAVING count(*) >= 2""",
    "sticky_merge": """SELECT user_id, event_type, coalesce(arg_max(CASE WHEN value > 20 THEN 'green' WHEN value > 8 THEN 'yellow' END, event_id) FILTER (value > 8), 'red') AS verdict, bool_or(value > 8) AS content_ok FROM events GROUP BY 1, 2""",
    "unit_estimate": """SELECT l_orderkey, coalesce(median(l_quantity) FILTER (l_returnflag = 'R' AND l_quantity > 0) / 2.0, median(l_quantity) FILTER (l_returnflag <> 'R')) AS unit,
count(*) FILTER (l_returnflag = 'R' AND l_quantity > 0) AS n_anchor FROM lineitem GROUP BY 1""",
    "pass_gate": r"""WITH c AS (SELECT conv_id, role, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM conversations WHERE length(trim(text)) >= 3)
SELECT conv_id, sum(n)::bigint AS words, sum(n) >= 1 AND sum(n) >= 50 * count(*) - 1 AND coalesce(sum(n) FILTER (role = 'user'), 0) / sum(n)::double >= 0.5 AS clean, NOT bool_or(n < 5) AS passed FROM c GROUP BY 1""",
    "session_quality": """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') * 4 > count(*) THEN 2 WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 4 ELSE 5 END AS quality, unnest([1, 2, 3]) AS ayah FROM events GROUP BY user_id""",
    "span_of_range": """WITH s AS (SELECT conv_id, turn, role, coalesce(sum(length(text) + 1) OVER w, 0)::bigint AS s0, length(text) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, min(s0) FILTER (role = 'assistant' AND turn BETWEEN 1 AND 4) AS t0, max(s0 + n) FILTER (role = 'assistant' AND turn BETWEEN 1 AND 4) AS t1 FROM s GROUP BY 1""",
}
SQL |= {
    "pause_sessions": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 60000000 AS t, value / 200 > 0.05 AS speaking, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 60000000, event_id) AS k FROM events),
s AS (SELECT user_id, 0::bigint AS k, false AS spoke, NULL::bigint AS quiet, NULL::bigint AS begun, 0 AS n, false AS cut, NULL::bigint AS c0, NULL::bigint AS c1, 0 AS cn FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, CASE WHEN cut THEN false ELSE spoke OR speaking END, CASE WHEN cut THEN NULL ELSE quiet END, CASE WHEN cut THEN t ELSE begun END, CASE WHEN cut THEN 0 ELSE n END, cut, begun, t, n FROM (
  SELECT *, coalesce((t - begun >= 4000 AND (spoke OR speaking)) OR (spoke AND NOT speaking AND t - quiet >= 200 AND t - begun >= 600), false) AS cut FROM (
    SELECT s.user_id, e.k, s.spoke, e.t, e.speaking, coalesce(s.begun, e.t) AS begun, s.n + 1 AS n, CASE WHEN s.spoke AND NOT e.speaking THEN coalesce(s.quiet, e.t) END AS quiet FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT user_id, c0 AS segment_start, c1 AS segment_end, cn AS n_samples FROM s WHERE cut""",
    "slot_ledger": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id % 9 AS item, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'claim' WHEN event_type = 'error' THEN 'step_back' ELSE 'release' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, 0::bigint AS k, []::bigint[] AS active, []::bigint[] AS cooling, 0 AS refused FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, CASE WHEN op = 'claim' THEN CASE WHEN has OR n >= 6 THEN active ELSE list_append(active, item) END ELSE list_filter(active, lambda x: x <> item) END,
  CASE WHEN op = 'step_back' THEN list_append(cooling, t + 259200000000) ELSE cooling END, refused + CASE WHEN op = 'claim' AND NOT has AND n >= 6 THEN 1 ELSE 0 END FROM (
    SELECT s.user_id, e.k, e.t, e.op, e.item, s.active, s.refused, list_filter(s.cooling, lambda u: e.t < u) AS cooling, list_contains(s.active, e.item) AS has, len(s.active) + len(list_filter(s.cooling, lambda u: e.t < u)) AS n
    FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT user_id, array_to_string(list_sort(active), ',') AS active, refused AS n_refused, len(cooling)::int AS n_cooling, list_min(cooling) AS next_opens FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
    "nested_report": """SELECT l_orderkey, to_json({n_ok: count(*) FILTER (l_quantity >= 10), n_warn: count(*) FILTER (l_quantity < 10),
segments: list({l_linenumber: l_linenumber, l_returnflag: l_returnflag, l_quantity: l_quantity} ORDER BY l_linenumber, l_returnflag, l_quantity)})::varchar AS report FROM lineitem GROUP BY 1""",
    "guided_chunks": """WITH RECURSIVE e AS (SELECT user_id, ts::date AS day, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY event_id) AS k FROM events WHERE length(trim(props)) >= 3),
s AS (SELECT user_id, day, 0::bigint AS k, 'echo' AS stage, 0 AS run, 0 AS fails, false AS back, 0 AS n FROM (SELECT DISTINCT user_id, day FROM e)
UNION ALL SELECT user_id, day, k, CASE WHEN stage = 'done' THEN 'done' WHEN stage = 'echo' AND ok THEN 'recall' WHEN stage = 'recall' AND ok THEN 'blind' WHEN stage = 'blind' AND ok AND run2 >= 2 THEN 'done'
  WHEN stage = 'blind' AND NOT ok AND fails2 >= 3 THEN 'recall' ELSE stage END, run2, fails2, back OR (stage = 'blind' AND NOT ok AND fails2 >= 3), n + CASE WHEN stage = 'done' THEN 0 ELSE 1 END FROM (
    SELECT s.user_id, s.day, e.k, s.stage, e.ok, s.back, s.n, CASE WHEN s.stage <> 'blind' THEN s.run WHEN e.ok THEN s.run + 1 ELSE 0 END AS run2, s.fails + CASE WHEN s.stage = 'blind' AND NOT e.ok THEN 1 ELSE 0 END AS fails2
    FROM s JOIN e ON e.user_id = s.user_id AND e.day = s.day AND e.k = s.k + 1))
SELECT user_id, day, stage, n AS n_attempts, fails AS n_blind_fails, back AS fell_back, CASE WHEN stage = 'done' THEN CASE WHEN back OR fails >= 3 THEN 2 WHEN fails > 0 THEN 4 ELSE 5 END END AS quality
FROM s QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY k DESC) = 1""",
}
SQL = {k: v.replace("RECURSIVE_SM2", "sm2_steps") for k, v in SQL.items()}
