"""Learner progress: ordered folds of events into schedules, streaks and slots, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTERED_AT, REVIEWING_AT = 7, 3
JOKER_EVERY, JOKER_CAP = 7, 2
SLOTS, COOLDOWN_US = 6, 72 * 3_600_000_000
DAY_US = 86_400_000_000


def _places(order: list[str]) -> list[Column]:
    """Order columns under names of their own, first in a struct that sorts by them."""
    return [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]


def status_for_streak(streak: Column) -> Column:
    return F.when(streak >= MASTERED_AT, "mastered").when(streak >= REVIEWING_AT, "reviewing").otherwise("learning")


def review_step(state: Column, event: Column) -> Column:
    """One review: the interval from the old ease, then the new ease; a failure resets the streak but keeps the status."""
    q = F.least(F.lit(5), F.greatest(F.lit(0), event["q"]))
    passed = q >= 3
    reps = state["repetitions"]
    interval = (
        F.when(~passed, F.lit(1.0))
        .when(reps == 0, F.lit(1.0))
        .when(reps == 1, F.lit(6.0))
        .otherwise(F.floor(state["interval"] * state["ease"] + 0.5).cast("double"))
    )
    ease = F.greatest(F.lit(1.3), state["ease"] + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    streak = F.when(passed, state["streak"] + 1).otherwise(0)
    return F.struct(
        ease.alias("ease"), interval.alias("interval"), F.when(passed, reps + 1).otherwise(0).alias("repetitions"), streak.alias("streak"),
        F.when(passed, status_for_streak(streak)).otherwise(state["status"]).alias("status"), event["at"].alias("last_at"),
    )


def sm2(reviews: DataFrame, keys: list[str], order: list[str], at: str, quality: str) -> DataFrame:
    """Fold reviews per key in order: ease, interval, repetitions, streak, status, last_at, next_at (microseconds)."""
    zero = F.struct(
        F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval"), F.lit(0).alias("repetitions"), F.lit(0).alias("streak"), F.lit("learning").alias("status"), F.lit(0).cast("long").alias("last_at")
    )
    events = reviews.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_places(order), F.col(at).alias("at"), F.col(quality).cast("int").alias("q")))).alias("_e"))
    s = events.select(*keys, F.aggregate("_e", zero, review_step).alias("s")).select(*keys, "s.*")
    return s.withColumn("next_at", F.col("last_at") + (F.col("interval") * DAY_US).cast("long"))


def streaks(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Fold distinct active days per key: current, longest, last_day, jokers, n_bridged (days a joker covered)."""
    zero = F.struct(F.lit(0).alias("current"), F.lit(0).alias("longest"), F.lit(None).cast("date").alias("last"), F.lit(0).alias("jokers"), F.lit(0).alias("bridged"))

    def step(s: Column, d: Column) -> Column:
        gap = F.datediff(d, s["last"])
        bridge = F.coalesce((gap == 2) & (s["jokers"] > 0), F.lit(False))
        current = F.when(F.coalesce(gap == 1, F.lit(False)) | bridge, s["current"] + 1).otherwise(1)
        left = s["jokers"] - bridge.cast("int")
        earned = ((current % JOKER_EVERY == 0) & (left < JOKER_CAP)).cast("int")
        return F.struct(current.alias("current"), F.greatest(s["longest"], current).alias("longest"), d.alias("last"), (left + earned).alias("jokers"), (s["bridged"] + bridge.cast("int")).alias("bridged"))

    every = days.select(*keys, day).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(day)).alias("_d"))
    s = every.select(*keys, F.aggregate("_d", zero, step).alias("s"))
    return s.select(*keys, "s.current", "s.longest", F.col("s.last").alias("last_day"), "s.jokers", F.col("s.bridged").alias("n_bridged"))


def slot_ledger(events: DataFrame, keys: list[str], order: list[str], at: str, op: str, item: str) -> DataFrame:
    """Fold claims, steps back and releases per key in order.

    A claim takes a slot unless the item has one or active and cooling slots fill all six; stepping
    back frees a slot that cools for 72 hours; a release frees it at once. keys, active (sorted
    items), n_refused, cooling_until (the freed instants plus 72 hours not over at the last event).
    """
    zero = F.expr("named_struct('active', cast(array() as array<long>), 'cooling', cast(array() as array<long>), 'refused', 0, 'now', 0L)")

    def step(s: Column, e: Column) -> Column:
        cooling = F.filter(s["cooling"], lambda until: e["at"] < until)
        has = F.array_contains(s["active"], e["item"])
        full = F.size(s["active"]) + F.size(cooling) >= SLOTS
        takes = (e["op"] == "claim") & ~has & ~full
        frees = e["op"].isin("step_back", "release")
        active = F.when(takes, F.concat(s["active"], F.array(e["item"]))).when(frees, F.filter(s["active"], lambda x: x != e["item"])).otherwise(s["active"])
        now = F.when(e["op"] == "step_back", F.concat(cooling, F.array(e["at"] + COOLDOWN_US))).otherwise(cooling)
        return F.struct(active.alias("active"), now.alias("cooling"), (s["refused"] + ((e["op"] == "claim") & ~has & full).cast("int")).alias("refused"), e["at"].alias("now"))

    e = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_places(order), F.col(at).alias("at"), F.col(op).alias("op"), F.col(item).cast("long").alias("item")))).alias("_e"))
    s = e.select(*keys, F.aggregate("_e", zero, step).alias("s"))
    return s.select(*keys, F.array_sort("s.active").alias("active"), F.col("s.refused").alias("n_refused"), F.array_sort("s.cooling").alias("cooling_until"), F.array_min("s.cooling").alias("next_opens"))


def is_due(next_at: Column, as_of: Column) -> Column:
    """Due at ``as_of``; no schedule means due."""
    return F.coalesce(next_at, F.lit(0).cast("long")) <= as_of


def urgency(streak: Column, status: Column) -> Column:
    return F.when(streak == 0, "urgent").when(status.isin("reviewing", "mastered"), "routine").otherwise("due")


def status_weight(status: Column) -> Column:
    return F.when(status == "learning", 0.34).when(status == "reviewing", 0.67).when(status == "mastered", 1.0).otherwise(0.0)


def tiers(progress: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Per group: counts by status, untouched, weighted ratio (capped at 1), tier."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = progress.groupBy(*keys).agg(n("learning").alias("learning"), n("reviewing").alias("reviewing"), n("mastered").alias("mastered"), F.count(F.lit(1)).alias("tracked"), F.sum(status_weight(F.col("status"))).alias("_w"), F.max(total).alias("total"))
    ratio = F.when(F.col("total") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("_w") / F.col("total")))
    tier = F.when(F.col("mastered") >= F.col("total"), "retained").when(F.col("tracked") > 0, "started").otherwise("new")
    return g.select(*keys, "learning", "reviewing", "mastered", (F.col("total") - F.col("tracked")).alias("untouched"), ratio.alias("ratio"), tier.alias("tier"))


# Clean blind passes that finish a chunk, failed ones that send it back.
BLIND_TARGET, FALLBACK_AFTER = 2, 3


def guided_chunks(attempts: DataFrame, keys: list[str], order: list[str], passed: str, decoded: str) -> DataFrame:
    """Fold attempts at a chunk through its stages: echo, recall, blind.

    A pass at echo or recall moves on. At blind two passes in a row finish; each failure resets the
    run, and three send the chunk back to recall. Attempts with under three decoded characters don't
    count, nor do any after the end. keys, stage (``done`` at the end), n_attempts, n_blind_fails,
    fell_back, quality (2 if it fell back or had three failures, 4 after any, else 5; null until done).
    """
    zero = F.expr("named_struct('stage', 'echo', 'run', 0, 'fails', 0, 'back', false, 'n', 0)")

    def step(s: Column, a: Column) -> Column:
        open_, ok, blind = s["stage"] != "done", a["ok"], s["stage"] == "blind"
        run = F.when(blind & ok, s["run"] + 1).when(blind, 0).otherwise(s["run"])
        fails = F.when(blind & ~ok, s["fails"] + 1).otherwise(s["fails"])
        falls = blind & ~ok & (fails >= FALLBACK_AFTER)
        stage = (
            F.when((s["stage"] == "echo") & ok, "recall").when((s["stage"] == "recall") & ok, "blind").when(blind & ok & (run >= BLIND_TARGET), "done").when(falls, "recall").otherwise(s["stage"])
        )
        new = F.struct(stage.alias("stage"), run.alias("run"), fails.alias("fails"), (s["back"] | falls).alias("back"), (s["n"] + 1).alias("n"))
        return F.when(open_, new).otherwise(s)

    real = attempts.where(F.length(F.trim(decoded)) >= 3)
    events = real.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_places(order), F.col(passed).alias("ok")))).alias("_a"))
    s = events.select(*keys, F.aggregate("_a", zero, step).alias("s"))
    quality = F.when(F.col("s.stage") == "done", F.when(F.col("s.back") | (F.col("s.fails") >= FALLBACK_AFTER), 2).when(F.col("s.fails") > 0, 4).otherwise(5))
    return s.select(*keys, "s.stage", F.col("s.n").alias("n_attempts"), F.col("s.fails").alias("n_blind_fails"), F.col("s.back").alias("fell_back"), quality.alias("quality"))


def attempt_is_clean(words: DataFrame, keys: list[str], expected: Column, ratio: float = 0.5) -> DataFrame:
    """keys, clean: some word, at most one short of the expected number, and enough of them right."""
    g = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if("content_ok").alias("_ok"), F.max(expected).alias("_e"))
    return g.select(*keys, ((F.col("_n") >= F.col("_e") - 1) & (F.col("_ok") / F.col("_n") >= ratio)).alias("clean"))
