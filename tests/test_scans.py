"""Scans in two levels against plain loops, with blocks that cut keys anywhere."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tilth.operators import intervals


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i, rng.choice(["x", "y", "-", None])) for i in range(n)]


SCHEMA = "k string, t int, i int, s string"


def groups(rows):
    by = {}
    for k, t, i, s in rows:
        by.setdefault(k, []).append((t is not None, t or 0, i, s))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_islands(spark, width):
    rows = rows_of(width)
    got = intervals.islands(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "i"], "s", F.floor(F.col("t") / width)).collect()
    want = set()
    for k, v in groups(rows).items():
        run, last = 0, object()
        for known, t, _, s in v:
            if s != last:
                run, last = run + 1, s
            want.add((k, run, s))
    assert {(r["k"], r["run"], r["s"]) for r in got} == want and sum(r["n"] for r in got) == len(rows)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_offsets(spark, width):
    rows = rows_of(width + 1)
    length = F.when(F.col("s").isNotNull(), F.col("i") % 9)
    got = {r["i"]: (r["start"], r["end"]) for r in intervals.running_offsets(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "i"], length, F.floor(F.col("t") / width)).collect()}
    for v in groups(rows).values():
        at = 0
        for _, _, i, s in v:
            n = i % 9 if s is not None else None
            assert got[i] == (at, None if n is None else at + n)
            at += (n or 0) + 1


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_onsets(spark, width):
    rows = [(k, t, i, s) for k, t, i, s in rows_of(width + 2) if t is not None]
    frames = spark.createDataFrame(rows, SCHEMA).withColumn("stop", F.lit(99))
    got = {r["i"]: r["span_end"] for r in intervals.onset_spans(frames, ["k"], ["t", "i"], "s", "-", "t", "stop", F.floor(F.col("t") / width)).collect()}
    want = {}
    for v in groups(rows).values():
        on, last = [], None
        for _, t, i, s in v:
            if s is not None and s != "-" and s != last:
                on.append((t, i))
            last = s
        for (_, i), (t2, _) in zip(on, [*on[1:], (99, None)], strict=True):
            want[i] = t2
    assert got == want


def test_no_window_over_a_bare_key_sees_rows(spark):
    """Windows by key alone stand above an aggregate by key and block; those over rows are by block, too."""
    frame = spark.createDataFrame(rows_of(1), SCHEMA).withColumn("stop", F.lit(99))
    block = F.floor(F.col("t") / 7)
    for out in (
        intervals.islands(frame, ["k"], ["t", "i"], "s", block), intervals.running_offsets(frame, ["k"], ["t", "i"], F.col("i"), block),
        intervals.onset_spans(frame, ["k"], ["t", "i"], "s", "-", "t", "stop", block),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        for at, line in enumerate(plan):
            if re.search(r"\bWindow \[", line) and not re.search(r"\[k#\d+, _block#", line):
                below = [x.strip(" :+-") for x in plan[at + 1 :] if x.strip(" :+-").startswith(("Aggregate", "LogicalRDD"))]
                assert below[0].startswith("Aggregate [k#"), line
