"""Folds over ordered rows: every row counts, and no host's rows meet in one array."""

import random

import pytest
from pyspark.sql import functions as F

from leadlens.operators import mx, stateful


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def ranges(spark):
    """Many small ranges for a host."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_average_counts_every_probe(spark, ranges):
    rng = random.Random(1)
    rows = [("hot", k, rng.choice([0, 0, None, 5, 120, 900]) if k % 3 else 7) for k in range(6000)] + [("zero", k, 0) for k in range(4)] + [("late", 1, 3), ("late", 2, None)]
    want = {}
    for host, _, ms in rows:
        n, a = want.get(host, (0, None))
        want[host] = (n + 1, None if ms is None else float(ms) if not a else 0.3 * ms + 0.7 * a)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "mx_host string, id long, elapsed_ms int").withColumn("checked_at", F.timestamp_seconds("id"))
    got = {r["mx_host"]: (r["n"], r["average"]) for r in mx.running_average(df).collect()}
    assert {h: n for h, (n, _) in got.items()} == {h: n for h, (n, _) in want.items()}
    assert got["late"][1] is None and got["zero"][1] == 0 and got["hot"][1] == pytest.approx(want["hot"][1], abs=1e-9)


def test_throttle_folds_ranges(spark, ranges):
    rng = random.Random(2)
    rows, at = [], 0
    for k in range(5000):
        at += rng.choice([0, 1, 1, 4, 300])
        rows.append(("hot" if k % 4 else "cold", float(at), k, rng.choice([429, 403, 500, 500, 200] if k % 900 < 300 else [429, 500])))
    want = {}
    for host, at, _, code in rows:
        n, s, nxt = want.get(host, (0, 0, 0.0))
        s = s + 1 if code in (403, 429) else 0 if code == 200 else s
        want[host] = (n + 1, s, max(nxt, at) + (min(60.0, 3.0 * 2.0 ** min(s, 30)) if code in (403, 429) else 1.0))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "host string, at double, id long, status int")
    got = stateful.throttle(log)
    assert {r["host"]: (r["n"], r["strikes"], r["next_allowed"]) for r in got.collect()} == want
    assert "rangepartitioning" in plan(got) and "collect_list(struct(at" not in plan(got)
