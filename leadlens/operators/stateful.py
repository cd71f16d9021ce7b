"""Time-driven state as batch operators: quotas, throttles, test sends, upserts, dedup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.functions import status
from leadlens.operators import folds
from leadlens.operators.latest import first_by

#: Seconds of a throttle's gap, first and greatest backoff; a test send counts as delivered after so many hours.
GAP, BACKOFF, MOST, DELIVERED_HOURS = 1.0, 3.0, 60.0, 24


def rolling_usage(events: DataFrame, amount: Column, hours: int = 24) -> DataFrame:
    """events with the sum of ``amount`` over the last hours of the same user, the event's own included."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-hours * 3600 * 1_000_000, 0)
    return events.withColumn("used", F.sum(amount).over(w))


def trim_to_quota(items: DataFrame, left: DataFrame, limit: int) -> DataFrame:
    """The first items (by position) of each user within the limit and what is left of the quota."""
    w = Window.partitionBy("user_id").orderBy("position")
    own = items.join(left, "user_id", "left").withColumn("n", F.row_number().over(w))
    return own.where(F.col("n") <= F.least(F.lit(limit), F.greatest(F.lit(0), F.coalesce("remaining", F.lit(limit))))).drop("n")


def throttle(log: DataFrame, gap: float = GAP, base: float = BACKOFF, most: float = MOST) -> DataFrame:
    """(host, n, strikes, next_allowed): a fold over each host's fetches in time order.

    A refusal (403, 429) adds a strike and waits min(most, base * 2**strikes); a
    success clears strikes and waits the gap; anything else waits the gap.

    A range of fetches takes ``next`` to max(next + wait, floor), with a wait and a
    floor for each number of strikes before it (beyond the last, waits no longer grow).
    """
    top = next((k for k in range(31) if base * 2.0**k >= most), 30)

    def add(state: tuple, batch: pa.RecordBatch) -> tuple:
        n, cleared, more, wait, floor = state
        at, code = folds.doubles(batch, "at"), folds.doubles(batch, "status")
        refused, ok = (code == 403) | (code == 429), (code >= 200) & (code <= 299)
        count = np.cumsum(refused)
        since = np.maximum.accumulate(np.where(ok, count, -1))  # refusals up to the last success, -1 before any
        before = np.arange(top + 1)[:, None] * (not cleared) + more
        strikes = np.where(since < 0, before + count, count - since)
        waits = np.where(refused, np.minimum(most, base * 2.0 ** np.minimum(strikes, 30)), gap)
        left = np.cumsum(waits[:, ::-1], axis=1)[:, ::-1]
        reached = (np.where(np.isnan(at), -np.inf, at) + left).max(axis=1)
        done = bool(ok.any())
        more = int(count[-1] - since[-1]) if done else more + int(count[-1])
        return n + batch.num_rows, cleared or done, more, wait + left[:, 0], np.maximum(floor + left[:, 0], reached)

    start = lambda: (0, False, 0, np.zeros(top + 1), np.full(top + 1, -np.inf))
    finish = lambda s: {"rows": s[0], "cleared": s[1], "more": s[2], "wait": s[3].tolist(), "floor": s[4].tolist()}
    g = folds.summaries(log.select("host", "at", "id", "status"), "host", ["at", "id", "status"], start, add, finish, "rows long, cleared boolean, more int, wait array<double>, floor array<double>")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("next"), F.lit(0).alias("strikes"))

    def step(state, x):
        k = F.least(state["strikes"], F.lit(top)) + 1
        after = F.greatest(state["next"] + F.element_at(x["wait"], k), F.element_at(x["floor"], k))
        strikes = F.when(x["cleared"], x["more"]).otherwise(state["strikes"] + x["more"])
        return F.struct((state["n"] + x["rows"]).alias("n"), after.alias("next"), strikes.alias("strikes"))

    out = g.select("host", F.aggregate("blocks", zero, step).alias("f"))
    return out.select("host", F.col("f.n").alias("n"), F.col("f.strikes").alias("strikes"), F.col("f.next").alias("next_allowed"))


def test_sends(events: DataFrame, now: Column, hours: int = DELIVERED_HOURS) -> DataFrame:
    """(token, state): requested, sent, bounce_hard, bounce_soft, or delivered_assumed when nothing came back in time.

    events: token, ts, kind (requested, sent, bounce), code, reason.
    """
    sent, bounce = F.col("kind") == "sent", F.col("kind") == "bounce"
    hard = bounce & status.hard_bounce(F.col("code"), F.col("reason"))
    g = events.groupBy("token").agg(F.max(F.when(sent, F.col("ts"))).alias("sent_at"), F.bool_or(hard).alias("hard"), F.bool_or(bounce).alias("any"))
    state = F.when(F.col("hard"), "bounce_hard").when(F.col("any"), "bounce_soft").when(F.col("sent_at").isNull(), "pending").when(F.col("sent_at") < now - F.expr(f"INTERVAL '{hours}' HOUR"), "delivered_assumed").otherwise("sent")
    return g.select("token", state.alias("state"))


def upsert_companies(rows: DataFrame) -> DataFrame:
    """One row per key (domain, else name): for each column the first value that isn't blank, in id order.

    The key's values are aggregated (min_by over non-blank rows), not windowed, so a hot key combines before the shuffle.
    """
    key = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.nullif(F.trim("name"), F.lit("")))
    first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.col("id"))).alias(c)
    return rows.withColumn("key", key).where("key is not null").groupBy("key").agg(F.min("id").alias("id"), *[first(c) for c in ("name", "domain", "website")])


def richer(rows: DataFrame) -> DataFrame:
    """One row per (email, lower name): the longest snippet, the first on ties."""
    return first_by(rows, ["email", "name"], [F.desc(F.length("snippet")), F.asc("id")])


def append_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both tables, of each key the one with the greatest version; new wins ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_by(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def concurrency(spans: DataFrame) -> DataFrame:
    """(key, most): the greatest number of spans (start, stop) open together; ends come before starts at the same time."""
    marks = spans.select("key", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("key", "x.*")
    per = marks.groupBy("key", "at", "d").agg(F.sum("d").alias("d2"))
    w = Window.partitionBy("key").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("open", F.sum("d2").over(w)).groupBy("key").agg(F.max("open").alias("most"))


def completed_runs(done: DataFrame, totals: DataFrame) -> DataFrame:
    """(run_id, n_done, total, complete): a run is complete when all its companies are done, each counted once."""
    n = done.groupBy("run_id").agg(F.count_distinct("company_id").alias("n_done"))
    return totals.join(n, "run_id", "left").select("run_id", F.coalesce("n_done", F.lit(0)).alias("n_done"), "total", (F.coalesce("n_done", F.lit(0)) >= F.col("total")).alias("complete"))
