"""Behaviour of mail hosts: windows of probes, nearest-rank percentiles, a running average."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.operators import folds

#: Probes of a host that count, share of a new value in the running average, limits of a tarpit.
NEWEST, ALPHA, SLOW_MS, TEMP_RATE = 5000, 0.3, 2000, 0.30


def percentile(sorted_values: Column, p: float) -> Column:
    """The value at index round-half-even(p/100 * (n-1)) of an ascending array; NULL for none."""
    at = F.bround((F.size(sorted_values) - 1) * F.lit(p) / 100.0, 0).cast("int")
    return F.when(F.size(sorted_values) > 0, F.try_element_at(sorted_values, at + 1))


def newest(probes: DataFrame, since: Column, n: int = NEWEST) -> DataFrame:
    """The n newest probes of each host since a time."""
    w = Window.partitionBy("mx_host").orderBy(F.desc("checked_at"), F.desc("id"))
    return probes.where(F.col("checked_at") >= since).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def window_stats(probes: DataFrame, since: Column) -> DataFrame:
    """n, p50, p95, temporary-failure and success rate (3 places) and whether the host is a tarpit."""
    ok, temp = F.count_if(F.col("rcpt_code").between(200, 299)), F.count_if(F.col("rcpt_code").between(400, 499))
    g = newest(probes, since).groupBy("mx_host").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("elapsed_ms")).alias("ms"), temp.alias("temp"), ok.alias("ok"))
    out = g.select("mx_host", "n", percentile(F.col("ms"), 50).alias("p50"), percentile(F.col("ms"), 95).alias("p95"), F.round(F.col("temp") / F.col("n"), 3).alias("temp_rate"), F.round(F.col("ok") / F.col("n"), 3).alias("success_rate"))
    return out.withColumn("tarpit", (F.col("p95") > SLOW_MS) | (F.col("temp_rate") > TEMP_RATE))


def running_average(probes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(mx_host, n, average) with average = 0.3 * new + 0.7 * previous in time order, over all probes; a previous 0 or null counts as missing.

    before: what earlier probes gave, to go on from; its hosts without new probes stay as they are.

    A range of probes is n, what it gives from nothing (fresh), and base and decay:
    it takes a previous p to base + decay * p. A null resets, so after one both agree.
    """

    def add(state: tuple, batch: pa.RecordBatch) -> tuple:
        n, fresh, base, decay, _ = state
        for x in folds.doubles(batch, "ms").tolist():
            if x != x:
                fresh = base = decay = 0.0
            else:
                fresh = ALPHA * x + (1 - ALPHA) * fresh if fresh else x
                base, decay = (ALPHA * x + (1 - ALPHA) * base, (1 - ALPHA) * decay) if decay or base else (x, 0.0)
        return n + batch.num_rows, fresh, base, decay, x != x

    finish = lambda s: {"rows": s[0], "fresh": s[1], "base": s[2], "decay": s[3], "none": s[4]}
    own = probes.select("mx_host", "checked_at", "id", F.col("elapsed_ms").alias("ms"))
    g = folds.summaries(own, "mx_host", ["checked_at", "id", "ms"], lambda: (0, 0.0, 0.0, 1.0, False), add, finish, "rows long, fresh double, base double, decay double, none boolean")
    if before is None:
        g = g.withColumns({"held": F.lit(0).cast("long"), "prev": F.lit(0.0)})
    else:
        old = before.select(F.col("mx_host").alias("host"), F.col("n").alias("held"), F.col("average").alias("prev"))
        g = g.join(old, F.col("mx_host").eqNullSafe(F.col("host")), "full").select(F.coalesce("mx_host", "host").alias("mx_host"), "blocks", F.coalesce("held", F.lit(0)).alias("held"), "prev")
    step = lambda prev, x: F.when(prev == 0, x["fresh"]).otherwise(x["base"] + x["decay"] * prev)
    n = F.aggregate("blocks", F.col("held"), lambda a, x: a + x["rows"])
    # a null newest probe leaves no average
    average = F.when(~F.element_at("blocks", -1)["none"], F.aggregate("blocks", F.coalesce("prev", F.lit(0.0)), step))
    new = F.col("blocks").isNotNull()
    return g.select("mx_host", F.when(new, n).otherwise(F.col("held")).alias("n"), F.when(new, average).otherwise(F.col("prev")).alias("average"))
