"""Counts and rates over runs, verification results and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("valid", "invalid", "risky_catch_all", "unknown_timeout")


def rate(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def verification_stats(latest: DataFrame) -> DataFrame:
    """Addresses by status and the valid rate among decided ones, in one row."""
    n = {s: F.count_if(F.col("verify_status") == s) for s in VERDICTS}
    return latest.agg(F.count("*").alias("total"), *[c.alias(s) for s, c in n.items()], rate(n["valid"], n["valid"] + n["invalid"] + n["risky_catch_all"]).alias("valid_rate"))


def time_series(rows: DataFrame, since: Column) -> DataFrame:
    """Verification results by day; days without results are left out."""
    day = F.date_format(F.coalesce("verified_at", "checked_at"), "yyyy-MM-dd")
    ok, bad, risky = (F.count_if(F.col("verify_status") == s) for s in VERDICTS[:3])
    own = rows.where(F.col("verify_status").isNotNull() & (F.coalesce("verified_at", "checked_at") >= since))
    return own.groupBy(day.alias("day")).agg(F.count("*").alias("total"), ok.alias("valid"), bad.alias("invalid"), risky.alias("risky"), rate(ok, ok + bad + risky).alias("valid_rate"))


def breakdown(rows: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """The n most frequent values of a key with their valid rates; ties by value."""
    ok, bad, risky = (F.count_if(F.col("verify_status") == s) for s in VERDICTS[:3])
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("total"), ok.alias("valid"), bad.alias("invalid"), risky.alias("risky"), rate(ok, ok + bad + risky).alias("valid_rate")).orderBy(F.desc("total"), name).limit(n)


def risk_level(latest: DataFrame, emails: DataFrame) -> DataFrame:
    """(domain, n_emails, risk_level): risky before unknown; addresses without any status are unknown, no address none."""
    joined = emails.join(latest.select(F.col("email_id").alias("id"), "verify_status"), "id", "left")
    s = F.col("verify_status")
    g = joined.groupBy("domain").agg(F.count("*").alias("n_emails"), F.count("verify_status").alias("n_status"), F.max(s.startswith("risky")).alias("risky"), F.max(s.startswith("unknown") | s.startswith("temp")).alias("unknown"))
    level = F.when(F.col("risky"), "risky").when(F.col("unknown"), "unknown").when((F.col("n_emails") > 0) & (F.col("n_status") == 0), "unknown").otherwise("none")
    return g.select("domain", "n_emails", level.alias("risk_level"))


def user_run_stats(runs: DataFrame, n: int) -> DataFrame:
    """Users with the most runs."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "running", "failed")]
    return runs.groupBy("user_id").agg(F.count("*").alias("total"), *counts, F.max("created_at").alias("last_run")).orderBy(F.desc("total"), "user_id").limit(n)
