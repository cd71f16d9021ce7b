"""Times to live, retries, and small ordered lists of mail hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that a stored page counts without other word; that a catch-all verdict counts, and a failed one.
DEFAULT_AGE, VERDICT_AGE, FAILED_AGE = 3600, 86_400, 300


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def cache_expiry(fetched: Column, control: Column, expires: Column, default: int = DEFAULT_AGE) -> Column:
    """When a fetched page expires: NULL with no-store, else by max-age, else the Expires time, else ``default`` seconds on."""
    low = F.lower(F.coalesce(control, F.lit("")))
    age = F.regexp_extract(low, r"max-age *= *([0-9]{1,9})", 1)
    return F.when(low.contains("no-store"), F.lit(None).cast("timestamp_ntz")).when(age != "", fetched + _seconds(F.when(age != "", age).cast("int"))).otherwise(F.coalesce(expires, fetched + _seconds(F.lit(default))))


def verdict_fresh(state: Column, checked: Column, now: Column) -> Column:
    """Whether a catch-all verdict still counts: a day, five minutes for failures; without a time it doesn't."""
    age = F.when(state.isin("tempfail", "error"), FAILED_AGE).otherwise(VERDICT_AGE)
    return F.coalesce(checked + _seconds(age) >= now, F.lit(False))


def backoff(strikes: Column, base: float, most: float) -> Column:
    """Longest wait before a retry: base doubled with every strike, ``most`` at most (the exponent is bounded too)."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(strikes, F.lit(30))))


def mail_hosts(records: Column) -> Column:
    """array<struct(preference, host)> in order: blank hosts dropped, closing dots off, lower case."""
    clean = F.transform(records, lambda x: F.struct(x["preference"].alias("preference"), F.lower(F.regexp_replace(F.trim(x["host"]), "\\.+$", "")).alias("host")))
    return F.array_sort(F.filter(clean, lambda x: F.coalesce(x["host"] != "", F.lit(False))))
