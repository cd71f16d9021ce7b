"""Deliverability: evidence about an address -> (verify_status, verify_reason), and related rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _mapped(c: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Each synonym's group name; other values stay."""
    out = None
    for name, words in groups.items():
        out = F.when(c.isin(*words), name) if out is None else out.when(c.isin(*words), name)
    return out.otherwise(c)


#: Synonyms of each canonical outcome.
RCPT = {
    "deliverable": ("deliverable", "accept", "ok", "success"),
    "undeliverable": ("undeliverable", "hard_fail", "hardfail", "invalid"),
    "tempfail": ("tempfail", "temp_fail", "softfail", "soft_fail"),
    "timeout": ("timeout", "timed_out", "timedout"),
    "blocked": ("blocked", "blocked_by_provider"),
}
FALLBACK = {"deliverable": ("deliverable", "valid", "ok"), "undeliverable": ("undeliverable", "invalid", "bounce"), "unknown": ("unknown", "neutral")}
CATCH_ALL = {"unknown": ("tempfail", "no_mx", "error")}


def rcpt_category(c: Column) -> Column:
    return _mapped(_clean(c), RCPT)


def fallback_status(c: Column) -> Column:
    return _mapped(_clean(c), FALLBACK)


def catch_all_status(c: Column) -> Column:
    return _mapped(_clean(c), CATCH_ALL)


def code_class(code: Column) -> Column:
    """2xx accept, 5xx hard_fail, 4xx temp_fail, else unknown."""
    return F.when(code.between(200, 299), "accept").when(code.between(500, 599), "hard_fail").when(code.between(400, 499), "temp_fail").otherwise("unknown")


def catch_all_from_probe(code: Column, error: Column) -> Column:
    """The catch-all status that a random-address probe shows."""
    soft = F.lower(error).rlike("timeout|tempor")
    return F.when(code.between(200, 299), "catch_all").when(code.between(500, 599), "not_catch_all").when(code.between(400, 499) | soft, "tempfail").otherwise("error")


def classify(category: Column, code: Column, catch_all: Column, fallback: Column, verified_at: Column, now: Column, ttl_days: int = 90) -> Column:
    """struct(verify_status, verify_reason): the first rule that holds decides."""
    cat, ca, fb = rcpt_category(category), catch_all_status(catch_all), fallback_status(fallback)
    good = F.coalesce((cat == "deliverable") | code.between(200, 299), F.lit(False))
    hard = F.coalesce(cat == "undeliverable", F.lit(False)) | F.coalesce(code.between(500, 599), F.lit(False))
    good = F.coalesce(cat == "deliverable", F.lit(False)) | F.coalesce(code.between(200, 299), F.lit(False))
    soft = F.coalesce(cat.isin("tempfail", "timeout", "blocked"), F.lit(False)) | F.coalesce(code.between(400, 499), F.lit(False))
    alone = cat.isNull() & code.isNull()
    rules = [
        (now - verified_at > F.expr(f"INTERVAL '{ttl_days}' DAY"), "unknown_timeout", "stale_result_ttl_exceeded"),
        (hard & (fb == "deliverable"), "valid", "fallback_valid_overrides_rcpt_5xx"),
        (hard, "invalid", "rcpt_5xx_user_unknown"),
        (good & (ca == "not_catch_all") & (fb == "deliverable"), "valid", "rcpt_2xx_non_catchall_fallback_valid"),
        (good & (ca == "not_catch_all"), "valid", "rcpt_2xx_non_catchall"),
        (good & (ca == "catch_all") & (fb == "undeliverable"), "invalid", "rcpt_2xx_catchall_fallback_invalid"),
        (good & (ca == "catch_all"), "risky_catch_all", "rcpt_2xx_catchall"),
        (good & (fb == "deliverable"), "valid", "rcpt_2xx_catchall_unknown_fallback_deliverable"),
        (good & (fb == "undeliverable"), "risky_catch_all", "rcpt_2xx_catchall_unknown_fallback_invalid"),
        (good, "valid", "rcpt_2xx_catchall_unconfirmed"),
        (soft & (fb == "deliverable"), "valid", "fallback_valid_after_tempfail"),
        (soft & (fb == "undeliverable"), "invalid", "fallback_invalid_after_tempfail"),
        (soft & (ca == "catch_all"), "risky_catch_all", "catchall_softfail_no_fallback"),
        (soft, "unknown_timeout", "tempfail_or_timeout"),
        (alone & (fb == "deliverable"), "valid", "fallback_valid_no_smtp"),
        (alone & (fb == "undeliverable"), "invalid", "fallback_invalid_no_smtp"),
    ]
    out = None
    for condition, status, reason in rules:
        value = F.struct(F.lit(status).alias("verify_status"), F.lit(reason).alias("verify_reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.struct(F.lit("unknown_timeout").alias("verify_status"), F.lit("no_verification_attempt").alias("verify_reason")))


def should_test_send(hostile: Column, status: Column, requested: Column, category: Column, code: Column) -> Column:
    """Whether an unresolved address behind a probe-hostile host is worth a test message."""
    soft = rcpt_category(category).isin("tempfail", "timeout", "blocked") | code.between(400, 499)
    return F.coalesce(hostile, F.lit(False)) & (status == "unknown_timeout") & (F.coalesce(requested, F.lit("not_requested")) == "not_requested") & F.coalesce(soft, F.lit(False))


def mx_profile(n: Column, temp: Column, unknown: Column, hard: Column, mean_ms: Column) -> Column:
    """tarpit, fast or normal by a host's probe history."""
    slow = (n >= 4) & ((F.try_divide((temp + unknown).cast("double"), n) >= 0.5) | (mean_ms >= 800))
    fast = (n >= 5) & (mean_ms <= 150) & (F.try_divide(hard.cast("double"), n) < 0.05)
    return F.when(slow, "tarpit").when(fast, "fast").otherwise("normal")


def hard_bounce(code: Column, reason: Column) -> Column:
    """A permanent bounce because the mailbox doesn't exist."""
    return F.coalesce(code.startswith("5"), F.lit(False)) & (F.coalesce(code.startswith("5.1."), F.lit(False)) | F.coalesce(F.lower(reason).rlike("user[_ ]unknown"), F.lit(False)))


def dsn_code(raw: Column) -> Column:
    """The first enhanced status code of a delivery report, or NULL."""
    return F.nullif(F.regexp_extract(raw, r"\b([245]\.[0-9]{1,3}\.[0-9]{1,3})\b", 1), F.lit(""))


def dsn_reason(raw: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.rlike("user unknown|no such user|does not exist|unknown recipient|mailbox unavailable"), "user_unknown")
        .when(low.rlike("mailbox full|over quota|quota exceeded"), "mailbox_full")
        .when(low.rlike("spam|blocked|policy|blacklist"), "policy_block")
    )


def sequential_probe(code: Column, category: Column, catch_all: Column) -> Column:
    """struct(status, reason) of one probe in the sequential walk: by category, or else by code; a 2xx counts by what is known of the domain."""
    known = F.lower(F.trim(catch_all))
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    accepted = F.when(known == "catch_all", told("risky_catch_all", "rcpt_2xx_catchall")).when(known == "not_catch_all", told("valid", "rcpt_2xx_accepted")).otherwise(told("valid", "rcpt_2xx_catchall_unconfirmed"))
    return (
        F.when(category == "accept", accepted)
        .when(category.isin("reject", "hard_fail"), told("invalid", "rcpt_rejected"))
        .when(category == "temp_fail", told("temp_fail", "temp_fail"))
        .when(category == "block", told("unknown", "blocked"))
        .when(code.between(200, 299), accepted)
        .when(code.between(500, 599), told("invalid", "rcpt_5xx_rejected"))
        .when(code.between(400, 499), told("temp_fail", "smtp_temp_error"))
        .otherwise(told("unknown", "unknown"))
    )


#: Keys of the behaviour hint, the first that is there counts.
HOSTILE_KEYS = ("probing_hostile", "probe_hostile", "probe_hostile_mx")


def probe_hostile(behaviour: Column) -> Column:
    """Whether a host's behaviour (JSON text) says that it dislikes probing."""
    held = F.from_json(behaviour, "map<string,string>")
    first = F.coalesce(*[F.when(F.map_contains_key(held, k), F.coalesce(F.try_element_at(held, F.lit(k)), F.lit(""))) for k in HOSTILE_KEYS])
    return F.coalesce(~F.lower(first).isin("", "false", "0", "null"), F.lit(False))
