"""Effects of test sends on verification results, and the next address to try."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import names

#: Reasons that bounces and deliveries leave.
HARD_REASON, DEFAULT_HARD, DEFAULT_SOFT, DELIVERED_REASON = "hard_bounce_user_unknown", "hard_bounce", "soft_bounce", "no_bounce_after_test_send"
UNSETTLED = ("unknown_timeout", "risky_catch_all")


def apply_bounces(results: DataFrame, bounces: DataFrame, update_status: bool = True) -> DataFrame:
    """results with the bounce of their token: test_send_status, bounce_code, bounce_reason; a hard one makes the address invalid.

    bounces: token, code, reason, is_hard, one row a token (of several the hard one, then the least code counts).
    """
    order = F.struct((~F.col("is_hard")).alias("soft"), F.coalesce("code", F.lit("")).alias("code"))
    one = bounces.groupBy("token").agg(F.min_by(F.struct("code", "reason", "is_hard"), order).alias("__b"))
    out = results.join(one, "token", "left")
    hit, hard = F.col("__b").isNotNull(), F.coalesce(F.col("__b.is_hard"), F.lit(False))
    fallback = F.when(hard, DEFAULT_HARD).otherwise(DEFAULT_SOFT)
    told = {
        "test_send_status": F.when(hit, F.when(hard, "bounce_hard").otherwise("bounce_soft")).otherwise(F.col("test_send_status")),
        "bounce_code": F.when(hit, F.coalesce("__b.code", F.lit(""))),
        "bounce_reason": F.when(hit, F.coalesce(F.nullif(F.col("__b.reason"), F.lit("")), fallback)),
    }
    if update_status:
        told |= {"verify_status": F.when(hard, "invalid").otherwise(F.col("verify_status")), "verify_reason": F.when(hard, HARD_REASON).otherwise(F.col("verify_reason"))}
    return out.withColumns(told).drop("__b")


def assume_delivered(results: DataFrame, now: Column, hours: int = 24, update_status: bool = True) -> DataFrame:
    """results in which what was sent at least ``hours`` ago counts as delivered; an unsettled address becomes valid."""
    late = F.coalesce((F.col("test_send_status") == "sent") & (F.col("test_send_at") <= now - F.make_dt_interval(hours=F.lit(hours))), F.lit(False))
    told = {"test_send_status": F.when(late, "delivered_assumed").otherwise(F.col("test_send_status"))}
    if update_status:
        raised = late & (F.col("verify_status").isNull() | F.col("verify_status").isin(*UNSETTLED))
        told |= {"verify_status": F.when(raised, "valid").otherwise(F.col("verify_status")), "verify_reason": F.when(raised, DELIVERED_REASON).otherwise(F.col("verify_reason"))}
    return results.withColumns(told)


def next_candidates(emails: DataFrame, people: DataFrame, results: DataFrame, bounced: DataFrame) -> DataFrame:
    """(bounced_id, email_id, result_id, email, pattern): of a bounced address's person and domain, the best unsettled address not sent to yet.

    emails: id, person_id, email; people: id, first_name, last_name; results: id,
    email_id, verify_status, test_send_status (the largest id of an address counts); bounced: id of emails. Best is the first
    pattern that gives the local part, then the local part itself.
    """
    last = results.groupBy("email_id").agg(F.max_by(F.struct(F.col("id").alias("result_id"), "verify_status", "test_send_status"), "id").alias("r")).select("email_id", "r.*")
    sent = F.lower(F.trim(F.coalesce("test_send_status", F.lit(""))))
    open_ = last.where(F.lower(F.trim("verify_status")).isin(*UNSETTLED) & sent.isin("", "not_requested"))
    keyed = emails.where(F.col("email").contains("@")).select(F.col("id").alias("email_id"), "person_id", "email", em.domain_tail(F.col("email")).alias("domain"), em.local(F.col("email")).alias("local"))
    fn, ln = names.ascii_fold(F.coalesce("first_name", F.lit(""))), names.ascii_fold(F.coalesce("last_name", F.lit("")))
    folded = people.select(F.col("id").alias("person_id"), fn.alias("fn"), ln.alias("ln"))
    own = keyed.where("local <> ''").join(open_, "email_id").join(folded, "person_id")
    patterns = em.followed(F.col("local"), F.col("fn"), F.col("ln"))
    ranked = own.withColumn("pattern", F.try_element_at(patterns, F.lit(1)))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, em.PATTERNS)), F.col("pattern")), F.lit(99))
    best = ranked.groupBy("person_id", "domain").agg(F.min_by(F.struct("email_id", "result_id", "email", "pattern"), F.struct(place.alias("p"), "local", "email_id")).alias("best"))
    asked = bounced.select(F.col("id").alias("email_id")).join(keyed, "email_id").select(F.col("email_id").alias("bounced_id"), "person_id", "domain")
    return asked.join(best, ["person_id", "domain"]).select("bounced_id", "best.*")
