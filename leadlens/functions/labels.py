"""Labels of verified addresses, and the order in which a person's primary address is chosen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TESTED_REASON = "no_bounce_after_test_send"
SOURCES = ("extracted", "seed", "generated")
ROLE_WORDS = ("info", "contact", "support", "sales", "hello", "team", "office")


def base_label(status: Column, reason: Column) -> Column:
    s = F.lower(status)
    return (
        F.when((s == "valid") & (F.lower(F.coalesce(reason, F.lit(""))) == TESTED_REASON), "valid_catchall_tested")
        .when(s == "valid", "valid_native")
        .when(s.isin("invalid", "risky_catch_all", "unknown_timeout"), s)
        .otherwise("unknown")
    )


def full_label(status: Column, reason: Column, primary: Column) -> Column:
    """The base label, with _primary or _alternate for valid addresses whose rank is known."""
    base = base_label(status, reason)
    return F.when(base.startswith("valid") & primary.isNotNull(), F.concat(base, F.when(primary, "_primary").otherwise("_alternate"))).otherwise(base)


def source_rank(source: Column) -> Column:
    s = F.lower(F.nullif(source, F.lit("")))
    out = F.when(s.isNull(), len(SOURCES) + 1)
    for k, name in enumerate(SOURCES):
        out = out.when(s == name, k)
    return out.otherwise(len(SOURCES))


def human_score(email: Column, first: Column, last: Column) -> Column:
    """Lower is more like a person's own address."""
    local = F.lower(F.split_part(email, F.lit("@"), F.lit(1)))
    fn, ln = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "") for c in (first, last))
    f1 = F.substring(fn, 1, 1)
    both = (fn != "") & (ln != "")
    exact = both & local.isin(F.concat(fn, F.lit("."), ln), F.concat(fn, F.lit("_"), ln), F.concat(fn, ln), F.concat(f1, ln), F.concat(f1, F.lit("."), ln), F.concat(f1, F.lit("_"), ln))
    starts = F.lit(False)
    for w in ROLE_WORDS:
        starts = starts | local.startswith(w)
    zero = F.lit(0)
    return (
        F.when(local.isin(*ROLE_WORDS), 40).otherwise(zero)
        + F.when(starts, 20).otherwise(zero)
        + F.when(F.length(local) <= 3, 5).otherwise(zero)
        + F.when(local.rlike("[0-9]"), 5).otherwise(zero)
        + F.when(exact, -15).otherwise(F.when((ln != "") & local.contains(ln), -5).otherwise(zero) + F.when((fn != "") & local.contains(fn), -3).otherwise(zero))
    )
