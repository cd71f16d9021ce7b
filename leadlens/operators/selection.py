"""What of a company's candidates goes on: prefilter with counts, gates with counts, people and role addresses apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import emails, gates, url_rules, urls

#: Fixed value: candidates of a company that are kept.
MOST = 50
STEPS = ("press_news", "non_person_name", "locale_duplicate", "name_dedup", "cap_exceeded")


def name_key(name: Column) -> Column:
    """Lower case with single spaces; null if blank."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " ")), F.lit(""))


def _order(name: Column, columns: list[str]) -> list[Column]:
    """Best first: with an address, a leader's title, any title, a page without a locale, by name; then by page, address, id, name and title, so ties have one order."""
    title = F.coalesce("title", F.lit(""))
    last = lambda hit: F.when(hit, 0).otherwise(1)
    return [last(F.coalesce("email", F.lit("")) != ""), last(gates.has_leadership_title(title)), last(title != ""), F.when(urls.is_locale_url(F.col("url")), 1).otherwise(0), name, F.col("url").asc_nulls_first(), F.col("email").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("id", "name", "title") if c in columns]]


def steps(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Each candidate (company, url, name, email, title) with ``step``: the first of ``STEPS`` that drops it; null if it is kept.

    Pages of news go; then candidates without an address whose name is none; of
    equal names on one path (locales aside) the best stays, then of equal names;
    nameless ones go with these; at last what a company has beyond ``most``. Names
    decide within a company. Windows run over what is left before them only.
    """
    key = name_key(F.col("name"))
    addressed = F.coalesce("email", F.lit("")) != ""
    early = F.when(url_rules.is_news(F.col("url")), STEPS[0]).when(~addressed & (key.isNull() | gates.person_name_reason(F.col("name")).isNotNull()), STEPS[1])
    rows = candidates.withColumns({"key": key, "step": early, "path": urls.path_without_locale(F.col("url"))})
    left = F.col("step").isNull()
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*_order(F.col("key"), candidates.columns)))
    named = left & F.col("key").isNotNull()
    rows = rows.withColumn("step", F.coalesce("step", F.when(named & (first("company", named, "key", "path") > 1), STEPS[2])))
    left = F.col("step").isNull()
    named = left & F.col("key").isNotNull()
    rows = rows.withColumn("step", F.coalesce("step", F.when(F.col("key").isNull() | (first("company", named, "key") > 1), STEPS[3])))
    left = F.col("step").isNull()
    rows = rows.withColumn("step", F.coalesce("step", F.when(first("company", left) > most, STEPS[4])))
    return rows.drop("key", "path")


def prefilter(candidates: DataFrame, most: int = MOST) -> DataFrame:
    return steps(candidates, most).where("step is null").drop("step")


def prefilter_counts(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """company, input_total, removed_* of each of ``STEPS``, output_total."""
    own = steps(candidates, most)
    return own.groupBy("company").agg(F.count("*").alias("input_total"), *[F.count_if(F.col("step").eqNullSafe(s)).alias(f"removed_{s}") for s in STEPS], F.count_if(F.col("step").isNull()).alias("output_total"))


def gated(candidates: DataFrame) -> DataFrame:
    """Candidates with ``reason``: why the gates refuse one; null if they pass it."""
    return candidates.withColumn("reason", gates.candidate_reason(F.col("name"), F.col("email")))


def gate_counts(candidates: DataFrame) -> DataFrame:
    """company, passed, rejected, and how many reasons (without what follows a colon) there were."""
    own = gated(candidates).withColumn("reason", F.split_part("reason", F.lit(":"), F.lit(1)))
    return own.groupBy("company").agg(F.count_if(F.col("reason").isNull()).alias("passed"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_distinct("reason").alias("reasons"))


def split_roles(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, role addresses): a role's address never becomes a person's."""
    role = F.coalesce(emails.role_like(F.col("email")) | gates.is_role_email(F.col("email")), F.lit(False))
    return candidates.where(~role), candidates.where(role)
