"""Readers of lead files, bounce reports, suppression lists and configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions import emails as em
from leadlens.functions import status

LEADS = ("company", "domain", "role", "first_name", "last_name", "full_name", "title", "source_url", "notes", "user_supplied_domain")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones NULL, others cast as far as they go."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def lead_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in LEADS])


def csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lead rows of CSV files with a header (a byte-order mark is dropped); missing cells are blank, unknown columns left out."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(paths)
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return conform(clean, lead_schema()).na.fill("")


def jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lead rows of JSON lines; blank lines are skipped, unknown keys ignored."""
    return spark.read.schema(lead_schema()).json(paths).where(" or ".join(f"{c} is not null" for c in LEADS))


def leads(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending."""
    low = path.lower()
    if low.endswith(".csv"):
        return csv(spark, path)
    if low.endswith((".jsonl", ".ndjson")):
        return jsonl(spark, path)
    raise ValueError(f"neither CSV nor JSON lines: {path}")


def viable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a valid address or a domain is needed; rejected rows carry their reasons and themselves as JSON."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    email, domain = text("email"), F.coalesce(text("domain"), text("user_supplied_domain"), text("source_url"))
    bad = email.isNotNull() & ~email.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    good = email.isNotNull() & ~bad
    reasons = F.array_compact(F.array(F.when(bad, "invalid:email"), F.when(~F.coalesce(good, F.lit(False)) & domain.isNull(), "missing:domain_or_email")))
    marked = rows.withColumn("reasons", reasons)
    ok = F.coalesce(good, F.lit(False)) | domain.isNotNull()
    return marked.where(ok).drop("reasons"), marked.where(~ok).select("reasons", F.to_json(F.struct(*rows.columns)).alias("row"))


def suppression(spark: SparkSession, path: str) -> DataFrame:
    """(email, reason) of a CRM export; blank addresses are skipped, a blank reason is crm_sync."""
    raw = spark.read.option("header", True).csv(path)
    reason = F.coalesce(F.nullif(F.trim(F.col("reason")), F.lit("")), F.lit("crm_sync")) if "reason" in raw.columns else F.lit("crm_sync")
    return raw.select(F.lower(F.trim("email")).alias("email"), reason.alias("reason")).where("email is not null and email <> ''").dropDuplicates(["email"])


def bounces(messages: DataFrame) -> DataFrame:
    """Raw delivery reports (id, raw) -> code, reason, whether the mailbox doesn't exist, the test token and the recipients."""
    raw = F.col("raw")
    code, why = status.dsn_code(raw), status.dsn_reason(raw)
    token = F.nullif(F.regexp_extract(raw, r"(?i)x-test-token:\s*(\S+)", 1), F.lit(""))
    to = F.regexp_extract_all(F.lower(raw), F.lit(r"final-recipient:\s*rfc822;\s*(" + em.EMAIL + ")"), F.lit(1))
    return messages.select("id", code.alias("code"), why.alias("reason"), status.hard_bounce(code, why).alias("hard"), token.alias("token"), F.array_distinct(to).alias("recipients"))


def notifications(messages: DataFrame) -> DataFrame:
    """JSON bounce notifications (id, body) -> one row per bounced recipient; damaged JSON gives none."""
    schema = "notificationType string, bounce struct<bounceType:string, bouncedRecipients:array<struct<emailAddress:string, status:string, diagnosticCode:string>>>, mail struct<messageId:string>"
    n = messages.select("id", F.from_json("body", schema).alias("n")).where("n.notificationType = 'Bounce'")
    r = n.select("id", F.col("n.mail.messageId").alias("message_id"), F.col("n.bounce.bounceType").alias("kind"), F.explode("n.bounce.bouncedRecipients").alias("r"))
    return r.select("id", "message_id", "kind", F.lower("r.emailAddress").alias("email"), F.col("r.status").alias("code"), status.dsn_reason(F.col("r.diagnosticCode")).alias("reason"))


def newest_pages(pages: DataFrame) -> DataFrame:
    """Of each URL the page fetched last; the larger id on ties."""
    return pages.groupBy("url").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "url"]), F.struct("fetched_at", "page_id")).alias("s")).select("url", "s.*")


def config(text: str) -> dict:
    """A configuration given as JSON or, if that package is there, as YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public suffix list: one a line, up to the first blank; comments (//) and empty lines left out."""
    line = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//|$)")).select(line.alias("rule"))
