"""Candidates to stored people and addresses: two dependent upserts in one versioned snapshot, safe to repeat."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import gates
from leadlens.operators.selection import name_key

#: Fixed value: the title of a person found without one.
FOUND_TITLE = "Auto-discovered"
PEOPLE = "id long, company_id long, full_name string, title string, source_url string"
EMAILS = "id long, tenant string, email string, person_id long, company_id long, source_url string"


def _id(*parts: Column) -> Column:
    """A positive id made of a key: the same in every run, so a repeated run names the same rows."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def people_of(candidates: DataFrame) -> DataFrame:
    """``PEOPLE`` of candidates (company_id, tenant, name, email, title, url): one a company and name, with its longest title."""
    own = candidates.where(name_key(F.col("name")).isNotNull() & gates.person_name_reason(F.col("name")).isNull())
    key = F.struct(F.length(F.coalesce("title", F.lit(""))), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), "name")
    best = own.groupBy("company_id", name_key(F.col("name")).alias("key")).agg(F.max_by(F.struct("name", "title", "url"), key).alias("b"))
    title = F.coalesce(F.nullif(F.trim("b.title"), F.lit("")), F.lit(FOUND_TITLE))
    return best.select(_id(F.lit("person"), F.col("company_id"), F.col("key")).alias("id"), "company_id", F.col("b.name").alias("full_name"), title.alias("title"), F.col("b.url").alias("source_url"))


def merged_people(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Stored people and those that are new by company and name; a stored one keeps its row, but for a title that was only assumed."""
    key = name_key(F.col("full_name")).alias("key")
    new = people_of(candidates).withColumn("key", key)
    stored = people.select("*", key)
    titles = new.where(F.col("title") != FOUND_TITLE).select("company_id", "key", F.col("title").alias("better"))
    kept = stored.join(titles, ["company_id", "key"], "left").withColumn("title", F.when(F.col("title") == FOUND_TITLE, F.coalesce("better", "title")).otherwise(F.col("title")))
    fresh = new.join(stored.select("company_id", "key"), ["company_id", "key"], "left_anti")
    names = [c.split()[0] for c in PEOPLE.split(", ")]
    return kept.select(names).unionByName(fresh.select(names))


def merged_emails(candidates: DataFrame, people: DataFrame, emails: DataFrame) -> DataFrame:
    """Stored addresses and those that are new by tenant and address; people: as merged. A role's address belongs to nobody; a stored one gets a person if it has none."""
    mail = F.lower(F.trim("email"))
    own = candidates.where(F.coalesce(mail, F.lit("")) != "").withColumns({"email": mail, "key": name_key(F.col("name"))})
    best = own.groupBy("tenant", "email").agg(F.min_by(F.struct("company_id", "key", "url"), F.struct(F.col("key").isNull(), "company_id", "key", "url")).alias("b"))
    role = em.role_like(F.col("email")) | gates.is_role_email(F.col("email"))
    found = best.select("tenant", "email", "b.company_id", F.when(~role, F.col("b.key")).alias("key"), F.col("b.url").alias("source_url"))
    keyed = people.groupBy("company_id", name_key(F.col("full_name")).alias("key")).agg(F.min("id").alias("person_id"))
    found = found.join(keyed, ["company_id", "key"], "left").select(_id(F.lit("email"), F.col("tenant"), F.col("email")).alias("id"), "tenant", "email", "person_id", "company_id", "source_url")
    owner = found.where("person_id is not null").select("tenant", "email", F.col("person_id").alias("owner"))
    kept = emails.join(owner, ["tenant", "email"], "left").withColumn("person_id", F.coalesce("person_id", "owner"))
    fresh = found.join(emails.select("tenant", "email"), ["tenant", "email"], "left_anti")
    names = [c.split()[0] for c in EMAILS.split(", ")]
    return kept.select(names).unionByName(fresh.select(names))


def _manifest(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    """The last whole version and its tables' folders; (0, {}) before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0, {}
    whole = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not whole:
        return 0, {}
    last = max(whole, key=lambda p: int(p.getName()))
    return int(last.getName()), json.loads(spark.read.text(last.toString()).first()["value"])


def snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """people and emails of the last whole version in folder ``base``; empty before the first."""
    _, held = _manifest(spark, base)
    return {name: spark.read.schema(schema).parquet(held[name]) if held else spark.createDataFrame([], schema) for name, schema in (("people", PEOPLE), ("emails", EMAILS))}


def persist(candidates: DataFrame, base: str) -> int:
    """Upsert people, then addresses, of candidates into folder ``base``; the number of the version that holds them.

    A version is its manifest, written after both tables: a run that is lost in
    between leaves nothing that is read, and repeating it gives the same rows
    with the same ids. Older versions stay for readers that have them open. One
    writer at a time: a second would take the same number and fail.
    """
    spark = candidates.sparkSession
    version, _ = _manifest(spark, base)
    held = snapshot(spark, base)
    run = uuid.uuid4().hex
    paths = {name: f"{base}/{name}/{version + 1}_{run}" for name in held}
    merged_people(candidates, held["people"]).write.parquet(paths["people"])
    people = spark.read.schema(PEOPLE).parquet(paths["people"])
    merged_emails(candidates, people, held["emails"]).write.parquet(paths["emails"])
    spark.createDataFrame([(json.dumps(paths),)], "value string").coalesce(1).write.text(f"{base}/manifest/{version + 1}")
    return version + 1
