"""Writers of leads, search documents, domain lists, rejects and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.leads import escape_cell
from leadlens.operators.stateful import append_latest

LEAD_COLUMNS = ("email", "first_name", "last_name", "title", "company", "role_family", "seniority", "icp_score", "verify_status", "source")


def lead_rows(rows: DataFrame, columns: tuple[str, ...] = LEAD_COLUMNS) -> DataFrame:
    """The export's columns as text, NULL as blank, formulas disarmed."""
    return rows.select(*[F.coalesce(escape_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns])


def leads_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = LEAD_COLUMNS) -> None:
    lead_rows(rows, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def leads_jsonl(rows: DataFrame, path: str, columns: tuple[str, ...] = LEAD_COLUMNS) -> None:
    lead_rows(rows, columns).write.mode("overwrite").json(path)


def domains_text(companies: DataFrame, path: str) -> None:
    """Distinct domains, sorted, one a line."""
    companies.where("nullif(domain, '') is not null").select("domain").distinct().orderBy("domain").write.mode("overwrite").text(path)


def search_documents(rows: DataFrame) -> DataFrame:
    """One JSON document an address, with the text that search looks at."""
    text = F.concat_ws(" ", "full_name", "title", "role_family", "seniority", "company", "email_domain")
    return rows.withColumn("text", text).select(F.to_json(F.struct("id", "person_id", "email", "company", "industry", "size_bucket", "verify_status", "icp_score", "text")).alias("value"))


def rejects(rejected: DataFrame, path: str) -> None:
    """Reason and row, tab-separated."""
    rejected.select(F.concat_ws("\t", F.array_join("reasons", ","), "row").alias("value")).write.mode("overwrite").text(path)


def append(rows: DataFrame, path: str) -> None:
    """Audit and activity rows are only ever added."""
    rows.write.mode("append").parquet(path)


def upsert(new: DataFrame, path: str, into: str, keys: list[str], version: str) -> None:
    """The table at ``path`` with ``new`` merged by key, written to ``into`` (a table isn't read and overwritten at once)."""
    append_latest(new.sparkSession.read.parquet(path), new, keys, version).write.mode("overwrite").parquet(into)
