"""Logical lead tables, projected from the stored tables: as DataFrames, and as the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import status

#: Every time-dependent query takes this as its present.
NOW = "2024-04-10 00:00:00"
TITLES = ("CEO", "VP, Sales", "Head of Data", "Data Engineer", "Sales Manager", "Chief Marketing Officer", "Customer Success Lead", "Support Specialist", "CFO", "Software Developer", "Head of Product", "Legal Counsel", "Talent Partner", "Office Assistant", "Security Director", "", "General Counsel", "Director of Data", "Office Coordinator", "Co-Founder & Engineer", "Chief People Officer", "VP People", "IT Manager", "President", "Head of Supply Chain", "UX Lead", "Machine Learning Scientist", "Brand Mgr", "SVP, Sales EMEA", "Attorney", "Gardener", "Founder")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Verification attempts: one row per event."""
    e = load(spark, d, "events").withColumn("k", F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k")))
    code = F.when(F.col("event_type").isin("signup", "purchase"), 250).when(F.col("event_type") == "error", 550).when(F.col("event_type") == "view", 421)
    u, k = F.col("user_id") % 3, F.col("k") % 4
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("email_id"), F.col("ts").alias("checked_at"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("verified_at"),
        code.alias("rcpt_code"), F.when(u == 0, "catch_all").when(u == 1, "not_catch_all").alias("catch_all"), F.when(k == 0, "deliverable").when(k == 1, "undeliverable").when(k == 2, "unknown").alias("fallback"),
        F.concat(F.lit("mx"), F.col("user_id") % 20).alias("mx_host"), F.floor(F.col("value") * 10).cast("int").alias("elapsed_ms"), "event_type", "k",
    )


def verification(spark: SparkSession, d: str) -> DataFrame:
    v = evidence(spark, d)
    verdict = status.classify(F.lit(None).cast("string"), F.col("rcpt_code"), F.col("catch_all"), F.col("fallback"), F.col("verified_at"), now())
    return v.select("*", verdict.alias("verdict")).select("*", "verdict.*").drop("verdict")


def companies(spark: SparkSession, d: str) -> DataFrame:
    s, n = load(spark, d, "supplier"), F.col("s_nationkey")
    industry = F.element_at(F.array(*map(F.lit, ("SaaS", "Manufacturing", "education", "Retail", "Finance"))), (n % 5 + 1).cast("int"))
    size = F.when(F.col("s_acctbal") < 0, "1-10").when(F.col("s_acctbal") < 3000, "11-50").when(F.col("s_acctbal") < 7000, "51-200").otherwise("201-1000")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example")).alias("domain"), industry.alias("industry"), size.alias("size_bucket"), F.col("s_nationkey").alias("country"))


def people(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    owner = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("company_id"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % len(TITLES) + 1).cast("int"))
    return p.join(owner, "p_partkey", "left").select(F.col("p_partkey").alias("id"), "company_id", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last_name"), F.initcap("p_name").alias("full_name"), title.alias("title"), F.concat(F.lit("https://s"), F.col("company_id"), F.lit(".example/team")).alias("source_url"))


def emails(spark: SparkSession, d: str) -> DataFrame:
    """Three addresses a person: first.last, flast, and a role address for every seventh person."""
    p = people(spark, d).where("company_id is not null")
    f, l = F.lower("first_name"), F.lower("last_name")
    third = F.when(F.col("id") % 7 == 0, F.lit("info")).otherwise(F.concat(f, F.lit("_"), l))
    rows = p.select("id", "company_id", F.posexplode(F.array(F.concat(f, F.lit("."), l), F.concat(F.substring(f, 1, 1), l), third)).alias("idx", "local"))
    source = F.element_at(F.array(F.lit("extracted"), F.lit("generated"), F.lit("seed")), ((F.col("id") + F.col("idx")) % 3 + 1).cast("int"))
    return rows.select((F.col("id") * 3 + F.col("idx")).alias("id"), F.col("id").alias("person_id"), "company_id", F.concat("local", F.lit("@s"), "company_id", F.lit(".example")).alias("email"), source.alias("source"), (F.col("idx") == 0).cast("int").alias("is_published"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), state.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"))


CTE = {
    "v": """v AS (SELECT event_id AS id, user_id AS email_id, ts AS checked_at, CASE WHEN event_id % 17 <> 0 THEN ts END AS verified_at,
      CASE WHEN event_type IN ('signup','purchase') THEN 250 WHEN event_type = 'error' THEN 550 WHEN event_type = 'view' THEN 421 END AS rcpt_code,
      CASE user_id % 3 WHEN 0 THEN 'catch_all' WHEN 1 THEN 'not_catch_all' END AS catch_all,
      CASE CAST(json_extract_string(props, '$.k') AS INT) % 4 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'undeliverable' WHEN 2 THEN 'unknown' END AS fallback,
      'mx' || (user_id % 20) AS mx_host, CAST(floor(value * 10) AS INT) AS elapsed_ms, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "vr": """vr AS (SELECT *, split_part(sr, '|', 1) AS verify_status, split_part(sr, '|', 2) AS verify_reason FROM (SELECT *, CASE
      WHEN TIMESTAMP '2024-04-10 00:00:00' - verified_at > INTERVAL 90 DAY THEN 'unknown_timeout|stale_result_ttl_exceeded'
      WHEN rcpt_code BETWEEN 500 AND 599 THEN CASE WHEN fallback = 'deliverable' THEN 'valid|fallback_valid_overrides_rcpt_5xx' ELSE 'invalid|rcpt_5xx_user_unknown' END
      WHEN rcpt_code BETWEEN 200 AND 299 THEN CASE
        WHEN catch_all = 'not_catch_all' THEN CASE WHEN fallback = 'deliverable' THEN 'valid|rcpt_2xx_non_catchall_fallback_valid' ELSE 'valid|rcpt_2xx_non_catchall' END
        WHEN catch_all = 'catch_all' THEN CASE WHEN fallback = 'undeliverable' THEN 'invalid|rcpt_2xx_catchall_fallback_invalid' ELSE 'risky_catch_all|rcpt_2xx_catchall' END
        WHEN fallback = 'deliverable' THEN 'valid|rcpt_2xx_catchall_unknown_fallback_deliverable'
        WHEN fallback = 'undeliverable' THEN 'risky_catch_all|rcpt_2xx_catchall_unknown_fallback_invalid'
        ELSE 'valid|rcpt_2xx_catchall_unconfirmed' END
      WHEN rcpt_code BETWEEN 400 AND 499 THEN CASE WHEN fallback = 'deliverable' THEN 'valid|fallback_valid_after_tempfail' WHEN fallback = 'undeliverable' THEN 'invalid|fallback_invalid_after_tempfail'
        WHEN catch_all = 'catch_all' THEN 'risky_catch_all|catchall_softfail_no_fallback' ELSE 'unknown_timeout|tempfail_or_timeout' END
      WHEN fallback = 'deliverable' THEN 'valid|fallback_valid_no_smtp' WHEN fallback = 'undeliverable' THEN 'invalid|fallback_invalid_no_smtp'
      ELSE 'unknown_timeout|no_verification_attempt' END AS sr FROM v))""",
    "c": """c AS (SELECT s_suppkey AS id, s_name AS name, 's' || s_suppkey || '.example' AS domain, ['SaaS','Manufacturing','education','Retail','Finance'][(s_nationkey % 5) + 1] AS industry,
      CASE WHEN s_acctbal < 0 THEN '1-10' WHEN s_acctbal < 3000 THEN '11-50' WHEN s_acctbal < 7000 THEN '51-200' ELSE '201-1000' END AS size_bucket, s_nationkey AS country FROM supplier)""",
    "p": f"""p AS (SELECT p_partkey AS id, o.company_id, split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', 2) AS last_name,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS full_name,
      {list(TITLES)!r}[(p_partkey % {len(TITLES)}) + 1] AS title, 'https://s' || o.company_id || '.example/team' AS source_url
      FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS company_id FROM lineitem GROUP BY l_partkey) o ON o.l_partkey = p_partkey)""",
    "e": """e AS (SELECT x.id * 3 + idx AS id, x.id AS person_id, company_id, loc || '@s' || company_id || '.example' AS email,
      ['extracted','generated','seed'][(x.id + idx) % 3 + 1] AS source, CASE WHEN idx = 0 THEN 1 ELSE 0 END AS is_published FROM (
      SELECT id, company_id, unnest([0, 1, 2]) AS idx, unnest([lower(first_name) || '.' || lower(last_name), lower(first_name)[1:1] || lower(last_name), CASE WHEN id % 7 = 0 THEN 'info' ELSE lower(first_name) || '_' || lower(last_name) END]) AS loc FROM p WHERE company_id IS NOT NULL) x)""",
    "r": """r AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END AS status, o_orderdate AS created_at, o_orderpriority AS priority FROM orders)""",
    "lv": """lv AS (SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY coalesce(verified_at, checked_at) DESC NULLS FIRST, id DESC) = 1)""",
    "la": """la AS (SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY verified_at DESC NULLS LAST, id DESC) = 1)""",
}


def sql(names: str, body: str) -> str:
    """``body`` behind the named CTEs, in the order given."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + ("," if body.lstrip().startswith(",") else "\n") + body.lstrip().removeprefix(",")
