"""Queries on runs, batches, merged results, resolutions and paged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.operators import leads, reports
from leadlens.operators.latest import first_by
from leadlens.plans import tables as T
from leadlens.plans.lead_queries import PRIMARY, lead_view, over_leads
from leadlens.plans.registry import query
from leadlens.plans.tables import sql


@query(sql("r", """, m AS (SELECT l_orderkey AS run_id, count(*) AS verified, count(*) FILTER (l_returnflag = 'N') AS valid FROM lineitem GROUP BY 1)
  SELECT r.id, r.status, c_name AS user_name, coalesce(verified, 0) AS verified, coalesce(valid, 0) AS valid, CASE WHEN verified > 0 THEN round(valid / verified * 100, 1) ELSE 0.0::DOUBLE END AS valid_percent
  FROM r LEFT JOIN m ON m.run_id = r.id LEFT JOIN customer ON c_custkey = r.user_id"""))
def run_summary(spark, d):
    m = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("verified"), F.count_if(F.col("l_returnflag") == "N").alias("valid"))
    users = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return reports.run_summary(T.runs(spark, d), users, m)


@query(sql("v vr", """SELECT email_id % 10 AS run_id, count(*) AS total, count(*) FILTER (verify_status = 'valid') AS valid, count(*) FILTER (verify_status = 'invalid') AS invalid,
  count(*) FILTER (verify_status = 'risky_catch_all') AS risky, count(*) FILTER (verify_status = 'unknown_timeout') AS unknown FROM vr GROUP BY 1"""))
def run_verification(spark, d):
    groups = {"valid": ("valid",), "invalid": ("invalid",), "risky": ("risky_catch_all",), "unknown": ("unknown_timeout",)}
    return reports.status_counts(T.verification(spark, d), F.col("email_id") % 10, "run_id", F.col("verify_status"), groups)


DOMAINS = """'["s' || (user_id % 10 + 1) || '.example","s' || (id % 10 + 1) || '.example"]'"""


@query(sql("c p e r", f""", d AS (SELECT id, unnest(list_distinct(json_extract_string({DOMAINS}, '$[*]'))) AS domain FROM r),
  h AS (SELECT c.id AS company_id, domain, np, ne FROM c LEFT JOIN (SELECT company_id, count(*) AS np FROM p GROUP BY 1) x ON x.company_id = c.id LEFT JOIN (SELECT company_id, count(*) AS ne FROM e GROUP BY 1) y ON y.company_id = c.id)
  SELECT d.id, count(company_id) AS companies, count(*) FILTER (np > 0) AS with_people, count(*) FILTER (company_id IS NOT NULL AND np IS NULL) AS zero_people, count(*) FILTER (ne > 0) AS with_emails, coalesce(sum(np), 0)::BIGINT AS people FROM d LEFT JOIN h USING (domain) GROUP BY d.id"""))
def run_recompute(spark, d):
    runs = T.runs(spark, d).select("id", F.expr(DOMAINS).alias("domains"))
    return reports.recompute_runs(runs, T.companies(spark, d), T.people(spark, d), T.emails(spark, d))


ERROR = "CASE event_type WHEN 'error' THEN 'timeout: host ' || email_id WHEN 'click' THEN 'blocked by robots: /' || id END"


@query(sql("v", f"""SELECT 'k' AS name, sum(k)::BIGINT AS n FROM v UNION ALL SELECT 'elapsed_ms', sum(elapsed_ms)::BIGINT FROM v UNION ALL SELECT 'companies', count(DISTINCT email_id) FROM v
  UNION ALL SELECT 'error:' || split_part(error, ':', 1)[1:50], count(*) FROM (SELECT {ERROR} AS error FROM v) WHERE error IS NOT NULL GROUP BY 1"""))
def discovery_rollup(spark, d):
    return reports.discovery_rollup(T.evidence(spark, d), ["k", "elapsed_ms"], "email_id", F.expr(ERROR))


@query(sql("v", "SELECT email_id, sum(k)::BIGINT AS total, bool_or(event_type = 'error') AS flagged, array_to_string(list(id ORDER BY checked_at, id)[1:25], ',') AS sample FROM v GROUP BY 1"))
def result_merge(spark, d):
    merged = reports.merge_results(T.evidence(spark, d), "email_id", F.col("k"), F.col("event_type") == "error", "id", ["checked_at", "id"])
    return merged.withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query(sql("c p e r v vr", """SELECT 'companies' AS name, count(*) AS n FROM c UNION ALL SELECT 'people', count(*) FROM p UNION ALL SELECT 'emails', count(*) FROM e UNION ALL SELECT 'results', count(*) FROM v UNION ALL SELECT 'pages', count(*) FROM pages
  UNION ALL SELECT 'runs', count(*) FROM r UNION ALL SELECT 'verify_status:' || verify_status, count(*) FROM vr GROUP BY 1 UNION ALL SELECT 'run_status:' || coalesce(status, 'other'), count(*) FROM r GROUP BY 1"""))
def table_stats(spark, d):
    tables = {"companies": T.companies(spark, d), "people": T.people(spark, d), "emails": T.emails(spark, d), "results": T.evidence(spark, d), "pages": T.load(spark, d, "pages"), "runs": T.runs(spark, d)}
    out = None
    for name, rows in tables.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    by = lambda rows, col, head: rows.groupBy(F.concat(F.lit(head), F.coalesce(col, F.lit("other"))).alias("name")).agg(F.count("*").alias("n"))
    return out.union(by(T.verification(spark, d), "verify_status", "verify_status:")).union(by(tables["runs"], "status", "run_status:"))


@query(sql("r", """SELECT user_id % 50 AS batch_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS pending,
  min(created_at) AS first_at, max(created_at) AS last_at, CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'processing' ELSE 'completed' END AS state FROM r GROUP BY 1"""))
def batch_history(spark, d):
    s = F.col("status")
    n = [F.count_if(s == v).alias(k) for k, v in (("done", "succeeded"), ("failed", "failed"), ("pending", "running"))]
    g = T.runs(spark, d).groupBy((F.col("user_id") % 50).alias("batch_id")).agg(F.count("*").alias("total"), *n, F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return g.withColumn("state", F.when(F.col("pending") > 0, "processing").otherwise("completed"))


OUTCOME = "CASE WHEN event_type = 'click' THEN 'no_mx' ELSE verify_status END"


@query(sql("v vr", f"""SELECT email_id % 10 AS batch_id, count(*) AS total, count(*) FILTER (o = 'valid') AS valid, count(*) FILTER (o = 'risky_catch_all') AS risky, count(*) FILTER (o IN ('invalid', 'no_mx')) AS invalid,
  count(*) FILTER (o = 'unknown_timeout') AS pending FROM (SELECT email_id, {OUTCOME} AS o FROM vr) GROUP BY 1"""))
def batch_poll(spark, d):
    groups = {"valid": ("valid",), "risky": ("risky_catch_all",), "invalid": ("invalid", "no_mx"), "pending": ("unknown_timeout",)}
    return reports.status_counts(T.verification(spark, d), F.col("email_id") % 10, "batch_id", F.expr(OUTCOME), groups)


@query("""SELECT user_id, max(n) AS most, max(n) >= 3 AS blocked FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n
  FROM events WHERE event_type = 'signup') GROUP BY 1""")
def registration_attempts(spark, d):
    return reports.attempts_in(T.load(spark, d, "events").where("event_type = 'signup'"), "user_id", "ts", 7, 3)


@query(sql("v vr", """SELECT coalesce(catch_all, 'unknown') AS catch_all, count(*) AS n, count(DISTINCT mx_host) FILTER (verify_status = 'valid') AS hosts_with_valid,
  count(*) FILTER (catch_all = 'not_catch_all' AND verify_status = 'risky_catch_all') AS misclassified FROM vr GROUP BY 1"""))
def catchall_diagnostics(spark, d):
    ok, bad = F.col("verify_status") == "valid", (F.col("catch_all") == "not_catch_all") & (F.col("verify_status") == "risky_catch_all")
    rows = T.verification(spark, d).select(F.coalesce("catch_all", F.lit("unknown")).alias("state"), F.when(ok, F.col("mx_host")).alias("host"), bad.alias("bad"))
    return rows.groupBy(F.col("state").alias("catch_all")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts_with_valid"), F.count_if("bad").alias("misclassified"))


@query(sql("c p e", """SELECT * FROM (SELECT 'company' AS kind, id, name AS label FROM c WHERE contains(lower(name), 'er') ORDER BY id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'person', id, full_name FROM p WHERE contains(lower(full_name), 'er') ORDER BY id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'email', id, email FROM e WHERE contains(lower(email), 'er') ORDER BY id LIMIT 10)"""))
def global_search(spark, d):
    return reports.search_everywhere({"company": (T.companies(spark, d), "name"), "person": (T.people(spark, d), "full_name"), "email": (T.emails(spark, d), "email")}, "ER", 10)


@query(sql("r", "SELECT id, status, created_at, (SELECT count(*) FROM r) AS total, 3::INT AS page, greatest(1, ceil((SELECT count(*) FROM r) / 20.0))::INT AS total_pages FROM r ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40"))
def runs_page(spark, d):
    return reports.offset_page(T.runs(spark, d).select("id", "status", "created_at"), [F.desc("created_at"), F.desc("id")], 3, 20)


@query(over_leads("SELECT id, email, icp_score::INT AS icp_score, company, last_name, first_name FROM l ORDER BY l.icp_score DESC NULLS LAST, company ASC NULLS LAST, last_name, first_name, email, id LIMIT 100"))
def export_order(spark, d):
    order = [F.col("icp_score").desc_nulls_last(), F.col("company").asc_nulls_last(), "last_name", "first_name", "email", "id"]
    return lead_view(spark, d).orderBy(*order).limit(100).select("id", "email", "icp_score", "company", "last_name", "first_name")


@query(over_leads("SELECT id, email, icp_score::INT AS icp_score, verified_at FROM l ORDER BY l.icp_score DESC NULLS LAST, verified_at DESC NULLS FIRST, id LIMIT 100"))
def run_results(spark, d):
    order = [F.col("icp_score").desc_nulls_last(), F.col("verified_at").desc_nulls_first(), "id"]
    return lead_view(spark, d).orderBy(*order).limit(100).select("id", "email", "icp_score", "verified_at")


@query(over_leads(PRIMARY + """ SELECT l.email, first_name, last_name, full_name, title, company, company_id, 's' || company_id || '.example' AS company_domain, icp_score::INT AS icp_score, verify_status, verify_reason, verified_at,
  CASE WHEN verify_status = 'valid' THEN CASE WHEN verify_reason = 'no_bounce_after_test_send' THEN 'valid_catchall_tested' ELSE 'valid_native' END || CASE WHEN primary_id IS NULL THEN '' WHEN primary_id = id THEN '_primary' ELSE '_alternate' END WHEN verify_status IS NULL THEN 'unknown' ELSE verify_status END AS verify_label,
  primary_id = id AS is_primary_for_person, 'https://s' || company_id || '.example/team' AS source_url FROM l LEFT JOIN pr USING (person_id) ORDER BY l.icp_score DESC NULLS LAST, verified_at DESC NULLS FIRST, id LIMIT 10000"""))
def run_export(spark, d):
    return leads.run_results(lead_view(spark, d), T.people(spark, d), T.companies(spark, d))


@query(sql("r", """, x AS (SELECT id, created_at, unnest(list_distinct(['s' || (user_id % 10) || '.example', 's' || (id % 10) || '.example'])) AS domain FROM r)
  SELECT domain, id FROM x QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) = 1"""))
def latest_resolution(spark, d):
    chosen, hint = (F.expr(f"'s' || ({c} % 10) || '.example'") for c in ("user_id", "id"))
    return reports.latest_by_any(T.runs(spark, d), [chosen, hint], "domain", ["created_at", "id"])


@query(sql("v", """, x AS (SELECT mx_host AS host, 0 AS rank, id FROM v UNION ALL SELECT 'mx' || (id % 25), 1, id FROM v UNION ALL SELECT 'mx' || (k % 30), 2, id FROM v)
  SELECT host, id, rank::INT AS rank FROM x WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY rank, id DESC) = 1"""))
def best_mx_row(spark, d):
    return reports.best_match(T.evidence(spark, d), [F.col("mx_host"), F.expr("'mx' || (id % 25)"), F.expr("'mx' || (k % 30)")], "host")


@query(sql("v vr c p e", "SELECT c.domain, bool_or(verify_status = 'valid') AS good, bool_or(verify_status = 'invalid') AS bad, count(*) AS n FROM vr JOIN e ON e.id = vr.email_id JOIN c ON c.id = e.company_id GROUP BY 1"))
def domain_delivery(spark, d):
    v = T.verification(spark, d).select(F.col("email_id").alias("id"), "verify_status")
    c = T.companies(spark, d).select(F.col("id").alias("company_id"), "domain")
    rows = v.join(T.emails(spark, d).select("id", "company_id"), "id").join(c, "company_id")
    return rows.groupBy("domain").agg(F.bool_or(F.col("verify_status") == "valid").alias("good"), F.bool_or(F.col("verify_status") == "invalid").alias("bad"), F.count("*").alias("n"))


@query(sql("c p", "SELECT id FROM c WHERE id NOT IN (SELECT company_id FROM p WHERE company_id IS NOT NULL)"))
def stale_companies(spark, d):
    held = T.people(spark, d).select(F.col("company_id").alias("id"))
    return T.companies(spark, d).select("id").join(held, "id", "left_anti")


@query(sql("p e", """SELECT lo AS local, id FROM (SELECT id, lower(split_part(email, '@', 1)) AS lo, CASE WHEN id % 3 <> 0 THEN 'n' END AS name FROM e) QUALIFY row_number() OVER (PARTITION BY lo ORDER BY CASE WHEN name IS NULL THEN 1 ELSE 0 END, id) = 1"""))
def merge_by_email(spark, d):
    rows = T.emails(spark, d).select("id", em.local(F.col("email")).alias("local"), F.when(F.col("id") % 3 != 0, "n").alias("name"))
    return first_by(rows, ["local"], [F.col("name").isNull().cast("int"), F.col("id")]).select("local", "id")


@query(sql("p", "SELECT sig, min(id) AS id FROM (SELECT id, trim(regexp_replace(replace(coalesce(full_name, '') || '|' || coalesce(title, '') || '|' || coalesce(source_url, ''), chr(160), ' '), '[ \\t]+', ' ', 'g')) AS sig FROM p) GROUP BY sig"))
def person_signatures(spark, d):
    sig = reports.signature(F.col("full_name"), F.col("title"), F.col("source_url"))
    return T.people(spark, d).groupBy(sig.alias("sig")).agg(F.min("id").alias("id"))


@query(sql("p e", "SELECT DISTINCT lower(split_part(email, '@', 2)) AS domain FROM e"))
def domain_list(spark, d):
    return T.emails(spark, d).select(em.domain_split(F.col("email")).alias("domain")).distinct()


@query(sql("c p", "SELECT c.id, c.name FROM c JOIN (SELECT company_id, count(*) AS n FROM p GROUP BY 1) x ON x.company_id = c.id WHERE n >= 5"))
def companies_with_people(spark, d):
    n = T.people(spark, d).where("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 5")
    return T.companies(spark, d).join(n, "id").select("id", "name")
