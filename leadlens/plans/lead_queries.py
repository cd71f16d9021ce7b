"""Queries on verification results, leads, facets, search, scoring and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import labels, names, status
from leadlens.operators import analytics, leads, mx
from leadlens.operators.latest import first_by, latest
from leadlens.plans import tables as T
from leadlens.plans.registry import query
from leadlens.plans.tables import sql

LATEST = ("email_id", "id", "verify_status", "verify_reason")


@query(sql("v vr", "SELECT email_id, id, verify_status, verify_reason FROM vr QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY coalesce(verified_at, checked_at) DESC NULLS FIRST, id DESC) = 1"))
def latest_view(spark, d):
    return latest(T.verification(spark, d), "view").select(*LATEST)


@query(sql("v vr", "SELECT email_id, id, verify_status, verify_reason FROM vr QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY verified_at DESC NULLS LAST, id DESC) = 1"))
def latest_api(spark, d):
    return latest(T.verification(spark, d), "api").select(*LATEST)


@query(sql("v vr", "SELECT email_id, max(id) AS id, max_by(verify_status, id) AS verify_status, max_by(verify_reason, id) AS verify_reason FROM vr GROUP BY email_id"))
def latest_max_id(spark, d):
    return latest(T.verification(spark, d), "max_id").select(*LATEST)


@query(sql("v vr", "SELECT verify_status, verify_reason, count(*) AS n FROM vr GROUP BY ALL"))
def status_reasons(spark, d):
    return T.verification(spark, d).groupBy("verify_status", "verify_reason").agg(F.count("*").alias("n"))


VALID_RATE = """SELECT count(*) AS total, count(*) FILTER (verify_status = 'valid') AS valid, count(*) FILTER (verify_status = 'invalid') AS invalid,
  count(*) FILTER (verify_status = 'risky_catch_all') AS risky_catch_all, count(*) FILTER (verify_status = 'unknown_timeout') AS unknown_timeout,
  coalesce(count(*) FILTER (verify_status = 'valid') / nullif(count(*) FILTER (verify_status IN ('valid', 'invalid', 'risky_catch_all')), 0)::DOUBLE, 0.0) AS valid_rate FROM lv"""


@query(sql("v vr lv", VALID_RATE))
def valid_rate(spark, d):
    return analytics.verification_stats(latest(T.verification(spark, d)))


@query(sql("v", "SELECT count(*) AS n_results, count(*) FILTER (catch_all IS NOT NULL) AS n_catch_all, count(DISTINCT email_id) AS n_addresses, (SELECT count(*) FROM pages) AS n_pages FROM v"))
def cost_counters(spark, d):
    n = T.load(spark, d, "pages").agg(F.count("*").alias("n_pages"))
    v = T.evidence(spark, d).agg(F.count("*").alias("n_results"), F.count("catch_all").alias("n_catch_all"), F.count_distinct("email_id").alias("n_addresses"))
    return v.join(F.broadcast(n))  # one row each


@query(sql("v vr lv c p e", """SELECT count(DISTINCT c.id) AS companies, count(DISTINCT p.company_id) AS with_people, count(DISTINCT e.company_id) AS with_emails,
  count(DISTINCT CASE WHEN lv.email_id IS NOT NULL THEN e.company_id END) AS with_results, count(DISTINCT CASE WHEN lv.verify_status = 'valid' THEN e.company_id END) AS with_valid
  FROM c LEFT JOIN p ON p.company_id = c.id LEFT JOIN e ON e.person_id = p.id LEFT JOIN lv ON lv.email_id = e.id"""))
def company_funnel(spark, d):
    p = T.people(spark, d).select(F.col("id").alias("person_id"), F.col("company_id").alias("p_company"))
    e = T.emails(spark, d).select("id", "person_id", F.col("company_id").alias("e_company"))
    v = latest(T.verification(spark, d)).select(F.col("email_id").alias("id"), "verify_status")
    c = T.companies(spark, d).select(F.col("id").alias("c_id"))
    rows = c.join(p, c.c_id == p.p_company, "left").join(e, "person_id", "left").join(v, "id", "left")
    of = lambda cond: F.count_distinct(F.when(cond, F.col("e_company")))
    return rows.agg(F.count_distinct("c_id").alias("companies"), F.count_distinct("p_company").alias("with_people"), F.count_distinct("e_company").alias("with_emails"), of(F.col("verify_status").isNotNull()).alias("with_results"), of(F.col("verify_status") == "valid").alias("with_valid"))


@query("SELECT s_suppkey AS id, s_name AS name, (SELECT count(*) FROM nation WHERE n_nationkey = s_nationkey) AS n_pages FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity >= 49 AND l_discount >= 0.09 AND l_shipdate >= TIMESTAMP '1998-06-01')")
def zero_candidate_companies(spark, d):
    s, n = T.load(spark, d, "supplier"), T.load(spark, d, "nation").groupBy(F.col("n_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n_pages"))
    busy = T.load(spark, d, "lineitem").where("l_quantity >= 49 and l_discount >= 0.09 and l_shipdate >= timestamp_ntz'1998-06-01 00:00:00'").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(busy, "s_suppkey", "left_anti").join(n, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query(sql("r", "SELECT coalesce(status, 'other') AS status, count(*) AS n FROM r GROUP BY 1"))
def run_status_breakdown(spark, d):
    return T.runs(spark, d).groupBy(F.coalesce("status", F.lit("other")).alias("status")).agg(F.count("*").alias("n"))


@query(sql("r", "SELECT user_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, max(created_at) AS last_run FROM r GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20"))
def user_run_stats(spark, d):
    return analytics.user_run_stats(T.runs(spark, d), 20)


@query(sql("r", "SELECT r.id, r.status, c_name AS user_name, r.created_at FROM r LEFT JOIN customer ON c_custkey = user_id ORDER BY created_at DESC, r.id DESC LIMIT 25"))
def recent_runs(spark, d):
    top = T.runs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).limit(25)
    users = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return top.join(users, "user_id", "left").select("id", "status", "user_name", "created_at")


SERIES = """SELECT strftime(coalesce(verified_at, checked_at), '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (verify_status = 'valid') AS valid, count(*) FILTER (verify_status = 'invalid') AS invalid,
  count(*) FILTER (verify_status = 'risky_catch_all') AS risky, coalesce(count(*) FILTER (verify_status = 'valid') / nullif(count(*) FILTER (verify_status IN ('valid','invalid','risky_catch_all')), 0)::DOUBLE, 0.0) AS valid_rate
  FROM vr WHERE coalesce(verified_at, checked_at) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1"""


@query(sql("v vr", SERIES))
def verification_time_series(spark, d):
    return analytics.time_series(T.verification(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(sql("v vr", SERIES.split(" FROM vr")[0].replace("strftime(coalesce(verified_at, checked_at), '%Y-%m-%d') AS day", "mx_host") + " FROM vr GROUP BY 1 ORDER BY total DESC, mx_host LIMIT 10"))
def domain_breakdown(spark, d):
    return analytics.breakdown(T.verification(spark, d), F.col("mx_host"), "mx_host", 10)


@query(sql("v vr", "SELECT coalesce(verify_reason, verify_status, 'unknown') AS reason, count(*) AS n FROM vr GROUP BY 1 ORDER BY n DESC, reason LIMIT 8"))
def error_breakdown(spark, d):
    key = F.coalesce("verify_reason", "verify_status", F.lit("unknown")).alias("reason")
    return T.verification(spark, d).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query(sql("c p", "SELECT c.id, c.domain, count(p.id) AS n FROM c LEFT JOIN p ON p.company_id = c.id WHERE nullif(c.domain, '') IS NOT NULL GROUP BY c.id, c.domain HAVING count(p.id) < 30 ORDER BY n, c.id LIMIT 50"))
def needs_contacts(spark, d):
    c = T.companies(spark, d).where("nullif(domain, '') is not null")
    p = T.people(spark, d).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return c.join(p, "id", "left").select("id", "domain", F.coalesce("n", F.lit(0)).alias("n")).where("n < 30").orderBy("n", "id").limit(50)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'view') AS views, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id")
def usage_summary(spark, d):
    n = [F.count_if(F.col("event_type") == k).alias(k + "s") for k in ("signup", "purchase", "view")]
    return T.load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), *n, F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


USAGE = "SELECT user_id, event_type, strftime(ts, '{}') AS period, count(*) AS n FROM events GROUP BY ALL"


@query(USAGE.format("%Y-%m-%d"))
def usage_daily(spark, d):
    return T.load(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n"))


@query(USAGE.format("%Y-%m"))
def usage_monthly(spark, d):
    return T.load(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


@query(sql("v vr lv", "SELECT mx_host AS domain, count(*) AS n_emails, CASE WHEN bool_or(verify_status LIKE 'risky%') THEN 'risky' WHEN bool_or(verify_status LIKE 'unknown%' OR verify_status LIKE 'temp%') THEN 'unknown' ELSE 'none' END AS risk_level FROM lv GROUP BY 1"))
def domain_risk_level(spark, d):
    last = latest(T.verification(spark, d))
    return analytics.risk_level(last.select("email_id", "verify_status"), last.select(F.col("email_id").alias("id"), F.col("mx_host").alias("domain")))


WINDOW = """, n AS (SELECT * FROM v WHERE checked_at >= TIMESTAMP '2024-01-05 00:00:00' QUALIFY row_number() OVER (PARTITION BY mx_host ORDER BY checked_at DESC, id DESC) <= 5000),
  g AS (SELECT mx_host, count(*) AS n, list_sort(list(elapsed_ms)) AS ms, count(*) FILTER (rcpt_code BETWEEN 400 AND 499) AS temp, count(*) FILTER (rcpt_code BETWEEN 200 AND 299) AS ok FROM n GROUP BY mx_host)
  SELECT mx_host, n, ms[CAST(round_even((n - 1) * 50 / 100.0, 0) AS INT) + 1] AS p50, ms[CAST(round_even((n - 1) * 95 / 100.0, 0) AS INT) + 1] AS p95, round(temp / n, 3) AS temp_rate, round(ok / n, 3) AS success_rate,
  (ms[CAST(round_even((n - 1) * 95 / 100.0, 0) AS INT) + 1] > 2000 OR round(temp / n, 3) > 0.3) AS tarpit FROM g"""


@query(sql("v", WINDOW))
def mx_window_stats(spark, d):
    return mx.window_stats(T.evidence(spark, d), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))


@query(sql("v", """SELECT mx_host, count(*) AS n, CASE WHEN count(*) >= 4 AND (count(*) FILTER (rcpt_code BETWEEN 400 AND 499) + count(*) FILTER (rcpt_code IS NULL)) / count(*)::DOUBLE >= 0.5 OR count(*) >= 4 AND sum(elapsed_ms)::DOUBLE / count(*) >= 800 THEN 'tarpit'
  WHEN count(*) >= 5 AND sum(elapsed_ms)::DOUBLE / count(*) <= 150 AND count(*) FILTER (rcpt_code BETWEEN 500 AND 599) / count(*)::DOUBLE < 0.05 THEN 'fast' ELSE 'normal' END AS profile FROM v GROUP BY mx_host"""))
def mx_profile(spark, d):
    c = F.col("rcpt_code")
    g = T.evidence(spark, d).groupBy("mx_host").agg(F.count("*").alias("n"), F.count_if(c.between(400, 499)).alias("t"), F.count_if(c.isNull()).alias("u"), F.count_if(c.between(500, 599)).alias("h"), F.sum("elapsed_ms").alias("ms"))
    return g.select("mx_host", "n", status.mx_profile(F.col("n"), F.col("t"), F.col("u"), F.col("h"), F.col("ms").cast("double") / F.col("n")).alias("profile"))


@query(sql("v", """, s AS (SELECT mx_host, count(*) AS n, list_transform(list_sort(list({'t': checked_at, 'i': id, 'ms': elapsed_ms})), lambda x: x.ms::DOUBLE) AS ms FROM v GROUP BY mx_host)
  SELECT mx_host, n, round(list_reduce(list_prepend(0.0::DOUBLE, ms), lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * a END), 6) AS average FROM s"""))
def mx_running_average(spark, d):
    return mx.running_average(T.evidence(spark, d)).select("mx_host", "n", F.round("average", 6).alias("average"))


def lead_view(spark, d):
    return leads.view(T.emails(spark, d), T.people(spark, d), T.companies(spark, d), T.verification(spark, d))


def title_sql() -> str:
    """'family|seniority' of ``title``, by the same rules in SQL."""
    low = "lower(trim(coalesce(title, '')))"
    cases = lambda table: "CASE " + " ".join(f"WHEN regexp_matches({low}, '\\b({'|'.join(words)})\\b') THEN '{name}'" for name, words in table)
    exact = " ".join(f"WHEN {low} = '{t}' THEN '{fam}|{sen}'" for t, fam, sen in names.EXACT_TITLES)
    rules = " ".join(f"WHEN {low} LIKE '%{t}%' THEN '{fam}|{sen}'" for t, fam, sen in names.TITLE_RULES)
    founder = f"WHEN regexp_matches({low}, '\\b(co[- ]?)?founder\\b') THEN 'C'"
    return f"(CASE {exact} {rules} ELSE {cases(names.FAMILY_WORDS)} ELSE 'General Management' END || '|' || {cases(names.LADDER_WORDS)} {founder} ELSE 'IC' END END)"


TITLE_SQL = title_sql()
LEADS = f""", l0 AS (SELECT e.*, lv.verify_status, lv.verify_reason, lv.verified_at, lv.mx_host, p.first_name, p.last_name, p.full_name, p.title, c.name AS company, c.industry, c.size_bucket,
    split_part({TITLE_SQL}, '|', 1) AS role_family, split_part({TITLE_SQL}, '|', 2) AS seniority, lower(split_part(e.email, '@', 2)) AS email_domain
  FROM e LEFT JOIN lv ON lv.email_id = e.id LEFT JOIN p ON p.id = e.person_id LEFT JOIN c ON c.id = e.company_id),
  l AS (SELECT *, CASE WHEN role_family IS NULL THEN 0 ELSE (CASE role_family WHEN 'Sales' THEN 35 WHEN 'Engineering' THEN 25 WHEN 'Marketing' THEN 10 WHEN 'Customer Success' THEN 20 WHEN 'Operations' THEN 10 ELSE 0 END
    + CASE seniority WHEN 'C' THEN 30 WHEN 'VP' THEN 25 WHEN 'Head' THEN 20 WHEN 'Director' THEN 18 WHEN 'Manager' THEN 12 ELSE 0 END) END AS icp_score FROM l0)"""


def over_leads(body: str) -> str:
    return sql("v vr lv c p e", LEADS + ("" if body.lstrip().startswith(",") else "\n") + body)


@query(over_leads("SELECT id, person_id, company_id, email, source, is_published, verify_status, verify_reason, full_name, title, company, industry, size_bucket, role_family, seniority, icp_score::INT AS icp_score, email_domain FROM l"))
def emails_latest_view(spark, d):
    return lead_view(spark, d).select("id", "person_id", "company_id", "email", "source", "is_published", "verify_status", "verify_reason", "full_name", "title", "company", "industry", "size_bucket", "role_family", "seniority", "icp_score", "email_domain")


HUMAN = """(CASE WHEN lo IN ('info','contact','support','sales','hello','team','office') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lo, '^(info|contact|support|sales|hello|team|office)') THEN 20 ELSE 0 END
  + CASE WHEN length(lo) <= 3 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(lo, '[0-9]') THEN 5 ELSE 0 END
  + CASE WHEN fn <> '' AND ln <> '' AND lo IN (fn || '.' || ln, fn || '_' || ln, fn || ln, fn[1:1] || ln, fn[1:1] || '.' || ln, fn[1:1] || '_' || ln) THEN -15
    ELSE CASE WHEN ln <> '' AND contains(lo, ln) THEN -5 ELSE 0 END + CASE WHEN fn <> '' AND contains(lo, fn) THEN -3 ELSE 0 END END)"""
PRIMARY = f""", h AS (SELECT *, lower(split_part(email, '@', 1)) AS lo, regexp_replace(lower(first_name), '[^a-z]', '', 'g') AS fn, regexp_replace(lower(last_name), '[^a-z]', '', 'g') AS ln FROM l),
  pr AS (SELECT person_id, id AS primary_id, email FROM h WHERE verify_status = 'valid' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY
    CASE source WHEN 'extracted' THEN 0 WHEN 'seed' THEN 1 WHEN 'generated' THEN 2 ELSE 3 END, CASE WHEN verify_reason = 'no_bounce_after_test_send' THEN 1 ELSE 0 END, {HUMAN}, verified_at ASC NULLS FIRST, id) = 1)"""


@query(over_leads(PRIMARY + " SELECT person_id, primary_id, email FROM pr"))
def primary_email(spark, d):
    return leads.primary(lead_view(spark, d)).select("person_id", F.col("id").alias("primary_id"), "email")


@query(over_leads(PRIMARY + """ SELECT CASE WHEN verify_status = 'valid' THEN CASE WHEN verify_reason = 'no_bounce_after_test_send' THEN 'valid_catchall_tested' ELSE 'valid_native' END || CASE WHEN primary_id IS NULL THEN '' WHEN primary_id = id THEN '_primary' ELSE '_alternate' END
  WHEN verify_status IS NULL THEN 'unknown' ELSE verify_status END AS verify_label, count(*) AS n FROM l LEFT JOIN pr USING (person_id) GROUP BY 1"""))
def verify_labels(spark, d):
    return leads.labelled(lead_view(spark, d)).groupBy("verify_label").agg(F.count("*").alias("n"))


@query(over_leads("SELECT id, email, icp_score::INT AS icp_score FROM l ORDER BY coalesce(icp_score, -1) DESC, id DESC LIMIT 50"))
def search_icp_page1(spark, d):
    return leads.page(lead_view(spark, d), 50).select("id", "email", "icp_score")


@query(over_leads("SELECT id, email, icp_score::INT AS icp_score FROM l ORDER BY coalesce(icp_score, -1) DESC, id DESC LIMIT 50 OFFSET 50"))
def search_icp_page2(spark, d):
    rows = lead_view(spark, d).select("id", "email", "icp_score").persist()
    last = leads.page(rows, 50).agg(F.min(F.struct("icp_score", "id")).alias("s")).first()["s"]  # one row: the cursor
    return leads.page(rows, 50, (last["icp_score"], last["id"])) if last else rows


@query(over_leads("SELECT id, email, verified_at FROM l ORDER BY verified_at DESC NULLS LAST, id DESC LIMIT 30"))
def search_verified(spark, d):
    return leads.page(lead_view(spark, d), 30, sort="verified").select("id", "email", "verified_at")


@query(over_leads("SELECT id, email FROM l WHERE verify_status IN ('valid','risky_catch_all') AND icp_score >= 20 AND industry IN ('SaaS','Retail') AND is_published = 1 AND contains(lower(concat_ws(' ', full_name, title, company, email)), 'sales')"))
def search_filtered(spark, d):
    found = leads.search(lead_view(spark, d), statuses=("valid", "risky_catch_all"), icp_min=20, industries=("SaaS", "Retail"), source="published", text="Sales")
    return found.select("id", "email")


@query(over_leads(""", f AS (SELECT unnest(['verify_status','role_family','seniority','industry','size_bucket','source','icp_bucket']) AS facet,
  unnest([verify_status, role_family, seniority, industry, size_bucket, source, CASE WHEN icp_score < 40 THEN '0-39' WHEN icp_score < 60 THEN '40-59' WHEN icp_score < 80 THEN '60-79' ELSE '80-100' END]) AS value FROM l)
  SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY facet, value) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 200"""))
def facets_store(spark, d):
    named = {k: F.col(k) for k in ("verify_status", "role_family", "seniority", "industry", "size_bucket", "source")}
    return leads.facets(lead_view(spark, d), named | {"icp_bucket": leads.icp_bucket(F.col("icp_score"))})


@query(over_leads(""", f AS (SELECT unnest(['verify_status','role_family','icp_bucket']) AS facet, unnest([verify_status, role_family, CASE WHEN icp_score >= 80 THEN '80-100' WHEN icp_score >= 60 THEN '60-79' WHEN icp_score >= 40 THEN '40-59' ELSE '0-39' END]) AS value FROM l WHERE verify_status = 'valid')
  SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY ALL"""))
def facets_search(spark, d):
    bucket = F.coalesce(leads.icp_bucket(F.col("icp_score")), F.lit("0-39"))  # this dialect counts a missing score low
    return leads.facets(leads.search(lead_view(spark, d), statuses=("valid",)), {"verify_status": F.col("verify_status"), "role_family": F.col("role_family"), "icp_bucket": bucket}, limit=None)


@query(over_leads("SELECT person_id, icp_score::INT AS icp_score, CASE WHEN role_family IS NULL THEN 'missing_min_required' ELSE concat_ws(';', CASE WHEN role_family IN ('Sales','Engineering','Marketing','Customer Success','Operations') THEN 'role_family:' || role_family || '+' || CASE role_family WHEN 'Sales' THEN 35 WHEN 'Engineering' THEN 25 WHEN 'Customer Success' THEN 20 ELSE 10 END END, CASE WHEN seniority IN ('C','VP','Head','Director','Manager') THEN 'seniority:' || seniority || '+' || CASE seniority WHEN 'C' THEN 30 WHEN 'VP' THEN 25 WHEN 'Head' THEN 20 WHEN 'Director' THEN 18 ELSE 12 END END) END AS reasons FROM l WHERE is_published = 1"))
def icp_score(spark, d):
    p = leads.titled(T.people(spark, d).where("company_id is not null"))
    points, why = leads.score(F.col("role_family"), F.col("seniority"))
    return p.select(F.col("id").alias("person_id"), points.alias("icp_score"), F.array_join(why, ";").alias("reasons"))


@query(over_leads("SELECT title, role_family, seniority, count(*) AS n FROM l GROUP BY ALL"))
def title_family(spark, d):
    return lead_view(spark, d).groupBy("title", "role_family", "seniority").agg(F.count("*").alias("n"))


POLICY_SQL = """CASE WHEN verify_status IS NULL OR verify_status NOT IN ('valid','risky_catch_all') THEN 'status_not_allowed' WHEN icp_score < CASE verify_status WHEN 'valid' THEN 40 ELSE 60 END THEN 'icp_below_threshold'
  WHEN lower(role_family) IN ('student','intern') THEN 'role_excluded' WHEN lower(seniority) = 'junior' THEN 'seniority_excluded' WHEN lower(industry) IN ('education','government') THEN 'industry_excluded' ELSE 'ok' END"""
SOFTER = leads.POLICY | {"min_icp_score_valid": 40, "min_icp_score_catch_all": 60}  # the points given above never reach the default thresholds


def reason():
    return leads.export_reason(F.col("verify_status"), F.col("icp_score"), F.col("role_family"), F.col("seniority"), F.col("industry"), SOFTER)


@query(over_leads(f"SELECT {POLICY_SQL} AS reason, count(*) AS n FROM l GROUP BY 1"))
def export_policy(spark, d):
    return lead_view(spark, d).groupBy(reason().alias("reason")).agg(F.count("*").alias("n"))


@query(over_leads(f"SELECT id, CASE WHEN regexp_matches(title, '^[=+@-]') THEN '''' || title ELSE title END AS title, email, icp_score::INT AS icp_score, company FROM l WHERE {POLICY_SQL} = 'ok' AND lower(email) NOT IN (SELECT lower(email) FROM e WHERE person_id % 10 = 0) AND email_domain NOT IN (SELECT domain FROM c WHERE country % 7 = 3)"))
def exportable_leads(spark, d):
    by_mail = T.emails(spark, d).where("person_id % 10 = 0").select("email", F.lit(None).cast("string").alias("email_hash"), F.lit(None).cast("string").alias("domain"))
    by_domain = T.companies(spark, d).where("country % 7 = 3").select(F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("email_hash"), "domain")
    rows = leads.suppress(lead_view(spark, d).where(reason() == "ok"), by_mail.union(by_domain))
    return rows.select("id", leads.escape_cell(F.col("title")).alias("title"), "email", "icp_score", "company")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND sha256('doc' || doc_id || '@x.example') NOT IN (SELECT sha256('doc' || doc_id || '@x.example') FROM labels WHERE quality = 0)")
def suppression_anti(spark, d):
    lab = T.load(spark, d, "labels")
    email = F.concat(F.lit("doc"), "doc_id", F.lit("@x.example"))
    none = F.lit(None).cast("string")
    held = lab.where("toxic = 1").select(email.alias("email"), none.alias("email_hash"), none.alias("domain")).union(lab.where("quality = 0").select(none, em.email_hash(email), none))
    return leads.suppress(T.load(spark, d, "documents").select("doc_id", email.alias("email")), held).select("doc_id")


@query(over_leads("SELECT company_id, person_id, id FROM l QUALIFY row_number() OVER (PARTITION BY company_id, person_id ORDER BY verified_at DESC NULLS LAST, id DESC) = 1"))
def export_one_per_person(spark, d):
    return first_by(lead_view(spark, d), ["company_id", "person_id"], [F.col("verified_at").desc_nulls_last(), F.desc("id")]).select("company_id", "person_id", "id")


@query(sql("p e", "SELECT lower(split_part(email, '@', 1)) AS local, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1"))
def duplicate_locals(spark, d):
    return T.emails(spark, d).groupBy(em.local(F.col("email")).alias("local")).agg(F.count("*").alias("n")).where("n > 1")


@query(sql("c p e", "SELECT c.id, coalesce(np, 0) AS n_people, coalesce(ne, 0) AS n_emails FROM c LEFT JOIN (SELECT company_id, count(*) AS np FROM p GROUP BY 1) x ON x.company_id = c.id LEFT JOIN (SELECT company_id, count(*) AS ne FROM e GROUP BY 1) y ON y.company_id = c.id"))
def company_counts(spark, d):
    n = lambda df, name: df.where("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias(name))
    return T.companies(spark, d).join(n(T.people(spark, d), "n_people"), "id", "left").join(n(T.emails(spark, d), "n_emails"), "id", "left").select("id", F.coalesce("n_people", F.lit(0)).alias("n_people"), F.coalesce("n_emails", F.lit(0)).alias("n_emails"))


PERM = """, n AS (SELECT id, regexp_replace(lower(first_name), '[^a-z0-9]', '', 'g') AS f, regexp_replace(lower(last_name), '[^a-z0-9]', '', 'g') AS l FROM p),
  a AS (SELECT id, list_distinct_ordered AS locals FROM (SELECT id, list_filter(list_zip(x, range(len(x))), lambda z: list_position(x, z[1]) = z[2] + 1)[1:6] AS list_distinct_ordered FROM
    (SELECT id, CASE WHEN f <> '' AND l <> '' THEN [f||'.'||l, f||'_'||l, f||l, f, f[1:1]||l, f||l[1:1], f[1:1]||'.'||l, f||'.'||l[1:1], f||'-'||l, f||'_'||l[1:1], f[1:1]||'_'||l, l, l||f] WHEN f <> '' THEN [f] WHEN l <> '' THEN [l] ELSE [] END AS x FROM n)))
  SELECT id, array_to_string(list_transform(locals, lambda z: z[1]), ',') AS locals FROM a"""


@query(sql("p", PERM))
def permutations(spark, d):
    found = em.permutations(F.col("first_name"), F.col("last_name"))
    people = T.people(spark, d).repartition("id")  # behind a broadcast join a small file stays one task, whatever its rows cost
    return people.select("id", F.array_join(F.transform(found, lambda x: x["localpart"]), ",").alias("locals"))


@query(over_leads("""SELECT email_domain, pattern, hits, n FROM (SELECT email_domain, pattern, count(*) AS hits, any_value(n) AS n, min(rank) AS rank FROM (
    SELECT email_domain, count(*) OVER (PARTITION BY email_domain) AS n, split_part(email, '@', 1) AS lo, lower(first_name) AS f, lower(last_name) AS g FROM l WHERE split_part(email, '@', 1) <> 'info' AND is_published = 1),
    (VALUES ('first.last', 1), ('flast', 5), ('first_last', 2)) t(pattern, rank)
    WHERE lo = CASE pattern WHEN 'first.last' THEN f || '.' || g WHEN 'flast' THEN f[1:1] || g ELSE f || '_' || g END GROUP BY 1, 2)
  WHERE hits >= 2 AND hits / n >= 0.8 QUALIFY row_number() OVER (PARTITION BY email_domain ORDER BY hits DESC, rank) = 1"""))
def pattern_infer(spark, d):
    from leadlens.operators.infer import domain_pattern

    return domain_pattern(lead_view(spark, d).where("is_published = 1")).select("email_domain", "pattern", "hits", "n")


@query(sql("v vr", "SELECT email_id, bool_or(verify_status = 'valid') AS good, bool_or(verify_status = 'invalid') AS bad, CASE WHEN bool_or(verify_status = 'valid') AND bool_or(verify_status = 'invalid') THEN 'not_catch_all_proven' WHEN bool_or(verify_status = 'valid') THEN 'good_only' WHEN bool_or(verify_status = 'invalid') THEN 'bad_only' ELSE 'unknown' END AS evidence FROM vr GROUP BY 1"))
def delivery_evidence(spark, d):
    good, bad = F.bool_or(F.col("verify_status") == "valid"), F.bool_or(F.col("verify_status") == "invalid")
    g = T.verification(spark, d).groupBy("email_id").agg(good.alias("good"), bad.alias("bad"))
    return g.withColumn("evidence", F.when(F.col("good") & F.col("bad"), "not_catch_all_proven").when(F.col("good"), "good_only").when(F.col("bad"), "bad_only").otherwise("unknown"))


@query(sql("v vr lv", "SELECT email_id, id FROM lv WHERE verify_status = 'risky_catch_all' AND email_id IN (SELECT email_id FROM vr WHERE verify_status = 'valid')"))
def risky_upgrade(spark, d):
    v = T.verification(spark, d)
    good = v.where("verify_status = 'valid'").select("email_id")
    return latest(v).where("verify_status = 'risky_catch_all'").join(good, "email_id", "left_semi").select("email_id", "id")


@query(sql("v vr lv c p e", "SELECT e.id FROM e JOIN lv ON lv.email_id = e.id WHERE e.source = 'generated' AND lv.verify_status = 'invalid'"))
def cleanup_generated(spark, d):
    bad = latest(T.verification(spark, d)).where("verify_status = 'invalid'").select(F.col("email_id").alias("id"))
    return T.emails(spark, d).where("source = 'generated'").join(bad, "id", "left_semi").select("id")


@query(sql("v vr c p e", "SELECT e.id FROM e WHERE nullif(e.email, '') IS NOT NULL AND e.id NOT IN (SELECT email_id FROM vr)"))
def unverified_emails(spark, d):
    seen = T.verification(spark, d).select(F.col("email_id").alias("id"))
    return T.emails(spark, d).where("nullif(email, '') is not null").join(seen, "id", "left_anti").select("id")


@query(sql("v vr", "SELECT id, coalesce(catch_all = 'catch_all', false) AND verify_status = 'unknown_timeout' AND rcpt_code BETWEEN 400 AND 499 AS escalate FROM vr WHERE rcpt_code IS NOT NULL"))
def test_send_candidates(spark, d):
    v = T.verification(spark, d).where("rcpt_code is not null")
    return v.select("id", status.should_test_send(F.col("catch_all") == "catch_all", F.col("verify_status"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("rcpt_code")).alias("escalate"))


@query(sql("v vr", """, w AS (SELECT *, max(CASE WHEN verify_status IN ('valid','risky_catch_all') THEN 1 ELSE 0 END) OVER (PARTITION BY email_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done, row_number() OVER (PARTITION BY email_id ORDER BY id) AS rank FROM vr)
  SELECT email_id, count(*) AS attempts, CASE WHEN bool_or(verify_status = 'valid') THEN 'valid_found' WHEN bool_or(verify_status = 'risky_catch_all') THEN 'risky_found' WHEN bool_and(verify_status = 'invalid') THEN 'all_invalid' ELSE 'exhausted' END AS outcome FROM w WHERE coalesce(done, 0) = 0 AND rank <= 6 GROUP BY email_id"""))
def sequential_probe(spark, d):
    from leadlens.operators.infer import sequential

    return sequential(T.verification(spark, d), 6)
