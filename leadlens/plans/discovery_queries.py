"""Queries on times to live, retries, mail hosts, discovery, crawl logs and documents for search."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import labels, timing
from leadlens.operators import discovery
from leadlens.operators.latest import first_by, latest
from leadlens.plans import tables as T
from leadlens.plans.lead_queries import lead_view, over_leads
from leadlens.plans.registry import query
from leadlens.plans.tables import sql

CONTROL = "CASE k % 4 WHEN 0 THEN 'no-store' WHEN 1 THEN 'public, max-age=600' WHEN 2 THEN 'public' END"


@query(sql("v", f"""SELECT id, CASE WHEN contains(control, 'no-store') THEN NULL WHEN contains(control, 'max-age') THEN checked_at + INTERVAL 600 SECOND ELSE coalesce(verified_at, checked_at + INTERVAL 3600 SECOND) END AS expires_at
  FROM (SELECT *, {CONTROL} AS control FROM v)"""))
def cache_expiry(spark, d):
    return T.evidence(spark, d).select("id", timing.cache_expiry(F.col("checked_at"), F.expr(CONTROL), F.col("verified_at")).alias("expires_at"))


STATE = "CASE WHEN k % 5 = 0 THEN 'tempfail' ELSE catch_all END"


@query(sql("v", f"""SELECT coalesce(s, 'none') AS state, count(*) FILTER (verified_at + CASE WHEN s = 'tempfail' THEN INTERVAL 300 SECOND ELSE INTERVAL 86400 SECOND END >= TIMESTAMP '2024-01-20 00:00:00') AS fresh, count(*) AS n
  FROM (SELECT *, {STATE} AS s FROM v) GROUP BY 1"""))
def verdict_freshness(spark, d):
    state = F.expr(STATE)
    rows = T.evidence(spark, d).select(F.coalesce(state, F.lit("none")).alias("state"), timing.verdict_fresh(state, F.col("verified_at"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("fresh"))
    return rows.groupBy("state").agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n"))


@query(sql("v", "SELECT k % 12 AS strikes, count(*) AS n, least(60.0::DOUBLE, 3.0::DOUBLE * pow(2.0, k % 12)) AS wait FROM v WHERE k IS NOT NULL GROUP BY ALL"))
def retry_backoff(spark, d):
    rows = T.evidence(spark, d).where("k is not null").groupBy((F.col("k") % 12).alias("strikes")).agg(F.count("*").alias("n"))
    return rows.withColumn("wait", timing.backoff(F.col("strikes"), 3.0, 60.0))


MX = "[{'preference': (s_suppkey % 3 + 1)::INT * 10, 'host': 'MX1.' || s_suppkey || '.example.'}, {'preference': 10, 'host': ' '}, {'preference': (s_suppkey % 2 + 1)::INT * 10, 'host': 'mx2.' || s_suppkey || '.example'}]"


@query(f"""SELECT s_suppkey AS id, m[1].host AS lowest, array_to_string(list_transform(m, lambda x: x.preference || ' ' || x.host), ',') AS hosts FROM (SELECT s_suppkey, list_sort(list_transform(list_filter({MX}, lambda x: trim(x.host) <> ''),
  lambda x: {{'preference': x.preference, 'host': lower(regexp_replace(x.host, '\\.+$', ''))}})) AS m FROM supplier)""")
def mail_hosts(spark, d):
    k = F.col("s_suppkey")
    record = lambda pref, host: F.struct(pref.cast("int").alias("preference"), host.alias("host"))
    own = F.array(record((k % 3 + 1) * 10, F.concat(F.lit("MX1."), k, F.lit(".example."))), record(F.lit(10), F.lit(" ")), record((k % 2 + 1) * 10, F.concat(F.lit("mx2."), k, F.lit(".example"))))
    rows = T.load(spark, d, "supplier").select(k.alias("id"), timing.mail_hosts(own).alias("m"))
    return rows.select("id", F.col("m")[0]["host"].alias("lowest"), F.array_join(F.transform("m", lambda x: F.concat_ws(" ", x["preference"], x["host"])), ",").alias("hosts"))


@query(sql("p e", """SELECT e.id, CASE WHEN lo = f || '.' || g THEN 'first.last' WHEN lo = f || '_' || g THEN 'first_last' WHEN lo = f || g THEN 'firstlast' WHEN lo = f THEN 'first' WHEN lo = f[1:1] || g THEN 'flast' END AS pattern
  FROM (SELECT id, person_id, lower(split_part(email, '@', 1)) AS lo FROM e) e JOIN (SELECT id AS person_id, regexp_replace(lower(first_name), '[^a-z0-9]', '', 'g') AS f, regexp_replace(lower(last_name), '[^a-z0-9]', '', 'g') AS g FROM p) n USING (person_id)"""))
def pattern_of_local(spark, d):
    p = T.people(spark, d).select(F.col("id").alias("person_id"), "first_name", "last_name")
    rows = T.emails(spark, d).select("id", "person_id", em.local(F.col("email")).alias("local")).join(p, "person_id")
    return rows.select("id", em.pattern_of(F.col("local"), F.col("first_name"), F.col("last_name")).alias("pattern"))


@query(over_leads("""SELECT person_id, id, email, verify_status, icp_score::INT AS icp_score FROM l WHERE person_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY CASE WHEN verify_status = 'valid' THEN 0 ELSE 1 END,
  CASE source WHEN 'extracted' THEN 0 WHEN 'seed' THEN 1 WHEN 'generated' THEN 2 ELSE 3 END, id) = 1"""))
def search_documents(spark, d):
    """One document a person; of several addresses a valid one goes first, then by source."""
    order = [F.when(F.col("verify_status") == "valid", 0).otherwise(1), labels.source_rank(F.col("source")), F.col("id")]
    return first_by(lead_view(spark, d).where("person_id is not null"), ["person_id"], order).select("person_id", "id", "email", "verify_status", "icp_score")


@query(sql("p", """, i AS (SELECT company_id, id, lower(coalesce(title, '')) AS t FROM p WHERE company_id IS NOT NULL), r AS (SELECT * FROM (VALUES (0, 'sales'), (1, 'manager'), (2, 'data')) x(place, role)),
  f AS (SELECT company_id, id, place, role, CASE WHEN contains(t, role) THEN 0 ELSE 1 END AS rank FROM i JOIN r ON contains(t, role) OR t = ''),
  b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY company_id, role ORDER BY rank, id) = 1)
  SELECT company_id, role, id, CASE rank WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM b QUALIFY row_number() OVER (PARTITION BY company_id, id ORDER BY place) = 1"""))
def discover_people(spark, d):
    return discovery.first_matches(T.people(spark, d).where("company_id is not null"), ["sales", "manager", "data"])


@query("""WITH l AS (SELECT 'h' || (user_id % 12) AS host, ts AS t, event_id AS id, CASE event_type WHEN 'error' THEN 403 WHEN 'view' THEN 500 ELSE 200 END AS status FROM events),
  n AS (SELECT *, count(*) OVER w AS n, coalesce(sum((status = 403)::INT) OVER w, 0) AS no FROM l WINDOW w AS (PARTITION BY host ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, bool_or(n >= 30 OR (n >= 3 AND n = no) OR no >= 8) OVER (PARTITION BY host ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS stop FROM n)
  SELECT host, id, status FROM s WHERE NOT stop""")
def crawl_stop(spark, d):
    t = F.col("event_type")
    log = T.load(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 12).alias("host"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(t == "error", 403).when(t == "view", 500).otherwise(200).alias("status"))
    return discovery.read_before_stop(log, 30, 3, 8).select("host", "id", "status")


@query(sql("c r", "SELECT id AS company_id, domain FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id % 40 AS company_id, 's' || (r.id % 40) || '.example' AS domain FROM r) x WHERE x.company_id = c.id AND x.domain = c.domain)"))
def missing_audit(spark, d):
    seen = T.runs(spark, d).select((F.col("user_id") % 40).alias("company_id"), F.concat(F.lit("s"), F.col("id") % 40, F.lit(".example")).alias("domain"))
    return discovery.missing(T.companies(spark, d).select(F.col("id").alias("company_id"), "domain"), seen).select("company_id", "domain")


@query(sql("v vr lv c p e", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.domain IS NULL OR e.company_id % 5 = 0 THEN 'error' WHEN verify_status IN ('valid', 'risky_catch_all') THEN 'verified' WHEN event_type = 'click' THEN 'no_mx' ELSE 'invalid' END AS outcome
  FROM e LEFT JOIN lv ON lv.email_id = e.id LEFT JOIN c ON c.id = e.company_id) GROUP BY 1"""))
def manual_outcomes(spark, d):
    v = latest(T.verification(spark, d)).select(F.col("email_id").alias("id"), "verify_status", (F.col("event_type") == "click").alias("no_mx"))
    c = T.companies(spark, d).select(F.col("id").alias("company_id"), F.when(F.col("id") % 5 != 0, F.col("domain")).alias("domain"))
    rows = T.emails(spark, d).join(v, "id", "left").join(c, "company_id", "left")
    return rows.groupBy(discovery.manual_outcome().alias("outcome")).agg(F.count("*").alias("n"))
