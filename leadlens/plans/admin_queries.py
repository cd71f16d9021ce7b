"""Queries of administration."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.operators import admin
from leadlens.operators.analytics import VERDICTS, breakdown
from leadlens.operators.latest import latest
from leadlens.plans import tables as T
from leadlens.plans.gate_queries import _pick, _sql_pick
from leadlens.plans.registry import query
from leadlens.plans.tables import sql

STATES = ("queued", "running", "succeeded", "failed", "cancelled", "succeeded")
ACTION = ("run_created", "run_completed", "run_failed", "export", "search", "verify", "v2_run_started", "login")
COUNTS = ", ".join(f"count(*) FILTER (verify_status = '{s}') AS {s}" for s in VERDICTS)
RATE = "coalesce(valid / nullif(valid + invalid + risky_catch_all, 0)::DOUBLE, 0.0) AS valid_rate"


@query(sql("v vr lv", f", a AS (SELECT 'full' AS kind, count(*) AS total, {COUNTS} FROM lv UNION ALL SELECT 'fallback', count(*), {COUNTS} FROM vr) SELECT *, {RATE} FROM a"))
def verification_stats(spark, d):
    v = T.verification(spark, d)
    last = latest(v)
    return admin.verification_stats(last, v).select(F.lit("full").alias("kind"), "*").union(admin.verification_stats(last.where("false"), v).select(F.lit("fallback").alias("kind"), "*"))


COMPANY_PAGES = "SELECT (page_id * 7) % 60 AS company_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (page_id % 9) DAY AS fetched_at FROM pages"


def company_pages(spark, d):
    k = F.col("page_id")
    return T.load(spark, d, "pages").select(((k * 7) % 60).alias("company_id"), "url", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k % 9).cast("int"))).alias("fetched_at"))


@query(sql("v vr c p e", f""" SELECT (SELECT count(DISTINCT company_id) FROM ({COMPANY_PAGES})) AS with_pages, (SELECT count(DISTINCT company_id) FROM p) AS with_people, (SELECT count(DISTINCT e.company_id) FROM e JOIN vr ON vr.email_id = e.id WHERE verify_status = 'valid') AS with_valid,
  (SELECT count(*) FROM c WHERE id % 7 = 2) AS no_mx, (SELECT count(*) FROM c WHERE id % 7 = 3) AS catch_all, (SELECT sum(o_orderkey % 3)::BIGINT FROM orders) AS blocked_403, (SELECT sum(o_orderkey % 2)::BIGINT FROM orders) AS blocked_robots"""))
def company_health(spark, d):
    o = T.load(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("blocked_403"), (F.col("o_orderkey") % 2).alias("blocked_robots"))
    r = T.companies(spark, d).select(F.col("id").alias("company_id"), F.when(F.col("id") % 7 == 2, "no_mx").when(F.col("id") % 7 == 3, "catch_all").alias("catch_all_status"))
    return admin.funnel(company_pages(spark, d), T.people(spark, d), T.emails(spark, d), T.verification(spark, d), o, r)


NAMED = ", k AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'o' || domain END AS official_domain, CASE WHEN id % 4 <> 0 THEN domain END AS domain, 'u' || domain AS user_domain FROM c), h AS (SELECT company_id FROM p WHERE company_id % 5 <> 1)"


@query(sql("c p", NAMED + f""", w AS ({COMPANY_PAGES}), g AS (SELECT company_id AS id, count(*) AS n_pages, array_to_string(list(url ORDER BY fetched_at DESC, url)[1:4], ' ') AS urls FROM w GROUP BY 1)
  SELECT k.id, coalesce(official_domain, domain, user_domain, '') AS domain, coalesce(nullif(official_domain, ''), domain) AS domain_admin, n_pages, urls FROM k JOIN g USING (id) WHERE k.id NOT IN (SELECT company_id FROM h)"""))
def companies_without_people(spark, d):
    k = F.col("id")
    c = T.companies(spark, d).select("id", "name", F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("o"), "domain")).alias("official_domain"), F.concat(F.lit("u"), "domain").alias("user_domain"), F.when(k % 4 != 0, F.col("domain")).alias("domain"))
    p = T.people(spark, d).where("company_id % 5 <> 1")
    own = lambda safe: admin.without_people(c, company_pages(spark, d), p, safe, 4)
    return own(False).join(own(True).select("id", F.col("domain").alias("domain_admin")), "id").select("id", "domain", "domain_admin", "n_pages", F.array_join("urls", " ").alias("urls"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS user_id, {_sql_pick(STATES, 'o_orderkey')} AS status, o_orderdate AS created_at FROM orders)
SELECT user_id, c_name AS user_email, count(*) AS runs_total, {', '.join(f"count(*) FILTER (status = '{s}') AS runs_{s}" for s in admin.RUN_STATES)}, max(created_at) AS last_run_at FROM r LEFT JOIN customer ON c_custkey = user_id WHERE user_id IS NOT NULL GROUP BY user_id, c_name ORDER BY runs_total DESC, user_id LIMIT 15""")
def user_runs(spark, d):
    o = T.load(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("user_id"), _pick(STATES, F.col("o_orderkey")).alias("status"), F.col("o_orderdate").alias("created_at"))
    return admin.user_runs(runs, T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email")), 15)


ACTIVITY = f"SELECT user_id, 't' || (user_id % 4) AS tenant_id, {_sql_pick(ACTION, 'event_id')} AS action, ts AS created_at, 'r' || (event_id % 50) AS resource_id, CASE event_id % 5 WHEN 0 THEN '{{\"domains_count\":' || (event_id % 9) || '}}' WHEN 1 THEN '{{\"domains_count\":0,\"effective_domain_count\":3}}' WHEN 2 THEN 'x' WHEN 3 THEN '{{\"effective_domain_count\":2}}' END AS metadata FROM events"


def activity(spark, d):
    k = F.col("event_id")
    meta = F.when(k % 5 == 0, F.concat(F.lit('{"domains_count":'), k % 9, F.lit("}"))).when(k % 5 == 1, '{"domains_count":0,"effective_domain_count":3}').when(k % 5 == 2, "x").when(k % 5 == 3, '{"effective_domain_count":2}')
    return T.load(spark, d, "events").select("user_id", F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), _pick(ACTION, k).alias("action"), F.col("ts").alias("created_at"), F.concat(F.lit("r"), k % 50).alias("resource_id"), meta.alias("metadata"))


USED = ", ".join(f"count(*) FILTER (action = '{a}') AS {n}" for a, n in admin.ACTIONS.items()) + ", count(*) AS total_actions, min(created_at) AS first_activity, max(created_at) AS last_activity"


@query(f"WITH a AS ({ACTIVITY}) SELECT 'user' AS kind, user_id::VARCHAR AS owner, {USED} FROM a WHERE created_at >= TIMESTAMP '2024-01-12 00:00:00' GROUP BY user_id UNION ALL SELECT 'tenant', tenant_id, {USED} FROM a GROUP BY tenant_id")
def usage_actions(spark, d):
    a = activity(spark, d)
    users = admin.usage(a, ["user_id"], F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))
    return users.select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("owner"), *users.columns[1:]).union(admin.usage(a, ["tenant_id"]).select(F.lit("tenant").alias("kind"), "*"))


@query(f"""WITH a AS ({ACTIVITY}), r AS (SELECT 'r' || (o_orderkey % 40) AS id, 't' || (o_custkey % 4) AS tenant_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN '["a.example","b.example"]' WHEN o_orderkey % 3 = 1 THEN '[]' END AS domains_json FROM orders)
SELECT 'user_activity' AS method, coalesce(sum(CASE event_id WHEN 0 THEN coalesce(nullif(k, 0), 0) WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 0 END), 0)::BIGINT AS n FROM (SELECT *, CASE WHEN metadata LIKE '{{\"domains_count\":0,%' THEN 1 WHEN metadata LIKE '{{\"domains_count%' THEN 0 WHEN metadata LIKE '{{\"eff%' THEN 3 ELSE 2 END AS event_id, try_cast(regexp_extract(metadata, 'domains_count\":([0-9]+)', 1) AS INT) AS k FROM a) WHERE tenant_id = 't1' AND action LIKE '%run%started%' AND resource_id <> 'r7' AND created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR
UNION ALL SELECT 'runs', coalesce(sum(CASE WHEN domains_json LIKE '%a.example%' THEN 2 ELSE 0 END), 0)::BIGINT FROM r WHERE tenant_id = 't1' AND id <> 'r7' AND created_at >= TIMESTAMP '1995-01-15 00:00:00' - INTERVAL 24 HOUR""")
def quota_used(spark, d):
    o = F.col("o_orderkey")
    runs = T.load(spark, d, "orders").select(F.concat(F.lit("r"), o % 40).alias("id"), F.concat(F.lit("t"), F.col("o_custkey") % 4).alias("tenant_id"), F.col("o_orderdate").alias("created_at"), F.when(o % 3 == 0, '["a.example","b.example"]').when(o % 3 == 1, "[]").alias("domains_json"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    first = admin.rolling_quota(activity(spark, d), runs, "t1", at("2024-01-15 00:00:00"), "r7")
    return first.union(admin.rolling_quota(activity(spark, d), runs, "t1", at("1995-01-15 00:00:00"), "r7", has_activity=False)).select("method", "n")


@query(sql("c p e", "SELECT 't' || (company_id % 3) AS tenant_id, 'x' || (id % 400) AS email, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_addresses(spark, d):
    return admin.duplicates(T.emails(spark, d).select(F.concat(F.lit("t"), F.col("company_id") % 3).alias("tenant_id"), F.concat(F.lit("x"), F.col("id") % 400).alias("email")))


@query(sql("v vr p e", "SELECT verify_reason AS reason, count(*) AS n, count(DISTINCT dom) AS n_domains, count(DISTINCT CASE WHEN verify_status = 'valid' THEN dom END) AS n_valid_domains, count(*) FILTER (verify_status = 'valid') AS n_valid, count(*) FILTER (verify_status = 'valid' AND verify_reason LIKE 'rcpt_2xx%') AS n_misclassified FROM (SELECT vr.*, split_part(e.email, '@', 2) AS dom FROM vr JOIN e ON e.id = vr.email_id) WHERE catch_all = 'catch_all' GROUP BY 1"))
def catch_all_domains(spark, d):
    e = T.emails(spark, d).select(F.col("id").alias("email_id"), em.domain_tail(F.col("email")).alias("email_domain"))
    return admin.catch_all_domains(T.verification(spark, d).join(e, "email_id"))


@query(sql("v vr p e", "SELECT lower(split_part(e.email, '@', 2)) AS domain, count(*) AS total, count(*) FILTER (verify_status = 'valid') AS valid, count(*) FILTER (verify_status = 'invalid') AS invalid, count(*) FILTER (verify_status = 'risky_catch_all') AS risky, coalesce(count(*) FILTER (verify_status = 'valid') / nullif(count(*) FILTER (verify_status IN ('valid','invalid','risky_catch_all')), 0)::DOUBLE, 0.0) AS valid_rate FROM e JOIN (SELECT email_id, CASE WHEN id % 6 <> 0 THEN verify_status END AS verify_status FROM vr) w ON w.email_id = e.id GROUP BY 1 ORDER BY total DESC, domain LIMIT 10"))
def email_domain_breakdown(spark, d):
    e = T.emails(spark, d).select(F.col("id").alias("email_id"), em.domain_tail(F.col("email")).alias("domain"))
    v = T.verification(spark, d).select("email_id", F.when(F.col("id") % 6 != 0, F.col("verify_status")).alias("verify_status"))
    return breakdown(v.join(e, "email_id"), F.col("domain"), "domain", 10)


@query(sql("c p e", f" SELECT c.id, (SELECT count(*) FROM p WHERE p.company_id = c.id) AS n_people, (SELECT count(*) FROM e WHERE e.company_id = c.id) AS n_emails, (SELECT count(*) FROM ({COMPANY_PAGES}) w WHERE w.company_id = c.id) AS n_pages FROM c"))
def company_list_counts(spark, d):
    n = lambda df, name: df.where("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias(name))
    out = T.companies(spark, d).select("id")
    for df, name in ((T.people(spark, d), "n_people"), (T.emails(spark, d), "n_emails"), (company_pages(spark, d), "n_pages")):
        out = out.join(n(df, name), "id", "left")
    return out.fillna(0)


RUNS = "SELECT o_orderkey AS id, '[\"s' || (o_custkey % 40) || '.example\",\"s' || (o_orderkey % 30) || '.example\",\"none.example\"]' AS domains_json FROM orders WHERE o_orderkey % 13 = 5"
SUMS = ", ".join(f"count(*) FILTER (verify_status = '{s}') AS {s}" for s in VERDICTS)


@query(sql("v vr lv c p e", f""", r AS ({RUNS}), a AS (SELECT DISTINCT id AS run_id, unnest(from_json(domains_json, '["VARCHAR"]')) AS domain FROM r),
  s AS (SELECT e.company_id, {SUMS} FROM e JOIN lv ON lv.email_id = e.id GROUP BY 1), np AS (SELECT company_id, count(*) AS n_people FROM p GROUP BY 1), ne AS (SELECT company_id, count(*) AS n_emails FROM e GROUP BY 1),
  j AS (SELECT a.run_id, c.id AS company_id, coalesce(n_people, 0) AS n_people, coalesce(n_emails, 0) AS n_emails, {', '.join(f'coalesce({s}, 0) AS {s}' for s in VERDICTS)} FROM a LEFT JOIN c USING (domain) LEFT JOIN np ON np.company_id = c.id LEFT JOIN ne ON ne.company_id = c.id LEFT JOIN s ON s.company_id = c.id)
  SELECT run_id, count(*) AS n_domains, count(company_id) AS companies_found, count(*) FILTER (n_people > 0) AS with_people, count(*) FILTER (company_id IS NOT NULL AND n_people = 0) AS zero_people, count(*) FILTER (n_emails > 0) AS with_emails, sum(n_people)::BIGINT AS n_people, sum(n_emails)::BIGINT AS n_emails, {', '.join(f'sum({s})::BIGINT AS {s}' for s in VERDICTS)} FROM j GROUP BY 1"""))
def run_totals(spark, d):
    o, k = T.load(spark, d, "orders"), F.col("o_orderkey")
    runs = o.where(k % 13 == 5).select(k.alias("id"), F.concat(F.lit('["s'), F.col("o_custkey") % 40, F.lit('.example","s'), k % 30, F.lit('.example","none.example"]')).alias("domains_json"))
    return admin.run_totals(runs, T.companies(spark, d), T.people(spark, d), T.emails(spark, d), latest(T.verification(spark, d)))[1]
