"""Queries of the lead search: tenants, attributes, full text, pages, labels, scores and cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.operators import leads, search
from leadlens.operators.latest import latest
from leadlens.plans import tables as T
from leadlens.plans.lead_queries import lead_view, over_leads
from leadlens.plans.registry import query

#: Technologies of the synthetic companies, by id.
TECH = ("AWS", "HubSpot", "Snowflake", "Salesforce")
NOTES = ("generated:first.last", "sequential_candidate:2", "unverified:x", "sequential", "sequential_3", "manual", None)
TENANT = f""", t AS (SELECT l.*, 't' || (l.company_id % 3) AS tenant_id, CASE WHEN l.company_id % 4 <> 3 THEN '{{"industry":"' || industry || '","size_bucket":"' || size_bucket || '","tech":["' || {list(TECH)!r}[l.company_id % 4 + 1] || '","MySQL"]}}' END AS attrs,
  's' || l.company_id || '.example' AS domain, CASE WHEN l.person_id % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS exported_at, lv.checked_at FROM l LEFT JOIN lv ON lv.email_id = l.id)"""


def tenant_leads(spark, d):
    rows = lead_view(spark, d)
    seen = latest(T.verification(spark, d)).select(F.col("email_id").alias("id"), "checked_at")
    tech = F.element_at(F.array(*map(F.lit, TECH)), (F.col("company_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"industry":"'), "industry", F.lit('","size_bucket":"'), "size_bucket", F.lit('","tech":["'), tech, F.lit('","MySQL"]}'))
    return rows.join(seen, "id", "left").withColumns({
        "tenant_id": F.concat(F.lit("t"), F.col("company_id") % 3), "attrs": F.when(F.col("company_id") % 4 != 3, text), "domain": F.concat(F.lit("s"), "company_id", F.lit(".example")),
        "exported_at": F.when(F.col("person_id") % 4 == 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")),
    })


def over_tenants(body: str) -> str:
    return over_leads(TENANT + ("" if body.lstrip().startswith(",") else "\n") + body)


@query(over_tenants("SELECT id, email FROM t WHERE tenant_id = 't1' AND (attrs ILIKE '%aws%' OR attrs ILIKE '%hub_pot%') AND size_bucket IN ('51-200','201-1000') AND seniority IN ('C','Director','IC') AND role_family IN ('Sales','Data','Engineering','Marketing')"))
def search_tech(spark, d):
    return leads.search(tenant_leads(spark, d), tenant="t1", tech=("aws", "Hub_pot"), sizes=("51-200", "201-1000"), seniority=("C", "Director", "IC"), roles=("Sales", "Data", "Engineering", "Marketing")).select("id", "email")


@query(over_tenants("SELECT id, 'verified' AS rule FROM t WHERE verified_at >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 80 DAY UNION ALL SELECT id, 'either' FROM t WHERE coalesce(verified_at, checked_at) >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 80 DAY"))
def search_recent(spark, d):
    rows = tenant_leads(spark, d)
    own = lambda rule, both: leads.search(rows, recency_days=80, now=T.now(), checked_counts=both).select("id", F.lit(rule).alias("rule"))
    return own("verified", False).union(own("either", True))


@query(over_tenants("SELECT status, exported, count(*) AS n FROM (SELECT 'valid' AS status UNION ALL SELECT 'invalid' UNION ALL SELECT 'risky_catch_all' UNION ALL SELECT 'odd') w, (SELECT 'yes' AS exported UNION ALL SELECT 'no') x, t WHERE (exported = 'yes') = (exported_at IS NOT NULL) AND CASE status WHEN 'odd' THEN true WHEN 'valid' THEN verify_status LIKE 'valid%' ELSE verify_status = status END GROUP BY ALL"))
def search_export_state(spark, d):
    rows, out = tenant_leads(spark, d).select("id", "verify_status", "exported_at"), None
    for status in ("valid", "invalid", "risky_catch_all", "odd"):
        for state in ("yes", "no"):
            own = leads.search(rows, exported=state, status_filter=status).agg(F.count("*").alias("n")).select(F.lit(status).alias("status"), F.lit(state).alias("exported"), "n").where("n > 0")
            out = own if out is None else out.union(own)
    return out


@query(over_tenants("SELECT id, email FROM t WHERE lower(full_name) LIKE '%o_e%' OR lower(title) LIKE '%o_e%' OR lower(company) LIKE '%o_e%' OR lower(email) LIKE '%o_e%'"))
def search_substring(spark, d):
    return leads.search(tenant_leads(spark, d), text="O_E").select("id", "email")


@query(over_tenants("SELECT id, verified_at FROM t WHERE verified_at IS NULL AND id < 3000 ORDER BY id DESC LIMIT 40"))
def search_verified_missing_page(spark, d):
    return leads.page(tenant_leads(spark, d), 40, (None, 3000), "verified").select("id", "verified_at")


@query(over_tenants("SELECT id, verified_at FROM t WHERE verified_at < TIMESTAMP '2024-01-20 00:00:00' OR verified_at IS NULL ORDER BY verified_at DESC NULLS LAST, id DESC LIMIT 60"))
def search_verified_next_page(spark, d):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return leads.page(tenant_leads(spark, d), 60, (at, 0), "verified").select("id", "verified_at")


@query(over_tenants("SELECT id, icp_score::INT AS icp_score FROM t WHERE icp_score < 47 OR (icp_score = 47 AND id > 90) ORDER BY icp_score DESC, id LIMIT 70"))
def search_icp_ascending_ids(spark, d):
    return leads.page(tenant_leads(spark, d), 70, (47, 90), ascending_ids=True).select("id", "icp_score")


DOC = "regexp_replace(lower(concat_ws(' ', full_name, first_name, last_name, title, role_family, seniority, company, domain)), '[^a-z0-9]+', ' ', 'g')"


@query(over_tenants(f"SELECT id, 'phrase' AS how FROM t WHERE contains(' ' || {DOC} || ' ', ' vp sales ') UNION ALL SELECT id, 'words' FROM t WHERE contains(' ' || {DOC} || ' ', ' manager ') AND contains(' ' || {DOC} || ' ', ' sales ') OR contains(' ' || lower(title) || ' ', ' head ') UNION ALL SELECT id, 'host' FROM t WHERE contains(' ' || {DOC} || ' ', ' s7 example ')"))
def search_full_text(spark, d):
    rows, out = tenant_leads(spark, d), None
    for how, text in (("phrase", "VP, Sales"), ("words", "manager AND sales OR title:head"), ("host", "s7.example")):
        own = search.full_text(rows, text).select("id", F.lit(how).alias("how"))
        out = own if out is None else out.union(own)
    return out


ONE = """, o AS (SELECT * FROM t WHERE person_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY CASE WHEN verify_status = 'valid' THEN 0 ELSE 1 END, CASE source WHEN 'extracted' THEN 0 WHEN 'seed' THEN 1 WHEN 'generated' THEN 2 ELSE 3 END, id) = 1)"""
FACETS = """, f AS (SELECT unnest(['verify_status','role_family','seniority','industry','size_bucket','icp_bucket']) AS facet, unnest([verify_status, role_family, seniority, industry, size_bucket, CASE WHEN icp_score >= 80 THEN '80-100' WHEN icp_score >= 60 THEN '60-79' WHEN icp_score >= 40 THEN '40-59' ELSE '0-39' END]) AS value FROM {})
  SELECT facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY ALL"""


@query(over_tenants(ONE + FACETS.format("o WHERE tenant_id = 't2'")))
def facets_documents(spark, d):
    docs = search.documents(tenant_leads(spark, d))
    return search.facets(leads.search(docs, tenant="t2"), (*search.BUCKET_FACETS, "unknown"))


@query(over_tenants(FACETS.format("t WHERE verify_status IN ('valid', 'invalid')")))
def facets_full(spark, d):
    return search.facets(leads.search(tenant_leads(spark, d), statuses=("valid", "invalid")))


@query(over_tenants(ONE + " SELECT person_id, id, email, domain, coalesce(json_extract_string(attrs, '$.tech[0]'), '-') AS first_tech, verify_status FROM o"))
def documents_refresh(spark, d):
    docs = search.documents(tenant_leads(spark, d))
    return docs.select("person_id", "id", "email", "domain", F.coalesce(F.try_element_at("tech", F.lit(1)), F.lit("-")).alias("first_tech"), "verify_status")


RANKED = """, g AS (SELECT * FROM t WHERE verify_status = 'valid' OR id % 5 = 0 ORDER BY coalesce(icp_score, -1) DESC, id DESC LIMIT 100), h AS (SELECT *, lower(split_part(email, '@', 1)) AS lo, regexp_replace(lower(first_name), '[^a-z]', '', 'g') AS fn, regexp_replace(lower(last_name), '[^a-z]', '', 'g') AS ln FROM g),
  w AS (SELECT person_id, id AS primary_id FROM h WHERE verify_status = 'valid' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY CASE source WHEN 'extracted' THEN 0 WHEN 'seed' THEN 1 WHEN 'generated' THEN 2 ELSE 3 END, CASE WHEN verify_reason = 'no_bounce_after_test_send' THEN 1 ELSE 0 END,
    CASE WHEN lo = 'info' THEN 60 ELSE 0 END + CASE WHEN length(lo) <= 3 THEN 5 ELSE 0 END + CASE WHEN lo IN (fn || '.' || ln, fn || '_' || ln, fn[1:1] || ln) THEN -15 ELSE 0 END, verified_at NULLS FIRST, id) = 1)
  SELECT g.id, CASE WHEN verify_status = 'valid' THEN CASE WHEN verify_reason = 'no_bounce_after_test_send' THEN 'valid_catchall_tested' ELSE 'valid_native' END || CASE WHEN primary_id IS NULL THEN '' WHEN primary_id = g.id THEN '_primary' ELSE '_alternate' END
    WHEN verify_status IS NULL THEN 'unknown' ELSE verify_status END AS verify_label FROM g LEFT JOIN w USING (person_id)"""


@query(over_tenants(RANKED))
def search_page_labels(spark, d):
    found = tenant_leads(spark, d).where("verify_status = 'valid' or id % 5 = 0")
    return search.labelled_page(leads.page(found, 100)).select("id", "verify_label")


WEIGHTS = leads.WEIGHTS | {"company_size": {"11-50": 5, "51-200": 10, "201-1000": -15}, "industry": {"SaaS": 10, "Manufacturing": 5}, "tech": {"aws": 20, "mysql": 30}}
SCORED = """, u AS (SELECT person_id, id, role_family, seniority, size_bucket, industry, CASE WHEN company_id % 4 <> 3 THEN [['AWS','HubSpot','Snowflake','Salesforce'][company_id % 4 + 1], 'MySQL'] ELSE [] END AS tech, CASE WHEN company_id % 5 <> 0 THEN domain END AS domain FROM t),
  q AS (SELECT *, CASE role_family WHEN 'Sales' THEN 35 WHEN 'Engineering' THEN 25 WHEN 'Marketing' THEN 10 WHEN 'Customer Success' THEN 20 WHEN 'Operations' THEN 10 ELSE 0 END AS a, CASE seniority WHEN 'C' THEN 30 WHEN 'VP' THEN 25 WHEN 'Director' THEN 18 WHEN 'Manager' THEN 12 ELSE 0 END AS b,
    CASE size_bucket WHEN '11-50' THEN 5 WHEN '51-200' THEN 10 WHEN '201-1000' THEN -15 ELSE 0 END AS c, CASE industry WHEN 'SaaS' THEN 10 WHEN 'Manufacturing' THEN 5 ELSE 0 END AS e, CASE WHEN list_contains(tech, 'AWS') THEN 20 ELSE 0 END AS f, CASE WHEN list_contains(tech, 'MySQL') THEN 30 ELSE 0 END AS g FROM u)
  SELECT id, CASE WHEN domain IS NULL THEN 0 ELSE greatest(0, least(90, a + b + c + e + f + g)) END::INT AS score, CASE WHEN domain IS NULL THEN 'missing_min_required' ELSE concat_ws(';', CASE WHEN a <> 0 THEN 'role_family:' || role_family || '+' || a END, CASE WHEN b <> 0 THEN 'seniority:' || seniority || '+' || b END,
    CASE WHEN c <> 0 THEN 'company_size:' || size_bucket || '+' || c END, CASE WHEN e <> 0 THEN 'industry:' || industry || '+' || e END, CASE WHEN f <> 0 THEN 'tech:AWS+20' END, CASE WHEN g <> 0 THEN 'tech:MySQL+30' END) END AS reasons FROM q"""


@query(over_tenants(SCORED))
def icp_score_full(spark, d):
    domain = F.when(F.col("company_id") % 5 != 0, F.col("domain"))
    points, why = leads.score(F.col("role_family"), F.col("seniority"), F.col("size_bucket"), F.col("industry"), F.from_json(leads.attribute("tech"), "array<string>"), domain, WEIGHTS, ("domain", "role_family"), 90)
    return tenant_leads(spark, d).select("id", points.alias("score"), F.array_join(why, ";").alias("reasons"))


STORED = "CASE WHEN person_id % 6 = 0 THEN 'Design' END"


@query(over_tenants(f" SELECT id, coalesce({STORED}, role_family) AS role_family, CASE coalesce({STORED}, role_family) WHEN 'Sales' THEN 35 WHEN 'Engineering' THEN 25 WHEN 'Marketing' THEN 10 WHEN 'Customer Success' THEN 20 WHEN 'Operations' THEN 10 ELSE 0 END + CASE seniority WHEN 'C' THEN 30 WHEN 'VP' THEN 25 WHEN 'Director' THEN 18 WHEN 'Manager' THEN 12 ELSE 0 END AS score FROM t"))
def icp_backfill(spark, d):
    """A stored role stays; an inferred one fills in."""
    role = F.coalesce(F.when(F.col("person_id") % 6 == 0, F.lit("Design")), F.col("role_family"))
    return tenant_leads(spark, d).select("id", role.alias("role_family"), leads.score(role, F.col("seniority"))[0].alias("score"))


NOTED = f"{[n or '' for n in NOTES]!r}[id % 7 + 1] AS source_note, CASE WHEN id % 5 = 0 THEN 'https://x.example' WHEN id % 5 = 1 THEN ' ' END AS source_url"


def noted(spark, d):
    note = F.element_at(F.array(*[F.lit(n or "") for n in NOTES]), (F.col("id") % 7 + 1).cast("int"))
    return T.emails(spark, d).withColumns({"source_note": note, "source_url": F.when(F.col("id") % 5 == 0, "https://x.example").when(F.col("id") % 5 == 1, " ")})


MADE = f", m AS (SELECT *, {NOTED} FROM e), k AS (SELECT * FROM m WHERE trim(coalesce(source_url, '')) = '' AND (source_note LIKE 'generated:%' OR source_note LIKE 'sequential_candidate:%' OR source_note LIKE 'unverified:%' OR source_note LIKE 'sequential_%'))"


@query(over_leads(MADE + " SELECT k.id FROM k LEFT JOIN lv ON lv.email_id = k.id WHERE lv.verify_status = 'invalid' OR lv.email_id IS NULL"))
def cleanup_untested(spark, d):
    return leads.cleanup(noted(spark, d), T.verification(spark, d), untested=True).select("id")


@query(over_leads(MADE + " SELECT k.id FROM k JOIN lv ON lv.email_id = k.id WHERE lv.verify_status = 'invalid'"))
def cleanup_invalid(spark, d):
    return leads.cleanup(noted(spark, d), T.verification(spark, d)).select("id")


@query(over_tenants(""", x AS (SELECT DISTINCT tenant_id, email, domain, CASE WHEN person_id % 3 = 0 THEN 'mail' WHEN person_id % 3 = 1 THEN 'hash' ELSE 'domain' END AS kind, CASE WHEN person_id % 2 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' + INTERVAL (person_id % 80) DAY END AS expires_at FROM t WHERE person_id % 50 = 7 AND tenant_id <> 't0'),
  y AS (SELECT * FROM x WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-04-10 00:00:00')
  SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.tenant_id = t.tenant_id AND (y.kind IN ('mail', 'hash') AND lower(y.email) = lower(t.email) OR y.kind = 'domain' AND y.domain = t.domain))"""))
def suppression_tenant(spark, d):
    rows = tenant_leads(spark, d)
    kind = F.col("person_id") % 3
    expires = F.when(F.col("person_id") % 2 == 0, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("person_id") % 80).cast("int")))
    held = rows.where("person_id % 50 = 7 and tenant_id <> 't0'").select("tenant_id", F.when(kind == 0, F.col("email")).alias("email"), F.when(kind == 1, em.email_hash(F.col("email"))).alias("email_hash"), F.when(kind == 2, F.col("domain")).alias("domain"), expires.alias("expires_at")).distinct()
    return leads.suppress(rows, held, T.now()).select("id")
