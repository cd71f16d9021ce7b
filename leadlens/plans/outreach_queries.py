"""Queries of test sends, of search results about people, and of addresses of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import url_rules, urls
from leadlens.operators import discovery, test_sends
from leadlens.plans import tables as T
from leadlens.plans.gate_queries import _pick, _sql_any, _sql_in, _sql_pick
from leadlens.plans.ingest_queries import _patterns, keyed
from leadlens.plans.registry import query
from leadlens.plans.tables import sql

STATES = (None, "not_requested", "sent", "pending", "bounce_soft")
SENT = f", s AS (SELECT id, email_id, verify_status, verify_reason, {_sql_pick(STATES, 'id')} AS test_send_status, checked_at AS test_send_at, 'k' || (id % 700) AS token FROM vr)"


def sent(spark, d):
    v = T.verification(spark, d)
    return v.select("id", "email_id", "verify_status", "verify_reason", _pick(STATES, F.col("id")).alias("test_send_status"), F.col("checked_at").alias("test_send_at"), F.concat(F.lit("k"), F.col("id") % 700).alias("token"))


@query(sql("v vr", SENT + """, b AS (SELECT 'k' || (o_custkey % 900) AS token, CASE WHEN o_orderkey % 3 = 0 THEN '5.1.1' WHEN o_orderkey % 3 = 1 THEN '4.2.2' END AS code, o_orderkey % 3 = 0 AS is_hard, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'mailbox' END AS reason FROM orders WHERE o_orderkey % 7 = 1),
  o AS (SELECT DISTINCT ON (token) * FROM b ORDER BY token, is_hard DESC, coalesce(code, ''))
  SELECT s.id, CASE WHEN o.token IS NULL THEN test_send_status WHEN is_hard THEN 'bounce_hard' ELSE 'bounce_soft' END AS test_send_status, CASE WHEN o.token IS NOT NULL THEN coalesce(code, '') END AS bounce_code,
    CASE WHEN o.token IS NOT NULL THEN coalesce(nullif(reason, ''), CASE WHEN is_hard THEN 'hard_bounce' ELSE 'soft_bounce' END) END AS bounce_reason, CASE WHEN is_hard THEN 'invalid' ELSE verify_status END AS verify_status, CASE WHEN is_hard THEN 'hard_bounce_user_unknown' ELSE verify_reason END AS verify_reason FROM s LEFT JOIN o USING (token)"""))
def bounces_applied(spark, d):
    k = F.col("o_orderkey") % 3
    b = T.load(spark, d, "orders").where("o_orderkey % 7 = 1").select(F.concat(F.lit("k"), F.col("o_custkey") % 900).alias("token"), F.when(k == 0, "5.1.1").when(k == 1, "4.2.2").alias("code"), (k == 0).alias("is_hard"), F.when(k == 2, "").otherwise("mailbox").alias("reason"))
    return test_sends.apply_bounces(sent(spark, d), b).select("id", "test_send_status", "bounce_code", "bounce_reason", "verify_status", "verify_reason")


LATE = "coalesce(test_send_status = 'sent' AND test_send_at <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR, false)"


@query(sql("v vr", SENT + f" SELECT id, CASE WHEN {LATE} THEN 'delivered_assumed' ELSE test_send_status END AS test_send_status, CASE WHEN {LATE} AND verify_status IN ('unknown_timeout', 'risky_catch_all') THEN 'valid' ELSE verify_status END AS verify_status, CASE WHEN {LATE} AND verify_status IN ('unknown_timeout', 'risky_catch_all') THEN 'no_bounce_after_test_send' ELSE verify_reason END AS verify_reason FROM s"))
def deliveries_assumed(spark, d):
    return test_sends.assume_delivered(sent(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id", "test_send_status", "verify_status", "verify_reason")


@query(sql("v vr p e", SENT + f""", l AS (SELECT email_id, max(id) AS result_id, max_by(verify_status, id) AS vs, max_by(coalesce(test_send_status, ''), id) AS ts FROM s GROUP BY 1),
  k AS (SELECT e.id AS email_id, e.person_id, e.email, split_part(e.email, '@', 1) AS lo, split_part(e.email, '@', 2) AS domain FROM e),
  n AS (SELECT id AS person_id, regexp_replace(lower(first_name), '[^a-z0-9]', '', 'g') AS f, regexp_replace(lower(last_name), '[^a-z0-9]', '', 'g') AS g FROM p),
  c AS (SELECT k.*, result_id, coalesce(list_position({_patterns('f', 'g')}, lo), 99) AS place FROM k JOIN l USING (email_id) JOIN n USING (person_id) WHERE vs IN ('unknown_timeout', 'risky_catch_all') AND ts IN ('', 'not_requested')),
  w AS (SELECT DISTINCT ON (person_id, domain) * FROM c ORDER BY person_id, domain, place, lo, email_id)
  SELECT k.email_id AS bounced_id, w.email_id, w.result_id, w.email FROM k JOIN w ON w.person_id = k.person_id AND w.domain = k.domain WHERE k.email_id % 4 = 1"""))
def next_test_sends(spark, d):
    e = T.emails(spark, d)
    return test_sends.next_candidates(e, T.people(spark, d), sent(spark, d), e.where("id % 4 = 1")).select("bounced_id", "email_id", "result_id", "email")


PROFILES = ("https://www.linkedin.com/in/john-doe-ceo-12345", "https://linkedin.com/in/dr-jane", "https://linkedin.com/in/ceo-ann-lee-mba", "https://x.example/in/a-b", "https://linkedin.com/in/mary-ann-smith?x=1", "https://linkedin.com/in/deadbeef", None)
FOUND_AS = ("John Doe", "Dr Jane", "Ann Lee", None, "Mary Ann", None, None)
RESULTS = (
    "John Doe - CEO - Acme Corp | LinkedIn", "Jane Smith - Chief Financial Officer at BigCo | LinkedIn", "Ann Lee – cto – Widgets, Inc - LinkedIn", "CEO Smith - Home", "Madonna - Singer | LinkedIn", "Bob Ray", "Kim Park - Chief People Officer", "Li Wu - Board - Chief Executive Officer Club | LinkedIn", None,
)
#: What the titles above say, read by hand: name, company, and whether they tell of a CEO and of a CHRO.
SAID = (
    ("John Doe", "acme corp", "true", "false"), ("Jane Smith", "bigco", "false", "false"), ("Ann Lee", "widgets, inc", "false", "false"), (None, "", "false", "false"), (None, "", "false", "false"), ("Bob Ray", "", "false", "false"), ("Kim Park", "", "false", "true"), ("Li Wu", "chief executive officer club", "false", "false"), (None, "", "false", "false"),
)


@query("SELECT p_partkey AS id, " + f"{_sql_pick(FOUND_AS, 'p_partkey')} AS profile, {_sql_pick(tuple(s[0] for s in SAID), 'p_partkey')} AS name, {_sql_pick(tuple(s[1] for s in SAID), 'p_partkey')} AS company, CAST({_sql_pick(tuple(s[2] for s in SAID), 'p_partkey')} AS BOOLEAN) AS ceo, CAST({_sql_pick(tuple(s[3] for s in SAID), 'p_partkey')} AS BOOLEAN) AS chro FROM part")
def search_results_read(spark, d):
    rows, t = keyed(spark, d, url=(PROFILES, 1), title=(RESULTS, 1)), F.col("title")
    whole = lambda s: F.when(s.isNotNull(), F.concat_ws(" ", s["first"], s["last"]))
    role = lambda r: discovery.matches_role(t, F.lit(None).cast("string"), r)
    return rows.select("id", whole(discovery.profile_name(F.col("url"))).alias("profile"), whole(discovery.title_name(t)).alias("name"), F.coalesce(discovery.title_company(t), F.lit("")).alias("company"), role("CEO").alias("ceo"), role("CHRO").alias("chro"))


PATHS = ("/team", "/our-team/people", "/solutions/teams", "/solutions/team/leadership", "/fr-fr/about", "/management-board", "/asset-management", "/press-release/x", "/press-releases", "/webinars/12", "/webinars/all", "/blog/case-study", "/x/case-stud/", "/en-US/a/de-de/b", "/", "/staffing_team", "/in-the-news?p=1", "")
HINTS = ("team", "people", "management", "About")


@query(f"""WITH x AS (SELECT p_partkey AS id, 'https://a.example' || {_sql_pick(PATHS, 'p_partkey')} AS url, lower(split_part({_sql_pick(PATHS, 'p_partkey')}, '?', 1)) AS path FROM part), y AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM x)
SELECT id, len(list_filter(segs, lambda s: starts_with(s, 'management') OR regexp_matches(s, '(^|[-_])(team|people|about)'))) > 0 AS hint, coalesce(segs[1] = 'solutions' AND segs[2] IN ('team', 'teams') AND NOT list_has_any(segs[3:], {list(urls.STRONG)!r}), false) AS skipped,
  list_has_any(segs, {list(url_rules.NEWS_SEGMENTS)!r}) OR len(list_filter(segs, lambda s: {' OR '.join(f"starts_with(s, '{x}')" for x in url_rules.NEWS_STEMS)})) > 0 OR len(list_filter(list_zip(segs[:-2], segs[2:]), lambda x: x[1] IN {_sql_in(url_rules.NEWS_MEDIA)} AND regexp_matches(x[2], '^[0-9]'))) > 0 AS press, regexp_matches(lower(url), '/[a-z][a-z]-[a-z][a-z]/') AS locale, regexp_replace(path, '/[a-z][a-z]-[a-z][a-z]/', '/', 'g') AS plain FROM y""")
def url_hints(spark, d):
    u = F.concat(F.lit("https://a.example"), F.col("p"))
    rows = keyed(spark, d, p=(PATHS, 1))
    return rows.select("id", urls.follows_hint(u, HINTS).alias("hint"), urls.skips_taxonomy(u).alias("skipped"), url_rules.is_news(u).alias("press"), urls.is_locale_url(u).alias("locale"), urls.path_without_locale(u).alias("plain"))


ABOUT = ("We build B2B software as a service on AWS and PostgreSQL.", "A hospital: patient care, medtech & e-commerce", "Banking, finance (fintech) with Google Cloud, HubSpot", "Supply chain of a plant; shop-floor", "Schools and universities", "public sector GovTech, Azure/Snowflake", "", None, "replanted bankers", "Our University uses MySQL; postgres too")


def _named(table) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_sql_any('t', tuple(f' {w} ' for w in words))} THEN '{name}' END" for name, words in table) + "], lambda v: v IS NOT NULL)"


@query(f"SELECT id, array_to_string({_named(urls.INDUSTRIES)}, ',') AS industry, array_to_string({_named(urls.TECHNOLOGIES)}, ',') AS tech FROM (SELECT p_partkey AS id, ' ' || regexp_replace(lower(coalesce({_sql_pick(ABOUT, 'p_partkey')}, '')), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM part)")
def company_words(spark, d):
    t = F.col("t")
    return keyed(spark, d, t=(ABOUT, 1)).select("id", F.array_join(urls.keywords(t, urls.INDUSTRIES), ",").alias("industry"), F.array_join(urls.keywords(t, urls.TECHNOLOGIES), ",").alias("tech"))
