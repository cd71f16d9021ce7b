"""Queries on texts, addresses, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import names, urls
from leadlens.operators import extraction, lookup, page_tree, resolve, robots, selection, text
from leadlens.plans import tables as T
from leadlens.plans.registry import query
from leadlens.plans.tables import sql

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'the') AND list_contains({TOKENS}, 'idiot')")
def fulltext_all_terms(spark, d):
    return T.load(spark, d, "documents").where(text.has_all(F.col("text"), "the idiot")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' all rights reserved ')")
def fulltext_phrase(spark, d):
    return T.load(spark, d, "documents").where(text.has_phrase(F.col("text"), "All rights reserved")).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t, contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' all rights reserved ') AS ph FROM documents)
  WHERE (list_contains(t, 'the') AND NOT list_contains(t, 'of')) OR (ph AND list_contains(t, 'der'))""")
def websearch_bool(spark, d):
    return T.load(spark, d, "documents").where(text.web_search(F.col("text"), 'the -of OR "all rights reserved" der')).select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'moron')) AS b FROM t),
  s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
  SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM f, s WHERE a > 0 OR b > 0""")
def fulltext_bm25(spark, d):
    return text.bm25(T.load(spark, d, "documents"), "idiot moron").select("doc_id", F.round("score", 6).alias("score"))


MAILS = r"list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'))"


@query(f"SELECT doc_id, unnest({MAILS}) AS email FROM documents")
def email_extract(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.explode(em.extract(F.col("text"))).alias("email"))


@query(f"SELECT split_part(email, '@', 2) AS domain, count(*) AS n, count(DISTINCT email) AS n_distinct FROM (SELECT unnest({MAILS}) AS email FROM documents) GROUP BY 1")
def email_domain_stats(spark, d):
    mails = T.load(spark, d, "documents").select(F.explode(em.extract(F.col("text"))).alias("email"))
    return mails.groupBy(em.domain_split(F.col("email")).alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("email").alias("n_distinct"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(x, '\s*[\[(]\s*at\s*[\])]\s*', '@', 'g'), '\s*[\[(]\s*dot\s*[\])]\s*', '.', 'g') AS email FROM (SELECT doc_id, 'user' || doc_id || ' [at] ' || source || ' (dot) example' AS x FROM documents)""")
def deobfuscate(spark, d):
    written = F.concat(F.lit("user"), "doc_id", F.lit(" [at] "), "source", F.lit(" (dot) example"))
    return T.load(spark, d, "documents").select("doc_id", em.deobfuscate(written).alias("email"))


@query(sql("p e", "SELECT id, split_part(email, '@', 1) = 'info' AS role, split_part(email, '@', 1) = 'info' AS export_role, sha256(lower(trim(email))) AS hash FROM e"))
def role_email_flag(spark, d):
    e = F.col("email")
    return T.emails(spark, d).select("id", em.is_role_or_placeholder(e).alias("role"), em.is_export_role(e).alias("export_role"), em.email_hash(e).alias("hash"))


@query(sql("p e", "SELECT id, CASE WHEN regexp_matches(lo, '^[a-z]{2,}[._-][a-z]{2,}$') THEN upper(lo[1:1]) || split_part(replace(lo, '_', '.'), '.', 1)[2:] || ' ' || upper(split_part(replace(lo, '_', '.'), '.', 2)[1:1]) || split_part(replace(lo, '_', '.'), '.', 2)[2:] END AS name FROM (SELECT id, lower(split_part(email, '@', 1)) AS lo FROM e)"))
def name_from_local(spark, d):
    return T.emails(spark, d).select("id", em.name_from_local(F.col("email")).alias("name"))


@query(r"""SELECT page_id, CASE WHEN host || '' = '' THEN NULL ELSE host END AS host, CASE WHEN path = '' THEN '/' ELSE path END AS path, host || CASE WHEN path = '' THEN '/' ELSE path END AS key FROM (
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/+', '/', 'g'), '/index\.(html?|php|aspx?)$', '/'), '/$', '') AS path FROM pages)""")
def url_normalise(spark, d):
    u = F.col("url")
    return T.load(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.key(u).alias("key"))


@query(r"SELECT CASE WHEN regexp_matches(url, '^https?://blog\.') THEN 'blocked' WHEN regexp_matches(lower(url), '([?&](page|p|offset|start)=[0-9]+)|(/page/[0-9]+)') THEN 'pagination' ELSE 'other' END AS class, count(*) AS n FROM pages GROUP BY 1")
def url_class(spark, d):
    return T.load(spark, d, "pages").groupBy(urls.url_class(F.col("url")).alias("class")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, (CASE WHEN s <= 1 THEN 4 WHEN s <= 2 THEN 2 ELSE -2 END + CASE WHEN contains(url, '?') THEN -2 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '([?&](page|p|offset|start)=[0-9]+)|(/page/[0-9]+)') THEN -5 ELSE 0 END)::INT AS score
  FROM (SELECT page_id, url, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS s FROM pages)""")
def nav_score(spark, d):
    return T.load(spark, d, "pages").select("page_id", urls.nav_score(F.col("url")).alias("score"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(list_distinct(list_filter(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), lambda h: NOT regexp_matches(lower(h), '^(mailto|tel|javascript|data):|^#')))) AS n_links FROM pages""")
def page_links(spark, d):
    h = F.col("html")
    return T.load(spark, d, "pages").select("page_id", urls.title(h).alias("title"), F.size(urls.links(h)).alias("n_links"))


@query(r"""SELECT page_id, (CASE WHEN regexp_matches(url, '^https?://blog\.') THEN -12 ELSE 0 END + CASE WHEN regexp_matches(lower(html), '<h[1-3][^>]*>[^<]*(team|leadership|people|board)') THEN 8 ELSE 0 END + CASE WHEN contains(lower(html), '<article') THEN -4 ELSE 0 END)::INT AS score FROM pages""")
def page_score(spark, d):
    return T.load(spark, d, "pages").select("page_id", urls.page_score(F.col("url"), F.col("html")).alias("score"))


@query(r"""SELECT page_id, (len(regexp_extract_all(lower(html), '<script')) >= 3)::INT + (length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\f\r\v]+', ' ', 'g'))) < 200)::INT + regexp_matches(lower(html), 'id=["''](root|app|__next)["'']')::INT + contains(lower(html), 'enable javascript')::INT >= 2 AS shell,
  regexp_matches(lower(html[1:8192]), '<title[^>]*>[^<]*(404|not found)') OR regexp_matches(lower(html[1:8192]), 'page (could not be|was not|cannot be) found') AS missing FROM pages""")
def page_kind(spark, d):
    u, h = F.col("url"), F.col("html")
    return T.load(spark, d, "pages").select("page_id", urls.spa_shell(h).alias("shell"), urls.soft_404(u, h).alias("missing"))


COMPANY_TEXT = "CASE p_size % 5 WHEN 0 THEN 'A saas firm of ' || p_size || '-' || p_size * 10 || ' employees' WHEN 1 THEN 'Retail, ' || p_size * 20 || '+ staff, on aws and postgres' WHEN 2 THEN 'University with ' || p_size || ',000 people' ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, p_size, {COMPANY_TEXT} AS x FROM part) SELECT p_partkey,
  CASE p_size % 5 WHEN 0 THEN CASE WHEN p_size * 10 <= 10 THEN '1-10' WHEN p_size * 10 <= 50 THEN '11-50' WHEN p_size * 10 <= 200 THEN '51-200' WHEN p_size * 10 <= 1000 THEN '201-1000' ELSE '1001+' END
    WHEN 1 THEN CASE WHEN p_size * 20 + 1 <= 10 THEN '1-10' WHEN p_size * 20 + 1 <= 50 THEN '11-50' WHEN p_size * 20 + 1 <= 200 THEN '51-200' WHEN p_size * 20 + 1 <= 1000 THEN '201-1000' ELSE '1001+' END
    WHEN 2 THEN CASE WHEN p_size * 1000 <= 1000 THEN '201-1000' ELSE '1001+' END END AS size,
  CASE p_size % 5 WHEN 0 THEN 'B2B SaaS' WHEN 1 THEN 'Retail/E-commerce' WHEN 2 THEN 'Education' ELSE '' END AS industry, CASE p_size % 5 WHEN 1 THEN 'AWS,PostgreSQL' ELSE '' END AS tech FROM t""")
def company_enrich(spark, d):
    t = T.load(spark, d, "part").select("p_partkey", F.expr(COMPANY_TEXT).alias("x"))
    x = F.col("x")
    return t.select("p_partkey", urls.size_bucket(x).alias("size"), F.array_join(urls.keywords(x, urls.INDUSTRIES), ",").alias("industry"), F.array_join(urls.keywords(x, urls.TECHNOLOGIES), ",").alias("tech"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/7\n\nUser-agent: leadbot\nCrawl-delay: 2\nDisallow: /fr\nAllow: /fr/8\n"


@query(r"""SELECT url, NOT regexp_matches(p, '^/fr') OR regexp_matches(p, '^/fr/8') AS allowed, CASE WHEN regexp_matches(p, '^/fr/8') THEN '/fr/8' WHEN regexp_matches(p, '^/fr') THEN '/fr' END AS rule FROM (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)""")
def robots_eval(spark, d):
    pages = T.load(spark, d, "pages").select("url").distinct()
    files = pages.select(urls.host(F.col("url")).alias("host")).distinct().withColumn("robots", F.lit(ROBOTS))
    return robots.evaluate(pages, robots.rules(files, "LeadBot/1.0"))


@query(r"""WITH l AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS host, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS link FROM pages)
  SELECT DISTINCT host, host || CASE WHEN lower(x) = '' THEN '/' ELSE x END AS url FROM (SELECT host, regexp_replace(regexp_replace(lower(regexp_extract(link, '^([^?#]*)', 1)), '/+', '/', 'g'), '/$', '') AS x, link FROM l WHERE link LIKE '/%' AND link NOT LIKE '//%')
  WHERE NOT regexp_matches(lower(link), '([?&](page|p|offset|start)=[0-9]+)|(/page/[0-9]+)')
  AND host || CASE WHEN x = '' THEN '/' ELSE x END NOT IN (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') || CASE WHEN p = '' THEN '/' ELSE p END FROM (SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/+', '/', 'g'), '/$', '') AS p FROM pages))""")
def crawl_frontier(spark, d):
    pages = T.load(spark, d, "pages")
    return robots.frontier(pages.select("url", "html"), pages.select("url"))


@query()
def extract_candidates(spark, d):
    return extraction.candidates(T.load(spark, d, "pages"))


def people_pages(spark, d):
    """Synthetic team pages, one a company: a card and an address for each of its people."""
    p = T.people(spark, d).where("company_id is not null")
    card = F.concat(F.lit("<li><h3>"), "full_name", F.lit("</h3><p>"), "title", F.lit("</p><a href='mailto:"), F.lower("first_name"), F.lit("."), F.lower("last_name"), F.lit("@s"), "company_id", F.lit(".example'>Write</a></li>"))
    return p.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", card.alias("c")))), lambda x: x["c"]), "").alias("c")).select(F.col("company_id").alias("page_id"), F.concat(F.lit("https://s"), "company_id", F.lit(".example/team")).alias("url"), F.concat(F.lit("<html><body><script>var x = '<p>';</script><ul>"), "c", F.lit("</ul></body></html>")).alias("html"))


@query(sql("p", "SELECT DISTINCT company_id AS page_id, lower(first_name) || '.' || lower(last_name) || '@s' || company_id || '.example' AS email FROM p WHERE company_id IS NOT NULL"))
def people_page_emails(spark, d):
    return extraction.addresses(page_tree.trees(people_pages(spark, d))).select("page_id", "email")


@query()
def prefilter_candidates(spark, d):
    found = extraction.candidates(people_pages(spark, d))
    return selection.prefilter(found.withColumns({"company": F.col("page_id"), "url": F.lit("/team")})).select("company", "name", "email", "title")


@query(sql("p", """, c AS (SELECT company_id AS company, full_name AS name, CASE WHEN id % 3 = 0 AND company_id % 2 = 0 THEN 'x' END AS email, nullif(title, '') AS title FROM p WHERE company_id IS NOT NULL),
  t AS (SELECT *, CASE WHEN email IS NOT NULL THEN 0 WHEN regexp_matches(lower(title), 'chief|president|founder|director|head|vp') THEN 1 WHEN title IS NOT NULL THEN 2 ELSE 3 END AS tier FROM c)
  SELECT company, tier, count(*) AS n FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.company = t.company) GROUP BY ALL"""))
def prefilter_tiers(spark, d):
    p = T.people(spark, d).where("company_id is not null")
    rows = p.select(F.col("company_id").alias("company"), F.col("full_name").alias("name"), F.when((F.col("id") % 3 == 0) & (F.col("company_id") % 2 == 0), "x").alias("email"), F.nullif("title", F.lit("")).alias("title"))
    return text.first_tier(rows).groupBy("company", "tier").agg(F.count("*").alias("n"))


@query(sql("c", """, h AS (SELECT id, domain, 70 AS base, true AS is_hint FROM c UNION ALL SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || '.' || unnest(['com','io','co','ai','net','org']), 25, false FROM c),
  s AS (SELECT id, domain, is_hint, base + CASE split_part(domain, '.', -1) WHEN 'com' THEN 10 WHEN 'io' THEN 6 WHEN 'co' THEN 5 WHEN 'ai' THEN 5 WHEN 'net' THEN 4 WHEN 'org' THEN 3 ELSE 0 END + CASE WHEN id % 3 = 0 AND domain LIKE '%.com' THEN 50 ELSE 0 END AS score FROM h)
  SELECT id, domain, least(100, greatest(0, score))::INT AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, is_hint DESC, domain LIKE '%.com' DESC, domain DESC) = 1"""))
def domain_decide(spark, d):
    c = T.companies(spark, d)
    found = resolve.candidates(c)
    up = found.where((F.col("id") % 3 == 0) & F.col("domain").endswith(".com")).select("domain", F.lit(True).alias("dns"), F.lit(True).alias("http")).distinct()
    return resolve.decide(found, up)


@query()
def norm_company(spark, d):
    form = F.element_at(F.array(*map(F.lit, (", Inc.", " GmbH", " S.A.", " LLC", ""))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    c = names.norm_company(F.concat("s_name", form))
    return T.load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), c["display"].alias("display"), c["key"].alias("key"))


@query()
def fuzzy_company(spark, d):
    return lookup.lookup(spark.createDataFrame([("a", "Supplier 000000007 Inc")], "query string, name string"), T.companies(spark, d), 5).select("id", "name", "similarity")


@query()
def norm_person(spark, d):
    p = T.people(spark, d)
    s = names.split_name(names.norm_person(F.concat(F.lit("dr. "), F.upper("full_name"), F.lit(" jr."))))
    return p.select("id", s["first"].alias("first"), s["last"].alias("last"), names.norm_title(F.lower("title")).alias("title"))
