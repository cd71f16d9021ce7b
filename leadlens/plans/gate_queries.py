"""Queries of the gates: names, titles, addresses and candidates, over strings that reach every rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import gates
from leadlens.plans import tables as T
from leadlens.plans.registry import query

NAMES = (
    "Maria Lopez", " Jean-Luc Picard ", "J. R. Tolkien", "O'Neil Brady", "Ludwig van Beethoven", "Anna de la Cruz", "PCI DSS", "soc 2", "GDPR", "North Bethesda", "east", "New York", "Contact Us", "Engineering",
    "12-34.5", "Agent 47", "me@home", "(  )", "Ana Bea Cat Dan Eva Fay", "Unlock Opportunities", "Jane Doe Jr.", "Dr. Strange", "Lord of Light", "Jo# Smith", "IBM CORP", "MARIA LOPEZ GARCIA", "Al", "Cher", "B. C.", "José Álvarez",
    "", None, "Clari Logo", "Paul Smith Director", "Ann, Lee", "Kim <Lee>", "west virginia hills", "A B", "Lee-Ann St. John", "team",
)
TITLES = (
    "Chief Executive Officer", "CEO & Founder", "Senior Engineer", "", None, "Head of Growth", "VP Sales", "London", "our team", "Built right for you", "See it in action, Director", "watch us in action", "Request a demo", "Book Manager",
    "Unlock new opportunities", "Get started", "General Counsel", "Vice  President,  Legal", "Managing Partner", "Director of " + "very " * 16 + "long things", "Ahead of time", "Co founder", "North star", "Insights Manager", "Chair",
)
EMAILS = ("maria.lopez@a.example", "info@a.example", "John.Doe@a.example", "no-reply@a.example", "", None, "root", "sales+x@a.example", " Press@a.example")
URLS = ("https://a.example/team", "https://a.example/customer-stories/b", "https://a.example/Blog/who", "", None, "https://a.example/reviews/1")
KINDS = ("people_card_linkedin", "body", None, "Profile")


def _pick(values: tuple, key) -> F.Column:
    return F.try_element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: tuple, key: str) -> str:
    held = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{held}])[({key}) % {len(values)} + 1]"


def _sql_in(values: tuple) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _sql_any(text: str, values: tuple) -> str:
    return "(" + " OR ".join(f"contains({text}, '{v}')" for v in values) + ")"


GEO = f"({{0}} IN {_sql_in(gates.GEOGRAPHY + gates.DIRECTIONS)} OR regexp_full_match({{0}}, '(north|south|east|west)\\s+[a-z][a-z\\s''-]+'))"
EDGE = " ,;:|/\\"
NAME_REASON = f"""CASE WHEN coalesce(trim(name), '') = '' THEN 'empty_name' WHEN lower(trim(name)) IN {_sql_in(gates.COMPLIANCE)} THEN 'compliance_term' WHEN {GEO.format('lower(trim(name))')} THEN 'geography_term'
  WHEN lower(trim(name)) IN {_sql_in(gates.NAVIGATION)} THEN 'nav_boilerplate' WHEN regexp_full_match(trim(name), '[0-9.\\s-]+') THEN 'numeric_only' WHEN regexp_matches(name, '[0-9]') THEN 'contains_digits' WHEN contains(name, '@') THEN 'contains_at_sign'
  WHEN len(toks) = 0 THEN 'empty_tokens' WHEN len(core) > 5 THEN 'too_many_tokens'
  WHEN len(list_filter(core, lambda w: lower(trim(w, '.')) IN {_sql_in(gates.NOT_NAMES)})) > 0 THEN 'non_person_token:' || list_transform(list_filter(core, lambda w: lower(trim(w, '.')) IN {_sql_in(gates.NOT_NAMES)}), lambda w: lower(trim(w, '.')))[1]
  WHEN len(core) >= 3 AND len(list_filter(core, lambda w: lower(w) IN {_sql_in(gates.GLUE)})) > 0 THEN 'looks_like_phrase'
  WHEN len(list_filter(core, lambda w: NOT (lower(w) IN {_sql_in(gates.PARTICLES)} OR regexp_full_match(trim(w, '.'), '\\p{{L}}') OR regexp_full_match(w, '[A-Za-z][A-Za-z''.-]*')))) > 0 THEN 'bad_token_chars'
  WHEN upper(trim(name)) = trim(name) AND lower(name) <> name AND len(words) <= 3 AND len(list_filter(words, lambda w: length(w) > 6)) = 0 THEN 'likely_acronym'
  WHEN len(core) = 1 THEN CASE WHEN length(trim(core[1], '.')) < 3 THEN 'single_token_too_short' END
  WHEN len(list_filter(core, lambda w: length(trim(w, '.')) >= 2 AND regexp_full_match(regexp_replace(trim(w, '.'), '[''-]', '', 'g'), '\\p{{L}}+'))) < 2 THEN 'not_enough_name_parts' END"""
TITLE_REASON = f"""CASE WHEN coalesce(trim(title), '') = '' THEN NULL WHEN length(tc) > 80 THEN 'title_too_long' WHEN {GEO.format('lower(tc)')} THEN 'geography_as_title' WHEN lower(tc) IN {_sql_in(gates.NAVIGATION)} THEN 'nav_boilerplate_as_title'
  WHEN {_sql_any('lower(tc)', gates.BLURBS)} THEN 'marketing_buzzword_in_title' WHEN contains(lower(tc), ' in action') AND (lower(tc) LIKE 'see %' OR lower(tc) LIKE 'watch %') THEN 'cta_see_in_action'
  WHEN {' OR '.join(f"lower(tc) LIKE '{c}%'" for c in gates.CALLS)} THEN 'cta_prefix' WHEN contains(lower(tc), 'opportunities') AND contains(lower(tc), 'unlock') THEN 'cta_unlock_opportunities'
  WHEN NOT regexp_matches(lower(tc), '\\b({'|'.join(gates.ROLE_WORDS)})\\b') THEN 'missing_role_keyword' END"""
CANDIDATES_SQL = f"""WITH x AS (SELECT p_partkey AS id, {_sql_pick(NAMES, 'p_partkey')} AS name, {_sql_pick(TITLES, 'p_partkey // 3')} AS title, {_sql_pick(EMAILS, 'p_partkey // 7')} AS email, {_sql_pick(URLS, 'p_partkey // 11')} AS url, {_sql_pick(KINDS, 'p_partkey // 13')} AS kind, p_partkey % 5 = 0 AS approved FROM part),
y AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(trim(coalesce(name, '')), '{EDGE}'), '\\s+', ' ', 'g'), ' '), lambda w: trim(w, '{EDGE}()[]{{}}<>')), lambda w: w <> '') AS toks, regexp_split_to_array(trim(name), '\\s+') AS words, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS tc, lower(trim(split_part(email, '@', 1))) AS local FROM x),
z AS (SELECT *, list_filter(toks, lambda w: lower(trim(w, '.')) NOT IN {_sql_in(gates.SUFFIXES)}) AS core FROM y),
g AS (SELECT *, {NAME_REASON} AS name_reason, {TITLE_REASON} AS title_reason, coalesce(contains(email, '@') AND local IN {_sql_in(gates.ROLE_LOCALS)}, false) AS role_email, coalesce(email, '') <> '' AND local IN {_sql_in(gates.PLACEHOLDER_LOCALS)} AS placeholder, coalesce(name, '') = '' AS unnamed FROM z)
"""


def candidates(spark, d):
    p, k = T.load(spark, d, "part"), F.col("p_partkey")
    part = lambda n: F.floor(k / n)
    return p.select(k.alias("id"), _pick(NAMES, k).alias("name"), _pick(TITLES, part(3)).alias("title"), _pick(EMAILS, part(7)).alias("email"), _pick(URLS, part(11)).alias("url"), _pick(KINDS, part(13)).alias("kind"), (k % 5 == 0).alias("approved"))


@query(CANDIDATES_SQL + "SELECT name, name_reason, count(*) AS n FROM g GROUP BY ALL")
def person_name_gate(spark, d):
    return candidates(spark, d).groupBy("name", gates.person_name_reason(F.col("name")).alias("name_reason")).agg(F.count("*").alias("n"))


@query(CANDIDATES_SQL + f"SELECT title, title_reason, {_sql_any("lower(coalesce(title, ''))", gates.LEADERS)} AS leads, CASE WHEN title_reason IS NULL THEN nullif(title, '') END AS kept, count(*) AS n FROM g GROUP BY ALL")
def title_gate(spark, d):
    t = F.col("title")
    return candidates(spark, d).groupBy("title", gates.title_reason(t).alias("title_reason"), gates.has_leadership_title(t).alias("leads"), gates.clean_title(t).alias("kept")).agg(F.count("*").alias("n"))


@query(CANDIDATES_SQL + """SELECT id, CASE WHEN placeholder THEN 'placeholder_email:' || local WHEN role_email AND unnamed THEN 'role_email_no_name' WHEN role_email AND name_reason IS NOT NULL THEN 'role_email_invalid_name:' || name_reason
  WHEN NOT unnamed AND name_reason IS NOT NULL THEN 'invalid_name:' || name_reason WHEN unnamed AND coalesce(email, '') = '' THEN 'no_name_or_email' END AS reason, CASE WHEN role_email THEN NULL ELSE nullif(email, '') END AS kept_email FROM g""")
def candidate_gate(spark, d):
    return candidates(spark, d).select("id", gates.candidate_reason(F.col("name"), F.col("email")).alias("reason"), gates.clean_email(F.col("email")).alias("kept_email"))


@query(CANDIDATES_SQL + f"""SELECT id, NOT (coalesce(url, '') <> '' AND ({_sql_any('lower(url)', gates.THIRD_PARTY)} OR {_sql_any('lower(url)', gates.BLOGS)} AND NOT {_sql_any("lower(coalesce(title, ''))", gates.LEADERS)}))
  AND (unnamed OR name_reason IS NULL) AND (approved OR coalesce(email, '') <> '' OR (coalesce(title, '') <> '' AND title_reason IS NULL) OR coalesce(contains(lower(kind), 'linkedin') OR contains(lower(kind), 'profile'), false)) AS person FROM g""")
def person_gate(spark, d):
    c = [F.col(x) for x in ("name", "email", "title", "approved", "url", "kind")]
    return candidates(spark, d).select("id", gates.is_person(*c).alias("person"))


LOCALS = tuple(dict.fromkeys(em.ROLE_LOCALS + em.EXPORT_ROLES + em.ROLE_WORDS + gates.ROLE_LOCALS + gates.PLACEHOLDER_LOCALS + ("jane", "press.office", "customer.success", "sales+eu", "noreplyhere", "no-reply+1", "jane+x", "+info", "Team", "in.fo", "newsletter-eu", "infos")))
FLAGS = f"""WITH x AS (SELECT p_partkey AS id, {_sql_pick(LOCALS, 'p_partkey')} || '@a.example' AS email, {_sql_pick(LOCALS, 'p_partkey')} AS local FROM part), y AS (SELECT *, lower(local) AS lo FROM x)
SELECT id, lo IN {_sql_in(em.ROLE_LOCALS)} OR (split_part(lo, '+', 2) <> '' AND split_part(lo, '+', 1) IN {_sql_in(em.ROLE_LOCALS)}) OR lo LIKE 'noreply%' OR lo LIKE 'no-reply%' AS role, replace(split_part(lo, '+', 1), '.', '') IN {_sql_in(em.EXPORT_ROLES)} AS export_role,
  lo IN {_sql_in(em.ROLE_WORDS)} OR list_has_any(regexp_split_to_array(lo, '[^a-z]+'), {list(em.ROLE_WORDS)!r}) AS role_like, lo IN {_sql_in(gates.ROLE_LOCALS)} AS gate_role, lo IN {_sql_in(gates.PLACEHOLDER_LOCALS)} AS placeholder FROM y"""


@query(FLAGS)
def role_addresses(spark, d):
    k, e = F.col("p_partkey"), F.col("email")
    rows = T.load(spark, d, "part").select(k.alias("id"), F.concat(_pick(LOCALS, k), F.lit("@a.example")).alias("email"))
    return rows.select("id", em.is_role_or_placeholder(e).alias("role"), em.is_export_role(e).alias("export_role"), em.role_like(e).alias("role_like"), gates.is_role_email(e).alias("gate_role"), gates.is_placeholder(e).alias("placeholder"))
