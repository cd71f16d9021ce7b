"""Queries of ingest and of address generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import names, status
from leadlens.operators import infer, ingest
from leadlens.plans import tables as T
from leadlens.plans.gate_queries import _pick, _sql_in, _sql_pick
from leadlens.plans.lead_queries import TITLE_SQL, over_leads
from leadlens.plans.registry import query

ROLES = T.TITLES + ("-", "N/A", " none ", "vp, sales", "Gardener", None)


def keyed(spark, d, **picked):
    k = F.col("p_partkey")
    return T.load(spark, d, "part").select(k.alias("id"), *[_pick(values, F.floor(k / n)).alias(name) for name, (values, n) in picked.items()])


@query(f"SELECT id, CASE WHEN trim(coalesce(title, '')) = '' OR lower(trim(title)) IN {_sql_in(ingest.NO_ROLE)} THEN 'other' ELSE lower(split_part({TITLE_SQL}, '|', 1)) END AS bucket FROM (SELECT p_partkey AS id, {_sql_pick(ROLES, 'p_partkey')} AS title FROM part)")
def role_buckets(spark, d):
    return keyed(spark, d, title=(ROLES, 1)).select("id", ingest.role_bucket(F.col("title")).alias("bucket"))


HEADINGS = ("BRITTANY BRANDT, CPA", "Certified Public Accountant", "Our Firm", "  mary-ann  o'hara ", "Jo X Li", "John Q. Public Accountant Smith", "Ann", "Kim Lee | Partner", "", None, ",", "Contact Dana White now", "Zoë Brown Green")


@query(f"""WITH x AS (SELECT p_partkey AS id, {_sql_pick(HEADINGS, 'p_partkey')} AS h FROM part), w AS (SELECT id, list_filter(string_split(split_part(trim(regexp_replace(regexp_replace(h, '[^A-Za-z ,]+', ' ', 'g'), ' +', ' ', 'g')), ',', 1), ' '), lambda v: length(v) > 1 AND lower(v) NOT IN {_sql_in(ingest.STOPWORDS)}) AS v FROM x)
SELECT id, CASE WHEN len(v) >= 2 THEN array_to_string(list_transform(v, lambda z: upper(z[1]) || lower(z[2:])), ' ') END AS name FROM w""")
def heading_names(spark, d):
    return keyed(spark, d, h=(HEADINGS, 1)).select("id", ingest.heading_name(F.col("h")).alias("name"))


CREDENTIALED = ("BRITTANY BRANDT, CPA", "John Smith, MBA, CFA", "Jane Doe (PhD)", "CPA", "Ea Nasir", "Peter Pe, pmp", "Mary Mdina", "Kim, ", "Al CISA Bo", "")


@query(f"SELECT id, CASE WHEN c = '' THEN n ELSE c END AS name FROM (SELECT id, n, trim(rtrim(trim(regexp_replace(n, ',?\\s*\\(?\\b({'|'.join(ingest.CREDENTIALS)})\\b\\)?', '', 'gi')), ',')) AS c FROM (SELECT p_partkey AS id, {_sql_pick(CREDENTIALED, 'p_partkey')} AS n FROM part))")
def credentials_stripped(spark, d):
    return keyed(spark, d, n=(CREDENTIALED, 1)).select("id", ingest.without_credentials(F.col("n")).alias("name"))


TIMES = ("2025-11-20T19:45:03Z", "2025-11-20T19:45:03+02:00", "2025-11-20T19:45:03.250-0530", "2025-11-20 19:45:03", "2025-11-20", " 2024-02-29T00:00:00Z ", "2023-02-29T00:00:00Z", "soon", "", None)
PARSED = ("2025-11-20 19:45:03", "2025-11-20 17:45:03", "2025-11-21 01:15:03.25", "2025-11-20 19:45:03", "2025-11-20 00:00:00", "2024-02-29 00:00:00", None, None, None, None)


@query(f"SELECT p_partkey AS id, CAST({_sql_pick(PARSED, 'p_partkey')} AS TIMESTAMP) AS at, strftime(CAST({_sql_pick(PARSED, 'p_partkey')} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS text FROM part")
def iso_times(spark, d):
    at = ingest.parse_iso(F.col("t"))
    return keyed(spark, d, t=(TIMES, 1)).select("id", at.alias("at"), ingest.iso_z(at).alias("text"))


FIRST = ("José", "anne-marie", "O'Neil", "ÅSA", "李", "", None, "info", "Müller")
LAST = ("Álvarez", "van der berg", "de la Cruz", "Smith", "", None, "o’brien", "al-Amin", "Straße", "Ho")
#: A folded name: diacritics off, the sharp s in two letters, what isn't ASCII dropped, lower case.
FOLD = "regexp_replace(regexp_replace(lower(strip_accents(replace(coalesce({0}, ''), 'ß', 'ss'))), '[^ -~]', '', 'g'), '[^a-z0-9]', '', 'g')"


def _bare(name: str) -> str:
    return f"regexp_replace(lower(coalesce({name}, '')), '[^a-z0-9]', '', 'g')"


def _patterns(f: str, g: str) -> str:
    one = {"first.last": f"{f}||'.'||{g}", "first_last": f"{f}||'_'||{g}", "firstlast": f"{f}||{g}", "first": f, "flast": f"{f}[1:1]||{g}", "firstl": f"{f}||{g}[1:1]", "f.last": f"{f}[1:1]||'.'||{g}", "first.l": f"{f}||'.'||{g}[1:1]", "first-last": f"{f}||'-'||{g}", "first_l": f"{f}||'_'||{g}[1:1]", "f_last": f"{f}[1:1]||'_'||{g}", "last": g, "lastfirst": f"{g}||{f}"}
    need = {"first": f"{f} <> ''", "last": f"{g} <> ''"}
    return "[" + ", ".join(f"CASE WHEN {need.get(p, f'{f} <> {chr(39) * 2} AND {g} <> {chr(39) * 2}')} THEN {one[p]} END" for p in em.PATTERNS) + "]"


OLD = "[a||'.'||b, a||'_'||b, a||b, a[1:1]||b, a||b[1:1], a[1:1]||'.'||b, a||'.'||b[1:1], a||'-'||b, b||a, b||'.'||a, b||a[1:1], b[1:1]||a]"
ORDERED = "list_filter(list_transform(list_zip({0}, range(len({0}))), lambda z: CASE WHEN list_position({0}, z[1]) = z[2] + 1 THEN z[1] END), lambda v: v IS NOT NULL)"
CANDIDATES = f"""WITH x AS (SELECT p_partkey AS id, {_sql_pick(FIRST, 'p_partkey')} AS fn, {_sql_pick(LAST, 'p_partkey // 9')} AS ln FROM part),
y AS (SELECT *, {_bare('fn')} AS f, {_bare('ln')} AS g, {FOLD.format('fn')} AS a, {FOLD.format('ln')} AS b FROM x),
p AS (SELECT *, list_filter({_patterns('f', 'g')}, lambda v: v IS NOT NULL) AS own, {OLD} AS old FROM y), q AS (SELECT *, {ORDERED.format('own')}[1:6] AS six FROM p),
r AS (SELECT id, fn, ln, list_filter(list_concat(six, old), lambda v: v <> '' AND v NOT IN {_sql_in(em.ROLE_LOCALS)} AND NOT starts_with(v, 'noreply')) AS v FROM q)
SELECT id, CASE WHEN coalesce(fn, '') || coalesce(ln, '') = '' THEN '' ELSE array_to_string(list_transform(({ORDERED.format('v')})[1:9], lambda z: z || '@x.example'), ',') END AS emails FROM r"""


@query(CANDIDATES)
def candidate_addresses(spark, d):
    rows = keyed(spark, d, fn=(FIRST, 1), ln=(LAST, 9)).repartition("id")  # a small file is one task, whatever its rows cost
    rows = rows.withColumns({"a": names.ascii_fold(F.coalesce("fn", F.lit(""))), "b": names.ascii_fold(F.coalesce("ln", F.lit("")))})
    found = em.candidates(F.col("fn"), F.col("ln"), F.lit(" X.example"), F.col("a"), F.col("b"), cap=9)
    return rows.select("id", F.array_join(found, ",").alias("emails"))


@query(f"""WITH x AS (SELECT p_partkey AS id, {_sql_pick(FIRST, 'p_partkey')} AS fn, {_sql_pick(LAST, 'p_partkey // 9')} AS ln FROM part), y AS (SELECT *, {_bare('fn')} AS f, {_bare('ln')} AS g, {FOLD.format('fn')} AS a, {FOLD.format('ln')} AS b FROM x)
SELECT id, CASE WHEN f <> '' AND g <> '' THEN f[1:1] || '.' || g || '@x.example' ELSE '' END AS by_pattern, CASE WHEN coalesce(fn, '') || coalesce(ln, '') = '' OR b || a[1:1] IN ('', 'info', 'hello') THEN '' ELSE b || a[1:1] || '@x.example' END AS by_template FROM y""")
def candidate_only(spark, d):
    rows = keyed(spark, d, fn=(FIRST, 1), ln=(LAST, 9)).withColumns({"a": names.ascii_fold(F.coalesce("fn", F.lit(""))), "b": names.ascii_fold(F.coalesce("ln", F.lit("")))})
    own = lambda only: F.array_join(em.candidates(F.col("fn"), F.col("ln"), F.lit("x.example"), F.col("a"), F.col("b"), only=only), ",")
    return rows.select("id", own("f.last").alias("by_pattern"), own("{last}{f}").alias("by_template"))


SHAPES = (("jane.doe", "jd"), ("a_b",), ("a-b", "x"), ("jdoe",), ("7abcdef",), ("7ab",), ("7",), ("a.b.c",), ("x.y", "a_b"))
SHAPED = ("{first}.{last}", "{first}_{last}", "{first}-{last}", "{f}{last}", "{first}{last}", "{first}{l}", None, None, "{first}.{last}")


@query(f"SELECT p_partkey AS id, {_sql_pick(SHAPED, 'p_partkey')} AS shape FROM part")
def shape_inference(spark, d):
    rows = keyed(spark, d, s=(tuple(",".join(x) for x in SHAPES), 1))
    return rows.select("id", em.shape(F.split("s", ",")).alias("shape"))


PATTERN = """, x AS (SELECT email_domain, count(*) OVER (PARTITION BY email_domain) AS n, split_part(email, '@', 1) AS lo, lower(first_name) AS f, lower(last_name) AS g FROM l WHERE split_part(email, '@', 1) <> 'info' AND is_published = 1),
  i AS (SELECT email_domain, pattern FROM (SELECT email_domain, pattern, count(*) AS hits, any_value(n) AS n, min(rank) AS rank FROM x, (VALUES ('first.last', 1), ('flast', 5), ('first_last', 2)) v(pattern, rank) WHERE lo = CASE pattern WHEN 'first.last' THEN f || '.' || g WHEN 'flast' THEN f[1:1] || g ELSE f || '_' || g END GROUP BY 1, 2)
    WHERE hits >= 2 AND hits / n >= 0.8 QUALIFY row_number() OVER (PARTITION BY email_domain ORDER BY hits DESC, rank) = 1),
  w AS (SELECT c.id AS company_id, c.domain, coalesce(CASE WHEN c.id % 5 = 0 THEN 'flast' WHEN c.id % 5 = 1 THEN NULL END, CASE WHEN c.id % 4 = 0 THEN 'first_l' END, i.pattern) AS preferred FROM c LEFT JOIN i ON i.email_domain = c.domain)"""


def effective(spark, d):
    c = T.companies(spark, d).withColumn("attrs", F.when(F.col("id") % 5 == 0, '{"email_pattern":"flast"}').when(F.col("id") % 5 == 1, '{"email_pattern":"odd"}'))
    cached = T.companies(spark, d).where("id % 4 in (0, 1)").select(F.upper("domain").alias("domain"), F.when(F.col("id") % 4 == 0, "first_l").otherwise("none").alias("pattern"))
    p, e = T.people(spark, d), T.emails(spark, d).withColumns({"first_name": F.lit("x"), "last_name": F.lit("y")})
    return infer.effective_pattern(c, cached, infer.domain_pattern(infer.examples(e, p)))


@query(over_leads(PATTERN + " SELECT company_id, domain, preferred FROM w"))
def pattern_precedence(spark, d):
    return effective(spark, d)


@query(over_leads(PATTERN + f""", z AS (SELECT p.id AS person_id, w.domain, preferred, {_patterns("lower(first_name)", "lower(last_name)")} AS v FROM p JOIN w USING (company_id)),
  y AS (SELECT person_id, domain, list_filter(CASE WHEN preferred IS NULL THEN v ELSE list_prepend(v[list_position({list(em.PATTERNS)!r}, preferred)], v) END, lambda s: s IS NOT NULL) AS v FROM z), u AS (SELECT person_id, domain, {ORDERED.format('v')}[1:4] AS v FROM y)
  SELECT person_id, unnest(range(len(v)))::INT AS place, unnest(v) || '@' || domain AS email FROM u"""))
def generate_candidates(spark, d):
    return infer.generate(T.people(spark, d), effective(spark, d), 4).select("person_id", "place", "email")


CATEGORIES = ("accept", "reject", "hard_fail", "temp_fail", "block", "none")


@query(f"""WITH x AS (SELECT id, rcpt_code, catch_all, {_sql_pick(CATEGORIES, 'id')} AS category FROM v)
SELECT id, CASE WHEN category = 'accept' OR (category = 'none' AND rcpt_code BETWEEN 200 AND 299) THEN CASE catch_all WHEN 'catch_all' THEN 'risky_catch_all|rcpt_2xx_catchall' WHEN 'not_catch_all' THEN 'valid|rcpt_2xx_accepted' ELSE 'valid|rcpt_2xx_catchall_unconfirmed' END
  WHEN category IN ('reject', 'hard_fail') THEN 'invalid|rcpt_rejected' WHEN category = 'temp_fail' THEN 'temp_fail|temp_fail' WHEN category = 'block' THEN 'unknown|blocked' WHEN rcpt_code BETWEEN 500 AND 599 THEN 'invalid|rcpt_5xx_rejected' WHEN rcpt_code BETWEEN 400 AND 499 THEN 'temp_fail|smtp_temp_error' ELSE 'unknown|unknown' END AS told FROM x""".replace("WITH x", "WITH " + T.CTE["v"] + ", x"))
def sequential_codes(spark, d):
    s = status.sequential_probe(F.col("rcpt_code"), _pick(CATEGORIES, F.col("id")), F.col("catch_all"))
    return T.evidence(spark, d).select("id", F.concat_ws("|", s["status"], s["reason"]).alias("told"))


HINTS = ('{"probing_hostile":true}', '{"probe_hostile":false}', '{"probe_hostile_mx":1}', '{"probing_hostile":false,"probe_hostile":true}', "{}", "x", None, '{"probe_hostile":null}')
HOSTILE = ("true", "false", "true", "false", "false", "false", "false", "false")


@query(f"SELECT p_partkey AS id, CAST({_sql_pick(HOSTILE, 'p_partkey')} AS BOOLEAN) AS hostile FROM part")
def hostile_hints(spark, d):
    return keyed(spark, d, b=(HINTS, 1)).select("id", status.probe_hostile(F.col("b")).alias("hostile"))


PROBES = "SELECT o_orderkey AS id, o_custkey % 50 AS person_id, o_orderkey % 6 AS place, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 6 ORDER BY o_orderkey) AS attempt, ['invalid','temp_fail','invalid','invalid','skipped','valid','risky_catch_all','invalid','invalid','invalid','invalid','invalid','invalid'][(o_orderkey * 7 + o_custkey) % 13 + 1] AS status FROM orders"


@query(f"""WITH x AS ({PROBES}), f AS (SELECT person_id, place, max_by(status, attempt) AS status, max_by('p' || id, attempt) AS email, count(*) AS n FROM x WHERE attempt <= 3 GROUP BY ALL),
s AS (SELECT *, min(CASE WHEN status IN ('valid', 'risky_catch_all') THEN place END) OVER (PARTITION BY person_id) AS stop FROM f), w AS (SELECT * FROM s WHERE stop IS NULL OR place <= stop),
t AS (SELECT person_id, max_by(status, place) AS last, max_by(email, place) AS email, bool_and(status IN ('invalid', 'skipped')) AS none, sum(n)::BIGINT AS n FROM w GROUP BY 1), h AS (SELECT unnest(range(55)) AS person_id)
SELECT person_id, CASE WHEN person_id % 9 = 4 THEN 'no_mx' WHEN last = 'valid' THEN 'valid_found' WHEN last = 'risky_catch_all' THEN 'risky_found' WHEN coalesce(none, false) THEN 'all_invalid' ELSE 'exhausted' END AS outcome,
  CASE WHEN person_id % 9 = 4 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_attempts, CASE WHEN person_id % 9 <> 4 AND last IN ('valid', 'risky_catch_all') THEN email END AS found FROM h LEFT JOIN t USING (person_id)""")
def person_outcomes(spark, d):
    from pyspark.sql.window import Window

    kinds = ("invalid", "temp_fail", "invalid", "invalid", "skipped", "valid", "risky_catch_all", "invalid", "invalid", "invalid", "invalid", "invalid", "invalid")
    o = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("person_id"), (F.col("o_orderkey") % 6).alias("place"), _pick(kinds, F.col("o_orderkey") * 7 + F.col("o_custkey")).alias("status"))
    probes = o.withColumns({"attempt": F.row_number().over(Window.partitionBy("person_id", "place").orderBy("id")), "email": F.concat(F.lit("p"), "id")})
    hosts = spark.range(55).select(F.col("id").alias("person_id"), (F.col("id") % 9 != 4).alias("has_mx"))
    return infer.person_outcome(probes, hosts)


@query()
def ingest_normalized(spark, d):
    """Records of people and companies, some as full names, some with marks and blanks."""
    rows = T.people(spark, d).join(T.companies(spark, d).select(F.col("id").alias("company_id"), F.concat(F.lit(" "), "name", F.lit(",  inc.")).alias("company"), F.concat(F.lit("Bücher-"), "domain").alias("domain")), "company_id")
    half = F.col("id") % 2 == 0
    return ingest.normalize(rows.select("company", "domain", F.lit(None).cast("string").alias("role"), F.when(half, F.upper("first_name")).alias("first_name"), F.when(half, F.lit("van DER berg")).alias("last_name"), "full_name", F.lower("title").alias("title"), "source_url"))
