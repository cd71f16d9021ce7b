"""Queries on quotas, throttles, lifecycles and upserts, and the streaming forms run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import status
from leadlens.operators import stateful
from leadlens.plans import tables as T
from leadlens.plans.registry import query
from leadlens.plans.tables import sql
from leadlens.streaming import windows

K = "CAST(json_extract_string(props, '$.k') AS INT)"


def usage(spark, d):
    return T.load(spark, d, "events").withColumn("k", F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k")))


@query(f"SELECT event_id, user_id, CAST(sum({K}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events")
def rolling_quota(spark, d):
    return stateful.rolling_usage(usage(spark, d), F.col("k")).select("event_id", "user_id", "used")


@query("""WITH i AS (SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
  q AS (SELECT c_custkey AS user_id, c_custkey % 7 AS remaining FROM customer WHERE c_custkey % 2 = 0)
  SELECT i.user_id, id FROM i LEFT JOIN q USING (user_id) WHERE position <= least(5, coalesce(remaining, 5))""")
def quota_trim(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    items = T.load(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("position"))
    left = T.load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7).alias("remaining"))
    return stateful.trim_to_quota(items, left, 5).select("user_id", "id")


THROTTLE = """WITH l AS (SELECT 'h' || (user_id % 12) AS host, event_id AS id, floor(epoch(ts)) AS t, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 500 ELSE 200 END AS status FROM events),
  g AS (SELECT host, count(*) AS n, list_sort(list({'t': t, 'id': id, 'status': status, 'next': 0.0::DOUBLE, 'strikes': 0})) AS s FROM l GROUP BY host),
  f AS (SELECT host, n, list_reduce(list_prepend({'t': 0.0::DOUBLE, 'id': 0::BIGINT, 'status': 0, 'next': 0.0::DOUBLE, 'strikes': 0}, s), lambda a, x: {'t': x.t, 'id': x.id, 'status': x.status,
    'next': greatest(a.next, x.t) + CASE WHEN x.status IN (403, 429) THEN least(60.0, 3.0 * pow(2.0, least(a.strikes + 1, 30))) ELSE 1.0 END,
    'strikes': CASE WHEN x.status IN (403, 429) THEN a.strikes + 1 WHEN x.status BETWEEN 200 AND 299 THEN 0 ELSE a.strikes END}) AS r FROM g)
  SELECT host, n, r.strikes AS strikes, r.next AS next_allowed FROM f"""


@query(THROTTLE)
def throttle_fold(spark, d):
    e = T.load(spark, d, "events")
    code = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 500).otherwise(200)
    log = e.select(F.concat(F.lit("h"), F.col("user_id") % 12).alias("host"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), code.alias("status"))
    return stateful.throttle(log)


@query("""WITH e AS (SELECT user_id AS token, ts, CASE WHEN event_type = 'signup' THEN 'requested' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'bounce' WHEN event_type = 'purchase' THEN 'sent' ELSE 'other' END AS kind, CASE WHEN user_id % 2 = 0 THEN '5.1.1' ELSE '4.2.2' END AS code FROM events),
  g AS (SELECT token, max(CASE WHEN kind = 'sent' THEN ts END) AS sent_at, bool_or(kind = 'bounce' AND code = '5.1.1') AS hard, bool_or(kind = 'bounce') AS b FROM e GROUP BY token)
  SELECT token, CASE WHEN hard THEN 'bounce_hard' WHEN b THEN 'bounce_soft' WHEN sent_at IS NULL THEN 'pending' WHEN sent_at < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 24 HOUR THEN 'delivered_assumed' ELSE 'sent' END AS state FROM g""")
def test_send_lifecycle(spark, d):
    t, u = F.col("event_type"), F.col("user_id")
    kind = F.when(t == "signup", "requested").when((t == "error") & (u % 3 == 0), "bounce").when(t == "purchase", "sent").otherwise("other")
    e = T.load(spark, d, "events").select(u.alias("token"), "ts", kind.alias("kind"), F.when(u % 2 == 0, "5.1.1").otherwise("4.2.2").alias("code"), F.lit(None).cast("string").alias("reason"))
    return stateful.test_sends(e, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))


DSN = "CASE doc_id % 4 WHEN 0 THEN 'Status: 5.1.1 user unknown' WHEN 1 THEN 'Diagnostic 4.2.2 mailbox full' WHEN 2 THEN 'rejected 5.7.1 by policy' ELSE 'ok' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '5.1.1' WHEN 1 THEN '4.2.2' WHEN 2 THEN '5.7.1' END AS code, CASE doc_id % 4 WHEN 0 THEN 'user_unknown' WHEN 1 THEN 'mailbox_full' WHEN 2 THEN 'policy_block' END AS reason, doc_id % 4 = 0 AS hard FROM documents")
def dsn_parse(spark, d):
    raw = F.expr(DSN)
    return T.load(spark, d, "documents").select("doc_id", status.dsn_code(raw).alias("code"), status.dsn_reason(raw).alias("reason"), status.hard_bounce(status.dsn_code(raw), status.dsn_reason(raw)).alias("hard"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'C' || o_custkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'c' || o_custkey || '.example' END AS domain, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS website FROM orders),
  k AS (SELECT *, coalesce(nullif(trim(domain), ''), nullif(trim(name), '')) AS key FROM r)
  SELECT key, min(id) AS id, arg_min(name, id) FILTER (coalesce(trim(name), '') <> '') AS name, arg_min(domain, id) FILTER (coalesce(trim(domain), '') <> '') AS domain, arg_min(website, id) FILTER (coalesce(trim(website), '') <> '') AS website FROM k WHERE key IS NOT NULL GROUP BY key""")
def company_upsert(spark, d):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = T.load(spark, d, "orders").select(i.alias("id"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("C"), c)).alias("name"), F.when(i % 2 != 0, F.concat(F.lit("c"), c, F.lit(".example"))).alias("domain"), F.when(i % 5 == 0, F.col("o_orderpriority")).alias("website"))
    return stateful.upsert_companies(rows)


@query("WITH r AS (SELECT conv_id AS email, role AS name, text AS snippet, conv_id * 1000 + turn AS id FROM conversations) SELECT email, name, id FROM r QUALIFY row_number() OVER (PARTITION BY email, name ORDER BY length(snippet) DESC, id) = 1")
def dedup_richer(spark, d):
    rows = T.load(spark, d, "conversations").select(F.col("conv_id").alias("email"), F.col("role").alias("name"), F.col("text").alias("snippet"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return stateful.richer(rows).select("email", "name", "id")


@query("""WITH s AS (SELECT user_id % 20 AS key, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS b FROM events), m AS (SELECT key, a AS t, 1 AS d FROM s UNION ALL SELECT key, b, -1 FROM s)
  SELECT key, CAST(max(o) AS BIGINT) AS most FROM (SELECT key, sum(d) OVER (PARTITION BY key ORDER BY t, d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM (SELECT key, t, d FROM m) x) GROUP BY key""".replace("ORDER BY t, d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
def concurrency_peak(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = T.load(spark, d, "events").select((F.col("user_id") % 20).alias("key"), us.alias("start"), (us + F.floor("value") * 1_000_000).alias("stop"))
    return stateful.concurrency(spans)


@query("SELECT o.o_orderkey AS run_id, coalesce(n, 0) AS n_done, o.o_orderkey % 5 AS total, coalesce(n, 0) >= o.o_orderkey % 5 AS complete FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) x ON x.l_orderkey = o.o_orderkey")
def run_completion(spark, d):
    done = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("company_id"))
    totals = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("total"))
    return stateful.completed_runs(done, totals)


@query(sql("v vr", "SELECT count(*) FILTER (verified_at < TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY) AS stale, count(*) FILTER (verified_at >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY) AS fresh, count(*) FILTER (verified_at IS NULL) AS never FROM v"))
def stale_results(spark, d):
    old = F.col("verified_at") < T.now() - F.expr("INTERVAL '90' DAY")
    return T.evidence(spark, d).agg(F.count_if(old).alias("stale"), F.count_if(~old).alias("fresh"), F.count_if(F.col("verified_at").isNull()).alias("never"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return windows.run_to_end(spark, d, windows.tumbling)


@query("SELECT user_id, w AS start, count(*) AS n, sum(k)::BIGINT AS used FROM (SELECT user_id, " + K + " AS k, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR]) AS w FROM events) GROUP BY ALL")
def stream_quota(spark, d):
    return windows.run_to_end(spark, d, windows.sliding_quota)


@query(sql("v", """, s AS (SELECT mx_host, count(*) AS n, list_transform(list_sort(list({'t': checked_at, 'i': id, 'ms': elapsed_ms})), lambda x: x.ms::DOUBLE) AS ms FROM v GROUP BY mx_host)
  SELECT mx_host, n, round(list_reduce(list_prepend(0.0::DOUBLE, ms), lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * a END), 6) AS average FROM s"""))
def stream_mx_state(spark, d):
    return windows.run_to_end(spark, d, windows.mx_state)
