"""Edge cases of reports, discovery and times to live."""

import datetime as dt

from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import timing
from leadlens.operators import discovery, reports

T0 = dt.datetime(2024, 1, 1)


def test_recompute_runs_with_broken_lists(spark):
    runs = spark.createDataFrame([(1, '["a.x","a.x","none.x"]'), (2, None), (3, "{broken"), (4, '["b.x"]')], "id int, domains string")
    companies = spark.createDataFrame([(10, "a.x"), (11, "b.x")], "id int, domain string")
    people = spark.createDataFrame([(10,), (10,), (None,)], "company_id int")
    emails = spark.createDataFrame([], "company_id int")
    got = {r["id"]: (r["companies"], r["with_people"], r["zero_people"], r["with_emails"], r["people"]) for r in reports.recompute_runs(runs, companies, people, emails).collect()}
    assert got == {1: (1, 1, 0, 0, 2), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0), 4: (1, 0, 1, 0, 0)}


def test_merged_sample_is_bounded_and_ordered(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("item"), (100 - F.col("id")).alias("t"))
    got = {r["k"]: r for r in reports.merge_results(rows, "k", F.lit(1), F.col("item") == 5, "item", ["t", "item"], 3).collect()}
    assert got[0]["sample"] == [98, 96, 94] and got[1]["sample"] == [99, 97, 95]
    assert got[0]["total"] == 50 and not got[0]["flagged"] and got[1]["flagged"]


def test_pages_and_their_number(spark):
    df = spark.range(7)
    rows = reports.offset_page(df, [F.desc("id")], 2, 3).collect()
    assert [r["id"] for r in rows] == [3, 2, 1] and {(r["total"], r["page"], r["total_pages"]) for r in rows} == {(7, 2, 3)}
    assert reports.offset_page(df.limit(0), [F.col("id")], 1, 3).count() == 0


def test_attempts_within_days(spark):
    rows = spark.createDataFrame([(1, T0 + dt.timedelta(days=d)) for d in (0, 3, 7, 20)] + [(2, T0)], "u int, at timestamp_ntz")
    assert {r["u"]: (r["most"], r["blocked"]) for r in reports.attempts_in(rows, "u", "at", 7, 3).collect()} == {1: (3, True), 2: (1, False)}


def test_signature_joins_blanks(spark):
    df = spark.createDataFrame([("Ann  Lee", None), ("Ann Lee", "")], "a string, b string")
    assert {r[0] for r in df.select(reports.signature(F.col("a"), F.col("b"))).collect()} == {"Ann Lee|"}


def test_best_and_latest_rows(spark):
    rows = spark.createDataFrame([(1, "a", "b", T0), (2, "b", None, T0), (3, "c", "a", T0)], "id int, x string, y string, t timestamp_ntz")
    best = {r["v"]: (r["id"], r["rank"]) for r in reports.best_match(rows, [F.col("x"), F.col("y")], "v").collect()}
    assert best == {"a": (1, 0), "b": (2, 0), "c": (3, 0)}
    assert {r["v"]: r["id"] for r in reports.latest_by_any(rows, [F.col("x"), F.col("y")], "v", ["t", "id"]).collect()} == {"a": 3, "b": 2, "c": 3}


def test_expiry_and_freshness(spark):
    rows = spark.createDataFrame([(1, "no-store, max-age=5", None), (2, "Max-Age=5", None), (3, None, T0), (4, None, None)], "id int, control string, expires timestamp_ntz")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    got = {r["id"]: r["x"] for r in rows.select("id", timing.cache_expiry(at, F.col("control"), F.col("expires")).alias("x")).collect()}
    assert got == {1: None, 2: T0 + dt.timedelta(seconds=5), 3: T0, 4: T0 + dt.timedelta(hours=1)}
    fresh = lambda s, minutes: spark.range(1).select(timing.verdict_fresh(F.lit(s).cast("string"), at, F.lit(T0 + dt.timedelta(minutes=minutes)).cast("timestamp_ntz"))).first()[0]
    assert fresh("error", 4) and not fresh("error", 6) and fresh("catch_all", 60) and fresh(None, 60)


def test_mail_hosts_sorted(spark):
    df = spark.createDataFrame([([(20, "B.x."), (10, " "), (10, None), (10, "a.x")],), ([],)], "m array<struct<preference:int,host:string>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(timing.mail_hosts(F.col("m"))).collect()]
    assert sorted(got) == [[], [(10, "a.x"), (20, "b.x")]]


def test_stop_rules(spark):
    log = [("refused", i, 403) for i in range(5)] + [("later", 10, 200)] + [("later", 11 + i, 403) for i in range(5)] + [("open", i, 200) for i in range(9)]
    df = spark.createDataFrame([(h, t, k, s) for k, (h, t, s) in enumerate(log)], "host string, at int, id int, status int")
    n = {r["host"]: r["count"] for r in discovery.read_before_stop(df, 6, 3, 4).groupBy("host").count().collect()}
    assert n == {"refused": 3, "later": 5, "open": 6}


def test_first_matches_take_each_item_once(spark):
    items = spark.createDataFrame([(1, 1, None), (1, 2, "Head of Sales"), (1, 3, "Sales manager"), (2, 4, "Sales manager")], "company_id int, id int, title string")
    got = sorted(tuple(r) for r in discovery.first_matches(items, ["sales", "manager", "data"]).collect())
    assert got == [(1, "data", 1, "low"), (1, "manager", 3, "high"), (1, "sales", 2, "high"), (2, "sales", 4, "high")]


def test_pattern_of_local(spark):
    df = spark.createDataFrame([("ann.lee",), ("alee",), ("leeann",), ("info",), (None,)], "l string")
    got = [r[0] for r in df.select(em.pattern_of(F.col("l"), F.lit("Ann"), F.lit("Lee"))).collect()]
    assert got == ["first.last", "flast", "lastfirst", None, None]
