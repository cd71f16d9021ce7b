"""Function tables and edge cases of the lead operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import names, status, urls
from leadlens.operators import extraction, leads, mx, robots, stateful
from leadlens.operators.latest import latest
from leadlens.sources import readers, writers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "string" if v is None or isinstance(v, str) else "int") for k, v in values.items())))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "category, code, catch_all, fallback, want",
    [
        ("accept", None, "not_catch_all", None, "rcpt_2xx_non_catchall"),
        (None, 250, "catch_all", "invalid", "rcpt_2xx_catchall_fallback_invalid"),
        (None, 250, "error", "neutral", "rcpt_2xx_catchall_unconfirmed"),
        ("hard_fail", None, None, "valid", "fallback_valid_overrides_rcpt_5xx"),
        (None, 550, None, None, "rcpt_5xx_user_unknown"),
        ("timed_out", None, "catch_all", None, "catchall_softfail_no_fallback"),
        (None, 451, None, None, "tempfail_or_timeout"),
        (None, None, None, "bounce", "fallback_invalid_no_smtp"),
        (None, None, None, None, "no_verification_attempt"),
        ("strange", None, None, "valid", "no_verification_attempt"),
    ],
)
def test_classify(spark, category, code, catch_all, fallback, want):
    c = status.classify(F.lit(category).cast("string"), F.lit(code).cast("int"), F.lit(catch_all).cast("string"), F.lit(fallback).cast("string"), F.lit(None).cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz"))
    assert spark.range(1).select(c.alias("x")).first()["x"]["verify_reason"] == want


def test_latest_orders_missing_times(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, None, None), (2, 1, t, t), (3, 2, t, t), (4, 2, t, t)], "id int, email_id int, verified_at timestamp_ntz, checked_at timestamp_ntz")
    ids = lambda mode: sorted(r["id"] for r in latest(df, mode).collect())
    assert ids("view") == [1, 4]
    assert ids("api") == [2, 4]
    assert ids("max_id") == [2, 4]
    with pytest.raises(ValueError):
        latest(df, "other")


def test_pages_of_keyset_equal_full_sort(spark):
    df = spark.createDataFrame([(i, [5, 5, None, 9, 0][i % 5]) for i in range(23)], "id int, icp_score int")
    want = [r["id"] for r in df.orderBy(F.coalesce("icp_score", F.lit(-1)).desc(), F.desc("id")).collect()]
    got, after = [], None
    while True:
        page = leads.page(df, 4, after).collect()
        if not page:
            break
        got += [r["id"] for r in page]
        after = (page[-1]["icp_score"] if page[-1]["icp_score"] is not None else -1, page[-1]["id"])
    assert got == want


def test_cursor_round_trip():
    assert leads.decode_cursor(leads.encode_cursor("icp", 7, 3), "icp") == (7, 3)
    for bad in ("", "####", leads.encode_cursor("verified", 1, 1)):
        with pytest.raises(ValueError):
            leads.decode_cursor(bad, "icp")


def test_percentile_is_nearest_rank_with_even_rounding(spark):
    for values, p, want in (([1, 2, 3, 4], 50, 3), ([1, 2], 50, 1), ([7], 95, 7), ([], 50, None)):
        assert spark.range(1).select(mx.percentile(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>"), p).alias("x")).first()["x"] == want


def test_names():
    assert names.split_person("Dr. Anna van der Berg, PhD") == ("Anna", "van der Berg")
    assert names.split_person("王 小明") == ("小明", "王")
    assert names.split_person("") == (None, None)
    assert names.company_key("Acme Widgets, Inc.") == ("Acme Widgets Inc", "acme widgets")
    assert names.company_key("Société Générale S.A.")[1] == "societe generale"
    assert names.company_key(None) == (None, None)


def test_permutations_prefer_and_cap(spark):
    got = one(spark, em.permutations(F.col("f"), F.col("l"), F.lit("flast")), f="Jo", l="Doe")
    assert [x["localpart"] for x in got][:3] == ["jdoe", "jo.doe", "jo_doe"] and len(got) == 6
    assert [x["localpart"] for x in one(spark, em.permutations(F.col("f"), F.col("l")), f="Jo", l=None)] == ["jo"]


def test_emails(spark):
    assert one(spark, em.extract(F.col("t")), t="A@B.com x a@b.com, c@d.org.") == ["a@b.com", "c@d.org"]
    assert one(spark, em.deobfuscate(F.col("t")), t="jo [at] x (dot) com") == "jo@x.com"
    assert one(spark, em.deobfuscate(F.col("t")), t="meet at dot") == "meet at dot"
    assert one(spark, em.role_like(F.col("t")), t="press.office@x.com") is True
    assert one(spark, em.domain_tail(F.col("t")), t="none") == "none"


def test_urls(spark):
    assert one(spark, urls.key(F.col("u")), u="https://www.X.com:80//A//index.html?q=1#t") == "x.com/a"
    assert one(spark, urls.url_class(F.col("u")), u="https://x.com/team") == "people"
    assert one(spark, urls.url_class(F.col("u")), u="https://x.com/blog/team") == "blocked"
    assert one(spark, urls.size_bucket(F.col("u")), u="over 1,000 employees") == "201-1000"
    assert one(spark, urls.size_bucket(F.col("u")), u="200+ staff") == "201-1000"


def test_robots():
    groups = robots.parse("User-agent: a\nUser-agent: abc\nDisallow: /x\n\nUser-agent: *\nAllow: /\nCrawl-delay: z\n")
    assert robots.choose(groups, "ABCbot")["rules"] == [{"allow": False, "path": "/x"}]
    assert robots.choose(groups, "other")["rules"] == [{"allow": True, "path": "/"}]
    assert robots.choose([], "x") is None and robots.parse(None) == []


def test_page_candidates(spark):
    html = "<nav>Jane Roe</nav><h3>Ana Lopez</h3><p>Sales Director</p><a href='mailto:Ana@x.org?subject=1'>mail</a><p>unclosed<li><b>Not A Title Here At All"
    pages = spark.createDataFrame([(1, "https://x.org/team", f"<title>Our team</title>{html}"), (2, "https://x.org/team", None)], "page_id long, url string, html string")
    got = [(r["page_id"], r["email"], r["name"], r["title"], r["kind"]) for r in extraction.candidates(pages).collect()]
    assert got == [(1, "ana@x.org", "Ana Lopez", "Sales Director", "mailto_link")]


def test_export_policy_reasons(spark):
    def why(s, i, r="x", n="x", ind="x"):
        c = [F.lit(s).cast("string"), F.lit(i).cast("int"), F.lit(r), F.lit(n), F.lit(ind)]
        return spark.range(1).select(leads.export_reason(*c).alias("x")).first()["x"]

    assert why(None, 90) == "status_not_allowed"
    assert why("valid", None) == "icp_below_threshold"
    assert why("risky_catch_all", 79) == "icp_below_threshold"
    assert why("valid", 70, r="Intern") == "role_excluded"
    assert why("valid", 70, ind="Education") == "industry_excluded"
    assert why("valid", 70) == "ok"


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿company,domain,extra\nAcme,acme.com,1\n,,\n", encoding="utf-8")
    rows = readers.leads(spark, str(p))
    ok, bad = readers.viable(rows)
    assert ok.count() == 1 and bad.first()["reasons"] == ["missing:domain_or_email"]
    j = tmp_path / "b.jsonl"
    j.write_text('{"company":"B","other":1}\n\n{"domain":"b.io"}\n')
    assert readers.leads(spark, str(j)).count() == 2
    with pytest.raises(ValueError):
        readers.leads(spark, "x.xml")
    writers.leads_csv(spark.createDataFrame([("=1+1", None)], "email string, title string"), str(tmp_path / "o"), ("email", "title"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first()["email"] == "'=1+1"
    d = readers.bounces(spark.createDataFrame([(1, "Final-Recipient: rfc822; A@b.co\nX-Test-Token: t1\nStatus: 5.1.1 user unknown"), (2, None)], "id int, raw string")).orderBy("id").collect()
    assert d[0]["hard"] and d[0]["recipients"] == ["a@b.co"] and d[0]["token"] == "t1" and d[1]["code"] is None


def test_throttle_caps_backoff(spark):
    log = spark.createDataFrame([("h", float(i), i, 429) for i in range(8)] + [("h", 1000.0, 99, 200)], "host string, at double, id int, status int")
    r = stateful.throttle(log).first()
    assert r["strikes"] == 0 and r["next_allowed"] == 1001.0


def test_upsert_and_merge(spark):
    new = spark.createDataFrame([(1, " ", "d.com", None), (2, "N", "d.com", "w"), (3, "Only", None, None), (4, None, "", None)], "id int, name string, domain string, website string")
    got = {r["key"]: (r["name"], r["website"]) for r in stateful.upsert_companies(new).collect()}
    assert got == {"d.com": ("N", "w"), "Only": ("Only", None)}
    a = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    b = spark.createDataFrame([(1, 1, "c"), (2, 4, "d")], "k int, v int, x string")
    assert sorted(r["x"] for r in stateful.append_latest(a, b, ["k"], "v").collect()) == ["b", "c"]
