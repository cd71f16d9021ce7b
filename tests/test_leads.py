"""Search requests, cursors, ingest records, generation and gates on small made-up rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadlens.functions import emails, names, urls
from leadlens.operators import infer, ingest, leads, search


def test_request():
    assert leads.request(query=" x ", statuses="valid, ,risky_catch_all", limit="5") == {"query": "x", "statuses": ("valid", "risky_catch_all"), "limit": 5, "sort": "icp_desc"}
    assert leads.request(limit=None)["limit"] == 50
    for bad in ({"limit": "0"}, {"limit": "101"}, {"limit": "x"}, {"sort": "name"}, {"recency_days": "0"}, {"icp_min": "1.5"}):
        with pytest.raises(ValueError):
            leads.request(**bad)


def test_pages_meet_without_gap_or_repeat(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 3 == 0 else i % 4, None if i % 5 < 2 else at + dt.timedelta(hours=i % 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, icp_score int, verified_at timestamp_ntz")
    for sort, key in (("icp", "icp_score"), ("verified", "verified_at")):
        for ascending in (False, True):
            seen, after = [], None
            while True:
                page = leads.page(df, 7, after, sort, ascending).collect()
                seen += [r["id"] for r in page]
                if len(page) < 7:
                    break
                last = page[-1][key]
                after = (-1 if last is None and sort == "icp" and not ascending else last if last is None or sort == "icp" else F.lit(last), page[-1]["id"])
            assert sorted(seen) == list(range(60)), (sort, ascending)


def test_next_cursor():
    rows = [{"id": 3, "icp_score": 7}, {"id": 2, "icp_score": None}]
    assert leads.next_cursor(rows, 2, "icp") is None and leads.next_cursor(rows[:1], 2, "icp") is None
    assert leads.decode_cursor(leads.next_cursor(rows[:1], 1, "icp"), "icp") == (7, 3)


def test_blank_queries_are_errors():
    with pytest.raises(ValueError):
        search.phrase_or_words("  ", [], F.lit(""))


def test_modes():
    assert ingest.modes(None) == ingest.modes("") == ingest.modes(["verify", "everything"]) == ["full"]
    assert ingest.modes("crawl+gen, verify") == ["autodiscovery", "generate", "verify"]
    assert ingest.modes(["genverify", None, "Odd"]) == ["generate", "verify", "odd"]


def test_cap(spark):
    assert ingest.enforce_cap(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        ingest.enforce_cap(spark.range(6), 5)


def test_names_of_many_kinds():
    assert names.split_hard("Ludwig van der Rohe") == ("Ludwig", "van der Rohe") and names.split_hard("Ana de la Cruz") == ("Ana", "de la Cruz")
    assert names.split_hard("王 小明") == ("小明", "王") and names.split_hard("Cher") == ("Cher", "") and names.split_hard("  ") == ("", "")
    assert names.display_name("JEAN-luc", "o'NEIL VAN DER BERG") == ("Jean-Luc", "O'Neil van der Berg")
    assert names.without_affixes("Prof. Dr. Ann Lee, PhD, Esq.") == "Ann Lee"


def test_records(spark):
    rows = [("Acme Widgets, Inc.", "Bücher.Example", None, None, "  maria  de la CRUZ ", "vp, sales", "https://x", None), (None, None, " ", None, None, None, None, "n")]
    out = ingest.normalize(spark.createDataFrame(rows, "company string, domain string, first_name string, last_name string, full_name string, title string, source_url string, notes string")).collect()
    a, b = out
    assert (a["first_name"], a["last_name"], a["norm_domain"], a["company_norm_key"], a["source_url"], a["errors"]) == ("Maria", "de la Cruz", "xn--bcher-kva.example", "acme widgets", "https://x", "[]")
    assert a["title_raw"] == "vp, sales" and a["title_norm"] == "VP, Sales" and a["role"] is None
    assert (b["first_name"], b["last_name"], b["norm_domain"], b["errors"]) == ("", "", None, '["name.empty"]')


def test_pattern_of_a_domain(spark):
    rows = [(f"a{k}.b{k}@x.example", "x.example", f"a{k}", f"b{k}") for k in range(4)] + [("odd@x.example", "x.example", "p", "q"), ("info@x.example", "x.example", "i", "n"), ("one.two@y.example", "y.example", "one", "two")]
    got = infer.domain_pattern(spark.createDataFrame(rows, "email string, email_domain string, first_name string, last_name string")).collect()
    assert [tuple(r) for r in got] == [("x.example", "first.last", 4, 5)]


def test_shapes_and_templates(spark):
    df = spark.createDataFrame([(["jdoe"],), (["j.doe", "x_y"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(emails.shape(F.col("l"))).collect()] == ["{f}{last}", "{first}.{last}", None]


def test_url_hints(spark):
    df = spark.createDataFrame([("https://x.example/our-team/",), ("https://x.example/asset-management",), ("https://x.example/solutions/teams/board",), (None,)], "u string")
    got = df.select(urls.follows_hint(F.col("u"), ("team", "management")), urls.skips_taxonomy(F.col("u")), urls.path_without_locale(F.col("u"))).collect()
    assert [tuple(r) for r in got][:3] == [(True, False, "/our-team/"), (False, False, "/asset-management"), (True, False, "/solutions/teams/board")]
