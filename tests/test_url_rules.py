"""Which pages are sources of people, by rules that name themselves; registrable domains."""

import pytest
from pyspark.sql import functions as F

from leadlens.functions import url_rules
from leadlens.operators import resolve
from leadlens.sources import readers


def told(spark, f, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return {r["p"]: r["x"] for r in df.select("p", f(F.concat(F.lit("https://a.example"), "p")).alias("x")).collect()}


def test_blocked_sources(spark):
    want = {
        "/customer-stories": "blocked_pattern:customer_story", "/customer_story/x": "blocked_pattern:customer_story", "/customers": None, "/customers/acme": "blocked_pattern:customers_detail", "/reviews/": None, "/reviews/1": "blocked_pattern:reviews_detail",
        "/careers/x/team": None, "/careers/x": "blocked_pattern:careers_detail", "/docs": "blocked_pattern:docs", "/docs?x=/team": "blocked_pattern:docs", "/blog/2024/05/x": "blocked_blog_post", "/blog/a/b/new-ceo": None, "/blog/a/b": None, "/blog/a/b/c": "blocked_blog_post", "/Legal/": "blocked_pattern:legal", "/legally": None, "": None, "/": None,
    }
    assert told(spark, url_rules.blocked_reason, want) == want


def test_people_sources(spark):
    want = {"/about": "about", "/about/team": "about", "/our_team": "our_team", "/ourteam/": "our_team", "/news/2024": "news_index", "/blog/author/ann": "blog_author", "/blog/tag/team": "team", "/blog/category/company": "company", "/blog/category/about": "about", "/blog/category/x": None, "/docs/about": None, "/xabout": None}
    assert told(spark, url_rules.people_rule, want) == want


def test_page_filter(spark):
    want = {"/team": (True, "listed"), "/teams-phone": (False, "blocked:products"), "/blog/x": (False, "blocked:content"), "/blog": (False, "no_rule"), "/news/2024-x": (False, "blocked:dated"), "/news/may-2024": (False, "blocked:dated"), "/au/about": (False, "blocked:locale"), "/fr/team": (False, "blocked:locale"), "/Board_of_Directors/": (True, "listed"), "/thought_leadership/x": (False, "blocked:opinions"), "/": (False, "no_rule")}
    assert {k: tuple(v) for k, v in told(spark, url_rules.page_filter, want).items()} == want


def test_news(spark):
    want = {"/case-studies/x": True, "/customer-stories/x": True, "/testimonials": True, "/success-stories": True, "/podcast/12-a": True, "/webinars/all": False, "/press-releases": True, "/press": False, "/team": False, "/in-the-news?p=1": True}
    assert told(spark, url_rules.is_news, want) == want


def test_candidates_by_source(spark):
    rows = [("https://a.example/team", None), ("https://a.example/docs", None), ("https://a.example/x", None), (None, None), ("https://a.example/blog/x", "CTO"), ("https://a.example/blog/x", "Writer")]
    df = spark.createDataFrame(rows, "url string, title string")
    assert [r["url"] for r in url_rules.by_source(df).collect()] == ["https://a.example/team", None]
    assert url_rules.by_source(df, strict=False).count() == 5
    assert [r[0] for r in df.select(url_rules.is_blog_author(F.col("url"), F.col("title"))).collect()] == [False, False, False, False, False, True]


def test_own_rules(spark):
    own = (("shop", url_rules.STEM, ("shop",)), ("cart", url_rules.DETAIL, ("cart",)))
    assert told(spark, lambda u: url_rules.blocked_reason(u, own), ["/shopping", "/cart", "/cart/1", "/docs"]) == {"/shopping": "blocked_pattern:shop", "/cart": None, "/cart/1": "blocked_pattern:cart", "/docs": None}


@pytest.mark.parametrize("listed", [False, True])
def test_registrable(spark, tmp_path, listed):
    want = {
        "blog.acme.co.uk": "acme.co.uk", "acme.co.uk": "acme.co.uk", "co.uk": "co.uk", "a.b.c.com": "c.com", "com": "com", "WWW.Acme.COM.": "acme.com", "host.unknown": "host.unknown", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "x.a.b.kawasaki.jp": "a.b.kawasaki.jp",
        "x.city.kawasaki.jp": "city.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp", "a.www.ck": "www.ck", "www.ck": "www.ck", "a.b.ck": "a.b.ck", "b.ck": "b.ck", "": "", None: None,
    }
    rules = spark.createDataFrame([(r,) for r in resolve.SUFFIX_RULES], "rule string")
    if listed:
        path = tmp_path / "list.dat"
        path.write_text("// comment\n\n" + "\n".join(f"{r}   trailing" for r in resolve.SUFFIX_RULES))
        rules = readers.suffix_rules(spark, f"file://{path}")
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: r["registrable"] for r in resolve.registrable(hosts, rules).collect()} == want
