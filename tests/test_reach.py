"""Reach from seeds over links, against a search; tiers and expansion."""

import random

from pyspark.sql import functions as F

from leadlens.operators import reach


def brute_reach(start, links, depth):
    best = dict.fromkeys(start, 0)
    new = set(start)
    for k in range(1, depth + 1):
        new = {(h, t) for h, s, t in links if (h, s) in new} - set(best)
        best |= dict.fromkeys(new, k)
    return sorted((h, u, d) for (h, u), d in best.items())


def test_reach(spark):
    rng = random.Random(2)
    links = sorted({(h, f"p{rng.randrange(30)}", f"p{rng.randrange(30)}") for h in "ab" for _ in range(45)})
    start = [("a", "p1"), ("a", "p2"), ("b", "p3"), ("c", "p1")]
    ls, ss = spark.createDataFrame(links, "host string, source string, target string"), spark.createDataFrame(start + start[:1], "host string, url string")
    for depth in (0, 1, 3):
        assert sorted(map(tuple, reach.reached(ss, ls, depth).collect())) == brute_reach(start, links, depth)


def test_edges_and_tiers(spark):
    html = "<a href='/team/'>t</a><a href='/a.pdf'>f</a><a href='/x?page=2'>n</a><a href='https://other.example/team'>o</a><a href='mailto:a@b.example'>m</a><a href='/'>h</a><a href='/solutions/team'>s</a><a href=\"/About#x\">a</a>"
    pages = spark.createDataFrame([("https://www.a.example/", html), ("https://a.example/team", "<a href='/'>x</a>"), ("https://b.example/", None)], "url string, html string")
    found = reach.edges(pages)
    assert sorted(map(tuple, found.collect())) == [("a.example", "a.example/", "a.example/about"), ("a.example", "a.example/", "a.example/team"), ("a.example", "a.example/team", "a.example/")]
    known = found.select("host", F.col("target").alias("url")).union(spark.createDataFrame([("b.example", "b.example/")], "host string, url string"))
    got = sorted(map(tuple, reach.seeds(known.select("host"), known).collect()))
    assert got == [("a.example", 0, "a.example/team"), ("b.example", 2, "b.example/")]
    more = reach.expansion(known.union(spark.createDataFrame([("a.example", "a.example/docs")], "host string, url string")), 1)
    assert {(r["host"], r["rank"]) for r in more.collect()} == {("a.example", 1), ("b.example", 1)} and "docs" not in {r["url"] for r in more.collect()}
