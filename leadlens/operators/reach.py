"""What of a site is reached from its seeds: links of stored pages, followed by deltas to a bounded depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import url_rules, urls
from leadlens.sources import shared

#: Seeds by tier, each tried where the ones before gave nothing; files that are no pages; links that a page without people is left by.
TIERS = (("/team", "/leadership", "/our-team", "/about/team", "/company/team"), ("/about", "/about-us", "/company", "/people"), ("/contact", "/news", "/"))
FILES = "pdf|jpe?g|png|gif|svg|webp|ico|css|js|zip|mp4|mp3|docx?|xlsx?|pptx?|xml"
DEPTH, EXPANSION = 2, 5


def edges(pages: DataFrame) -> DataFrame:
    """(host, source, target): keys of pages (url, html) and of what they link to on their own site; files, pages behind numbers and links to themselves left out."""
    found = pages.select(F.col("url"), F.explode(urls.links(F.col("html"))).alias("link"))
    to = found.select(urls.host(F.col("url")).alias("host"), urls.key(F.col("url")).alias("source"), urls.absolute(F.col("url"), F.col("link")).alias("to"))
    own = to.where((urls.host(F.col("to")) == F.col("host")) & ~urls.is_pagination(F.col("to")) & ~urls.path(F.col("to")).rlike(rf"\.({FILES})$") & ~urls.skips_taxonomy(F.col("to")))
    return own.select("host", "source", urls.key(F.col("to")).alias("target")).where("source <> target").distinct()


def seeds(hosts: DataFrame, known: DataFrame, tiers: tuple[tuple[str, ...], ...] = TIERS) -> DataFrame:
    """(host, tier, url) of each host's first tier of which a path is known (host, url); hosts without one have none."""
    rows = [(t, k, p) for t, paths in enumerate(tiers) for k, p in enumerate(paths)]
    ranked = F.broadcast(hosts.sparkSession.createDataFrame(rows, "tier int, place int, path string"))  # the tiers, a parameter
    met = hosts.select("host").distinct().join(ranked).withColumn("url", F.concat("host", "path")).join(known.select("host", "url").distinct(), ["host", "url"])
    return met.withColumn("first", F.min("tier").over(Window.partitionBy("host"))).where("tier = first").select("host", "tier", "url")


def reached(start: DataFrame, links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, url, depth) of all that ``start`` (host, url) reaches over ``links`` (host, source, target) in at most ``depth`` steps; the least depth.

    A step joins only what the step before found, and leaves out what is known;
    links and steps are written to the shared folder, so each is worked out once.
    """
    links = shared.table(links)
    new = start.select("host", "url").distinct().withColumn("depth", F.lit(0))
    every = [new]
    for k in range(1, depth + 1):
        known = reduce(DataFrame.union, every).select("host", "url")
        step = new.select("host", F.col("url").alias("source")).join(links, ["host", "source"]).select("host", F.col("target").alias("url")).distinct()
        new = shared.table(step.join(known, ["host", "url"], "left_anti").withColumn("depth", F.lit(k)))
        every.append(new)
    return reduce(DataFrame.union, every)


def expansion(found: DataFrame, most: int = EXPANSION) -> DataFrame:
    """(host, url, score, rank): of the links (host, url) of each host the ``most`` most promising; none that a filter names or whose score is none."""
    url = F.concat(F.lit("https://"), F.col("url"))
    score: Column = urls.nav_score(url)
    own = found.select("host", "url").distinct().where(url_rules.blocked_reason(url).isNull()).withColumn("score", score).where("score > 0")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "url"))).where(F.col("rank") <= most)
