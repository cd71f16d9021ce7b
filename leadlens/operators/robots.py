"""Crawling rules: robots groups, the longest matching rule, crawl frontiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.functions import urls
from leadlens.operators.latest import first_by


def parse(text: str | None) -> list[dict]:
    """Groups of a robots file: agents, rules (allow, path), crawl delay. Lines that aren't understood are skipped."""
    groups: list[dict] = []
    open_agents = False
    for line in (text or "").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_agents:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            open_agents = True
            continue
        if key in ("allow", "disallow") and groups:
            open_agents = False
            if value:
                groups[-1]["rules"].append({"allow": key == "allow", "path": value})
        elif key == "crawl-delay" and groups:
            open_agents = False
            try:
                groups[-1]["delay"] = float(value)
            except ValueError:
                pass
    return groups


def choose(groups: list[dict], agent: str) -> dict | None:
    """The group whose agent name is the longest part of ours, else the first for all."""
    agent = agent.lower()
    best = max(((len(a), -k) for k, g in enumerate(groups) for a in g["agents"] if a != "*" and a and a in agent), default=None)
    if best:
        return groups[-best[1]]
    return next((g for g in groups if "*" in g["agents"]), None)


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, path, delay) of the group that holds for ``agent``; files: host, robots."""

    @F.pandas_udf("array<struct<allow:boolean,path:string,delay:double>>")
    def read(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            g = choose(parse(text), agent)
            return [{**r, "delay": g["delay"]} for r in g["rules"]] if g else []

        return s.map(one)

    return files.select("host", F.explode(read(F.col("robots"))).alias("r")).select("host", "r.*")


def evaluate(pages: DataFrame, own: DataFrame) -> DataFrame:
    """pages (url) with allowed and the rule that decides: the longest prefix of the path, allow before disallow on ties; no rule allows."""
    keyed = pages.withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    r = own.select("host", F.col("allow"), F.col("path").alias("rule"))
    hit = keyed.join(r, "host").where(F.col("path").startswith(F.col("rule")))
    best = first_by(hit, ["url"], [F.desc(F.length("rule")), F.desc("allow"), "rule"]).select("url", "allow", "rule")
    return keyed.join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"), "rule")


def frontier(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """(host, url) of links on pages that stay on the site, are no pagination, and haven't been seen; each once."""
    found = pages.select("url", F.explode(urls.links(F.col("html"))).alias("link")).select(urls.host(F.col("url")).alias("host"), urls.absolute(F.col("url"), F.col("link")).alias("to"))
    same = found.where((urls.host(F.col("to")) == F.col("host")) & ~urls.is_pagination(F.col("to"))).select("host", urls.key(F.col("to")).alias("url")).distinct()
    return same.join(seen.select(urls.key(F.col("url")).alias("url")), "url", "left_anti").select("host", "url")
