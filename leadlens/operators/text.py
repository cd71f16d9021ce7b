"""Full-text search on token arrays, and the first tier of candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def has_all(text: Column, query: str) -> Column:
    """Every word of the query occurs."""
    words = [w for w in re.split(r"[^\w]+", query.lower()) if w]
    own = tokens(text)
    out = F.lit(bool(words))
    for w in words:
        out = out & F.array_contains(own, w)
    return out


def has_phrase(text: Column, phrase: str) -> Column:
    """The words of the phrase occur one behind the other."""
    words = " ".join(w for w in re.split(r"[^\w]+", phrase.lower()) if w)
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {words} ") if words else F.lit(False)


def web_search(text: Column, query: str) -> Column:
    """The usual box syntax: words (all), "phrases", or, -without."""
    parts = re.findall(r'-?"[^"]*"|\S+', query)
    alternatives: list[Column | None] = [None]
    for part in parts:
        if part.lower() == "or":
            alternatives.append(None)
            continue
        negative, body = part.startswith("-"), part.lstrip("-").strip('"')
        hit = has_phrase(text, body) if part.lstrip("-").startswith('"') else has_all(text, body)
        hit = ~hit if negative else hit
        alternatives[-1] = hit if alternatives[-1] is None else alternatives[-1] & hit
    out = F.lit(False)
    for a in alternatives:
        out = out if a is None else out | a
    return out


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents that hold any word of the query: counts and lengths of all documents."""
    words = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    sized = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [count(w) for w in words]
    flat = sized.select("doc_id", F.size("t").alias("n"), *[c.alias(f"f{k}") for k, c in enumerate(tf)])
    stats = flat.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(words))])
    joined = flat.where(" or ".join(f"f{k} > 0" for k in range(len(words)))).join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for k in range(len(words)):
        f, d = F.col(f"f{k}"), F.col(f"d{k}")
        idf = F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        total = total + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.select("doc_id", total.alias("score"))


def first_tier(candidates: DataFrame) -> DataFrame:
    """Of each company only the candidates of its best tier: with address, with a leading title, with any title, named."""
    lead = F.lower("title").rlike("chief|president|founder|director|head|vp")
    tier = F.when(F.col("email").isNotNull(), 0).when(lead, 1).when(F.col("title").isNotNull(), 2).when(F.col("name").isNotNull(), 3)
    rows = candidates.withColumn("tier", tier).where("tier is not null")
    return rows.withColumn("best", F.min("tier").over(Window.partitionBy("company"))).where("tier = best").drop("best")
