"""Which domain belongs to a company: candidates, bonuses, a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.latest import first_by

#: Points of endings, endings that are tried, start values, points of answers; mail hosts that are no company's domain.
ENDING_POINTS = {"com": 10, "io": 6, "co": 5, "ai": 5, "net": 4, "org": 3}
ENDINGS = ("com", "io", "co", "ai", "net", "org")
HINT, GUESS, DNS, HTTP = 70, 25, 25, 25
FREE_MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "proton.me", "protonmail.com", "zoho.com", "yandex.com", "pm.me", "hey.com", "mail.com")


def clean(c: Column) -> Column:
    """A domain without scheme, user, www, port and path; NULL if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://|^//", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[/?#].*$", ""), "^.*@", ""), ":[0-9]+$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"\.+$", ""), F.lit(""))


def valid(domain: Column) -> Column:
    return (F.length(domain) <= 253) & domain.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])$")


def slug(name: Column) -> Column:
    """A company's name without legal form, letters and digits only."""
    low = F.regexp_replace(F.lower(name), r"\b(inc|ltd|llc|llp|plc|gmbh|co|company|corp|corporation|limited|holdings?|group)\b\.?", "")
    return F.regexp_replace(low, "[^a-z0-9]", "")


def candidates(companies: DataFrame) -> DataFrame:
    """(id, domain, base, is_hint): the given domain unless it is a mail host, and the name with each usual ending."""
    hint = companies.select("id", clean(F.col("domain")).alias("domain"), F.lit(HINT).alias("base"), F.lit(True).alias("is_hint")).where(~F.col("domain").isin(*FREE_MAIL))
    guess = companies.select("id", F.explode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(slug(F.col("name")), F.lit("."), e))).alias("domain"), F.lit(GUESS).alias("base"), F.lit(False).alias("is_hint"))
    every = hint.union(guess).where(valid(F.col("domain")))
    return every.groupBy("id", "domain").agg(F.max("base").alias("base"), F.bool_or("is_hint").alias("is_hint"))


def decide(found: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, domain, confidence): the candidate with the most points; probes: domain, dns, http."""
    ending = F.element_at(F.split("domain", r"\."), -1)
    bonus = F.lit(0)
    for e, n in ENDING_POINTS.items():
        bonus = bonus + F.when(ending == e, n).otherwise(0)
    scored = found.join(probes, "domain", "left").withColumn("score", F.col("base") + bonus + F.when(F.coalesce("dns", F.lit(False)), DNS).otherwise(0) + F.when(F.coalesce("http", F.lit(False)), HTTP).otherwise(0))
    best = first_by(scored, ["id"], [F.desc("score"), F.desc("is_hint"), F.desc(ending == "com"), F.desc("domain")])
    return best.select("id", "domain", F.greatest(F.lit(0), F.least(F.lit(100), F.col("score"))).alias("confidence"))


#: Rules of public suffixes, in the list's own notation (*: any label, !: an exception); longer lists are read by ``sources.readers.suffix_rules``.
SUFFIX_RULES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "ai", "app", "dev", "me", "tv", "us", "eu", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "cz", "pt", "ie", "ru",
    "jp", "co.jp", "ac.jp", "ne.jp", "or.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "cn", "com.cn", "in", "co.in", "au", "com.au", "net.au", "org.au", "nz", "co.nz", "ca", "br", "com.br", "mx", "com.mx", "za", "co.za", "kr", "co.kr", "sg", "com.sg", "*.ck", "!www.ck",
)


def rule_table(rules: DataFrame) -> DataFrame:
    """(suffix, labels, rank) of rules (rule: text): how many labels behind a host it makes the suffix, given the suffix it is found by."""
    text = F.lower(F.trim("rule"))
    wild, excepted = text.startswith("*."), text.startswith("!")
    bare = F.regexp_replace(text, r"^(\*\.|!)", "")
    own = rules.where(text.isNotNull() & (text != "")).select(bare.alias("suffix"), (F.size(F.split(bare, r"\.")) + F.when(wild, 1).when(excepted, -1).otherwise(0)).alias("labels"), F.when(excepted, 1).otherwise(0).alias("rank"))
    return own.distinct()


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, registrable) of the distinct hosts: one label and the public suffix, told by the longest rule, exceptions first.

    ``hosts``: host; ``rules``: rule. A host without a rule, or that is itself a
    suffix, stays as it is; so does a null or an empty one. The rules are a list of bounded size.
    """
    host = F.regexp_replace(F.lower("host"), r"\.+$", "")
    own = hosts.select("host").distinct().withColumn("labels", F.split(host, r"\."))
    ends = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, 1000), "."))
    found = own.where("host is not null").select("host", F.size("labels").alias("all"), F.explode(ends).alias("suffix")).join(F.broadcast(rule_table(rules).withColumnRenamed("labels", "depth")), "suffix")
    best = found.where(F.col("depth") <= F.col("all")).groupBy("host").agg(F.max(F.struct("rank", "depth")).alias("best"))
    kept = F.array_join(F.slice("labels", F.size("labels") - F.col("best.depth"), 1000), ".")
    return own.join(best, "host", "left").select("host", F.when(F.col("best").isNotNull() & (F.size("labels") > F.col("best.depth")), kept).otherwise(F.col("host")).alias("registrable"))
