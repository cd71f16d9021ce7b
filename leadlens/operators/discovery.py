"""Search items to people, crawl logs to what a crawl would have read, outcomes of manual candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_matches(items: DataFrame, roles: list[str]) -> DataFrame:
    """Per company and role: the first item (company_id, id, title) whose title holds the role ('high'), else the first without a title ('low').

    An item that serves several roles stays with the first of them. Aggregates
    only: each (company, role) keeps one row on the way to the shuffle.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    wanted = F.transform(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(r).alias("role")) for k, r in enumerate(roles)]), lambda r: F.struct(r["place"].alias("place"), r["role"].alias("role"), F.when(title.contains(r["role"]), 0).when(title == "", 1).alias("rank")))
    found = items.select("company_id", "id", F.explode(F.filter(wanted, lambda r: r["rank"].isNotNull())).alias("r")).select("company_id", "id", "r.*")
    best = found.groupBy("company_id", "place", "role").agg(F.min(F.struct("rank", "id")).alias("x")).select("company_id", "place", "role", "x.*")
    once = best.groupBy("company_id", "id").agg(F.min(F.struct("place", "role", "rank")).alias("x"))
    return once.select("company_id", "x.role", "id", F.when(F.col("x.rank") == 0, "high").otherwise("low").alias("confidence"))


def read_before_stop(log: DataFrame, budget: int, refused_at_first: int, refused_most: int) -> DataFrame:
    """Rows of a fetch log (host, at, id, status) that a crawl with stop rules would have reached.

    A host's crawl stops at its page budget, when its first pages all were
    refused (403), or at a number of refusals.
    """
    w = Window.partitionBy("host").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumns({"__n": F.count("*").over(w), "__no": F.coalesce(F.sum(F.when(F.col("status") == 403, 1).otherwise(0)).over(w), F.lit(0))})
    hopeless = (F.col("__n") >= refused_at_first) & (F.col("__n") == F.col("__no"))
    # a stop holds for all that follows: once any rule was met before, later rows are out as well
    met = (F.col("__n") >= budget) | hopeless | (F.col("__no") >= refused_most)
    stopped = F.max(met).over(Window.partitionBy("host").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("__stop", stopped).where(~F.col("__stop")).drop("__n", "__no", "__stop")


def missing(decisions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Decisions (company_id, domain, ...) without a resolution of the same company and domain."""
    return decisions.join(resolutions.select("company_id", "domain"), ["company_id", "domain"], "left_anti")


def manual_outcome():
    """Outcome of a manual candidate from domain, verify_status and no_mx."""
    blank = F.coalesce(F.trim("domain"), F.lit("")) == ""
    return F.when(blank, "error").when(F.col("verify_status").isin("valid", "risky_catch_all"), "verified").when(F.coalesce("no_mx", F.lit(False)), "no_mx").otherwise("invalid")


#: Words of a profile's address that aren't names; endings of domains left out of keywords; spellings of roles.
NOT_NAMES = ("ceo", "cfo", "coo", "cto", "cio", "chro", "cmo", "president", "founder", "cofounder", "co", "director", "vp", "svp", "evp", "chief", "officer", "executive", "managing", "partner", "chairman", "mba", "phd", "cpa", "mpa", "jd", "md", "pmp", "cfa", "cfp", "sphr", "shrm", "cissp", "inc", "llc", "ltd")
ROLE_SPELLINGS = {"CEO": ("ceo", "chief executive officer", "chief executive"), "CFO": ("cfo", "chief financial officer", "chief finance officer"), "COO": ("coo", "chief operating officer", "chief operations officer"), "CTO": ("cto", "chief technology officer", "chief technical officer"), "CIO": ("cio", "chief information officer"), "CHRO": ("chro", "chief human resources officer", "chief people officer", "chief hr officer"), "CMO": ("cmo", "chief marketing officer")}
DASH = r"\s*[–—-]\s*"


def profile_name(url: Column) -> Column:
    """struct(first, last) out of a profile's address; trailing ids and words that aren't names are left off; NULL below two parts."""
    slug = F.lower(F.try_url_decode(F.nullif(F.regexp_extract(url, r"linkedin\.com/in/([^/?#]+)", 1), F.lit(""))))
    bare = F.regexp_replace(slug, r"(-[0-9a-f]{4,})+$", "")
    word = "|".join(NOT_NAMES)
    bare = F.regexp_replace(F.regexp_replace(bare, rf"(-({word}))+$", ""), rf"^(({word})-)+", "")
    parts = F.split(bare, "-")
    return F.when(F.size(parts) >= 2, F.struct(F.initcap(parts[0]).alias("first"), F.initcap(parts[1]).alias("last")))


def _pieces(title: Column) -> Column:
    """A result title's parts between dashes, without the site's name."""
    return F.split(F.regexp_replace(title, r"(?i)\s*[|–—-]\s*LinkedIn.*$", ""), DASH)


def title_name(title: Column) -> Column:
    """struct(first, last) of a result title's first part; NULL below two words, or if one of them is none."""
    words = F.filter(F.split(_pieces(title)[0], r"\s+"), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    return F.when((F.size(words) >= 2) & ~F.lower(first).isin(*NOT_NAMES) & ~F.lower(last).isin(*NOT_NAMES), F.struct(first.alias("first"), last.alias("last")))


def title_company(title: Column) -> Column:
    """The company of a result title: the last of three parts, or what follows "at" in the last of two; else blank."""
    parts = _pieces(title)
    last = F.trim(F.element_at(parts, -1))
    return F.lower(F.when(F.size(parts) >= 3, last).when(F.size(parts) == 2, F.trim(F.regexp_extract(last, r"(?i)\bat\s+(.+)$", 1))).otherwise(""))


def matches_role(title: Column, snippet: Column, role: str) -> Column:
    """A spelling of the role stands in the title's role part, or (without one) anywhere in title and snippet."""
    parts = _pieces(title)
    two = F.regexp_replace(F.trim(F.element_at(parts, -1)), r"(?i)^(.+?)\s+at\s+.*$", "$1")
    told = F.lower(F.trim(F.when(F.size(parts) >= 3, parts[1]).when(F.size(parts) == 2, two).otherwise("")))
    text = F.when(told != "", told).otherwise(F.lower(F.concat_ws(" ", title, snippet)))
    out = F.lit(False)
    for spelling in ROLE_SPELLINGS.get(role.upper(), (role.lower(),)):
        out = out | text.contains(spelling)
    return out
