"""Address patterns of a domain, generation of candidates, and probing of them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.functions import emails as em
from leadlens.functions import names
from leadlens.operators.latest import first_by

#: Least hits and least share of a domain's examples that follow a pattern.
LEAST_HITS, LEAST_SHARE = 2, 0.80


def domain_pattern(examples: DataFrame) -> DataFrame:
    """(email_domain, pattern, hits, n): the pattern that most of a domain's example addresses follow, if enough do.

    examples: email, email_domain, first_name, last_name; role addresses don't count. One
    aggregate: the hits of every pattern and the number of examples a domain.
    """
    fn, ln = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "").alias(c) for c in ("first_name", "last_name"))
    own = examples.select("email_domain", em.local(F.col("email")).alias("local"), fn, ln).where(~F.col("local").isin(*em.INFERENCE_ROLES))
    hits = [F.count_if(em.localpart(p, F.col("first_name"), F.col("last_name")) == F.col("local")) for p in em.PATTERNS]
    counted = own.groupBy("email_domain").agg(F.count("*").alias("n"), F.array(*hits).alias("hits"))
    # the most hits; of equal ones the pattern that comes first
    best = counted.withColumn("most", F.array_max("hits")).where((F.col("most") >= LEAST_HITS) & (F.col("most") / F.col("n") >= LEAST_SHARE))
    every = F.array(*map(F.lit, em.PATTERNS))
    return best.select("email_domain", F.element_at(every, F.array_position("hits", F.col("most")).cast("int")).alias("pattern"), F.col("most").alias("hits"), "n")


def examples(emails: DataFrame, people: DataFrame) -> DataFrame:
    """Published addresses with their person's name; for domains without any, with the names stored beside the address.

    emails: email, person_id, is_published, first_name, last_name; people: id, first_name, last_name.
    """
    rows = emails.where("is_published = 1").withColumn("email_domain", em.domain_tail(F.col("email"))).where(F.col("email").contains("@"))
    whole = (F.coalesce("first_name", F.lit("")) != "") & (F.coalesce("last_name", F.lit("")) != "") & ~em.local(F.col("email")).isin(*em.INFERENCE_ROLES)
    named = people.select(F.col("id").alias("person_id"), "first_name", "last_name")
    joined = rows.drop("first_name", "last_name").join(named, "person_id").where(whole).select("email", "email_domain", "first_name", "last_name")
    beside = rows.where(whole).select("email", "email_domain", "first_name", "last_name").join(joined.select("email_domain").distinct(), "email_domain", "left_anti")
    return joined.unionByName(beside)


def effective_pattern(companies: DataFrame, cached: DataFrame, inferred: DataFrame) -> DataFrame:
    """(company_id, domain, preferred): the company's own pattern (attrs.email_pattern), else the domain's cached one, else the inferred one; unknown names don't count."""
    known = lambda c: F.when(c.isin(*em.PATTERNS), c)
    c = companies.select(F.col("id").alias("company_id"), F.lower("domain").alias("domain"), known(F.get_json_object("attrs", "$.email_pattern")).alias("own"))
    held = cached.select(F.lower("domain").alias("domain"), known(F.col("pattern")).alias("cached"))
    found = inferred.select(F.col("email_domain").alias("domain"), F.col("pattern").alias("inferred"))
    return c.join(held, "domain", "left").join(found, "domain", "left").select("company_id", "domain", F.coalesce("own", "cached", "inferred").alias("preferred"))


def generate(people: DataFrame, patterns: DataFrame, most: int = em.MAX_PERMUTATIONS) -> DataFrame:
    """(person_id, place, pattern, email): a person's candidates in order, on folded names, at most ``most`` (0: no further cut)."""
    rows = people.join(patterns.where("domain <> ''"), "company_id")
    fn, ln = names.ascii_fold(F.coalesce("first_name", F.lit(""))), names.ascii_fold(F.coalesce("last_name", F.lit("")))
    folded = rows.select(F.col("id").alias("person_id"), "domain", "preferred", fn.alias("fn"), ln.alias("ln"))
    found = em.permutations(F.col("fn"), F.col("ln"), F.col("preferred"))
    out = folded.select("person_id", "domain", F.posexplode(F.slice(found, 1, most) if most else found).alias("place", "x"))
    return out.select("person_id", "place", F.col("x.pattern").alias("pattern"), F.concat("x.localpart", F.lit("@"), "domain").alias("email"))


def sequential(attempts: DataFrame, most: int) -> DataFrame:
    """(email_id, attempts, outcome): attempts in id order stop behind the first valid or risky one, after ``most`` at the latest."""
    w = Window.partitionBy("email_id").orderBy("id")
    over = F.col("verify_status").isin("valid", "risky_catch_all")
    walked = attempts.withColumn("done", F.max(over).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rank", F.row_number().over(w))
    own = walked.where(~F.coalesce("done", F.lit(False)) & (F.col("rank") <= most))
    s = F.col("verify_status")
    outcome = F.when(F.bool_or(s == "valid"), "valid_found").when(F.bool_or(s == "risky_catch_all"), "risky_found").when(F.bool_and(s == "invalid"), "all_invalid").otherwise("exhausted")
    return own.groupBy("email_id").agg(F.count("*").alias("attempts"), outcome.alias("outcome"))


def person_outcome(probes: DataFrame, hosts: DataFrame, tries: int = 3) -> DataFrame:
    """(person_id, outcome, n_attempts, found): candidates of a person are probed in order of ``place``.

    probes: person_id, place, attempt, status (of ``status.sequential_probe``), email; a
    temporary failure is tried again, ``tries`` times at most; the walk stops at the first valid or
    risky one. hosts: person_id, has_mx; without a mail host the outcome is no_mx.
    """
    tried = probes.where(F.col("attempt") <= tries)
    final = tried.groupBy("person_id", "place").agg(F.max_by("status", "attempt").alias("status"), F.max_by("email", "attempt").alias("email"), F.count("*").alias("n"))
    over = F.col("status").isin("valid", "risky_catch_all")
    stop = F.min(F.when(over, F.col("place"))).over(Window.partitionBy("person_id"))
    walked = final.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
    last = F.max_by(F.struct("status", "email"), "place")
    told = walked.groupBy("person_id").agg(last.alias("last"), F.bool_and(F.col("status").isin("invalid", "skipped")).alias("none"), F.sum("n").alias("n_attempts"))
    s = F.col("last.status")
    outcome = F.when(~F.coalesce("has_mx", F.lit(False)), "no_mx").when(s == "valid", "valid_found").when(s == "risky_catch_all", "risky_found").when(F.coalesce("none", F.lit(False)), "all_invalid").otherwise("exhausted")
    rows = hosts.select("person_id", "has_mx").join(told, "person_id", "left").withColumn("outcome", outcome)
    found = F.col("outcome").isin("valid_found", "risky_found")
    return rows.select("person_id", "outcome", F.when(F.col("outcome") == "no_mx", 0).otherwise(F.coalesce("n_attempts", F.lit(0))).cast("long").alias("n_attempts"), F.when(found, F.col("last.email")).alias("found"))
