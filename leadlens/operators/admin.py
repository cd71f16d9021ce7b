"""Administration: funnels, empty companies, users' runs and actions, quotas, duplicates, catch-all diagnostics, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.analytics import VERDICTS, rate

#: States of a run, and actions of a user with the names of their counts.
RUN_STATES = ("queued", "running", "succeeded", "failed", "cancelled")
ACTIONS = {"run_created": "runs_created", "run_completed": "runs_completed", "run_failed": "runs_failed", "export": "exports", "search": "searches", "verify": "verifications"}


def verification_stats(latest: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: addresses by latest status and the valid rate; of the raw results if there is no latest one.

    Both are counted in one pass: the raw counts are taken only where the latest total is 0.
    """
    own = latest.select(F.lit(True).alias("latest"), "verify_status").unionByName(raw.select(F.lit(False).alias("latest"), "verify_status"))
    count = lambda name, cond: F.struct(F.count_if(F.col("latest") & cond).alias("a"), F.count_if(~F.col("latest") & cond).alias("b")).alias(name)
    sums = own.agg(count("total", F.lit(True)), *[count(s, F.coalesce(F.col("verify_status") == s, F.lit(False))) for s in VERDICTS])
    told = sums.select(*[F.when(F.col("total.a") > 0, F.col(f"{c}.a")).otherwise(F.col(f"{c}.b")).alias(c) for c in ("total", *VERDICTS)])
    return told.withColumn("valid_rate", rate(F.col("valid"), F.col("valid") + F.col("invalid") + F.col("risky_catch_all")))


def funnel(sources: DataFrame, people: DataFrame, emails: DataFrame, results: DataFrame, run_metrics: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row of seven measures of companies: with pages, with people, with a valid address, blocked by 403 and by robots, without a mail host, catch-all.

    One aggregate over narrow rows (measure, company); a company counts once a measure.
    """
    of = lambda df, name: df.where("company_id is not null").select(F.lit(name).alias("m"), F.col("company_id").cast("long").alias("company_id"))
    valid = emails.join(results.where("verify_status = 'valid'").select(F.col("email_id").alias("id")), "id", "left_semi")
    rows = of(sources, "with_pages").union(of(people, "with_people")).union(of(valid, "with_valid")).union(of(resolutions.where("catch_all_status = 'no_mx'"), "no_mx")).union(of(resolutions.where("catch_all_status = 'catch_all'"), "catch_all"))
    counts = rows.agg(*[F.count_distinct(F.when(F.col("m") == m, F.col("company_id"))).alias(m) for m in ("with_pages", "with_people", "with_valid", "no_mx", "catch_all")])
    blocked = run_metrics.agg(F.coalesce(F.sum("blocked_403"), F.lit(0)).alias("blocked_403"), F.coalesce(F.sum("blocked_robots"), F.lit(0)).alias("blocked_robots"))
    return counts.join(F.broadcast(blocked))  # one row each


def without_people(companies: DataFrame, pages: DataFrame, people: DataFrame, prefer_blank_safe: bool = False, newest: int = 20) -> DataFrame:
    """(id, name, domain, n_pages, urls): companies with pages but without people; their ``newest`` pages, newest first.

    domain: official, else stored, else given, else blank; ``prefer_blank_safe``: a blank official one is passed over, the given one isn't used.
    """
    name = F.coalesce(F.nullif("official_domain", F.lit("")), "domain") if prefer_blank_safe else F.coalesce("official_domain", "domain", "user_domain", F.lit(""))
    empty = companies.join(people.select(F.col("company_id").alias("id")), "id", "left_anti")
    own = pages.select(F.col("company_id").alias("id"), "fetched_at", "url")
    n = own.groupBy("id").agg(F.count("*").alias("n_pages"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fetched_at"), "url"))
    shown = own.withColumn("place", place).where(F.col("place") <= newest).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "url"))).alias("p"))
    return empty.join(n, "id").join(shown, "id").select("id", "name", name.alias("domain"), "n_pages", F.transform("p", lambda x: x["url"]).alias("urls"))


def user_runs(runs: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """The n users with the most runs: counts by state and the last run; ties by user."""
    counts = [F.count_if(F.col("status") == s).alias(f"runs_{s}") for s in RUN_STATES]
    top = runs.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("runs_total"), *counts, F.max("created_at").alias("last_run_at")).orderBy(F.desc("runs_total"), "user_id").limit(n)
    return top.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id", "left")


def usage(activity: DataFrame, keys: list[str], since: Column | None = None) -> DataFrame:
    """Counts of the six actions, of all, and the first and last time, by user or tenant."""
    own = activity if since is None else activity.where(F.col("created_at") >= since)
    return own.groupBy(*keys).agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in ACTIONS.items()], F.count("*").alias("total_actions"), F.min("created_at").alias("first_activity"), F.max("created_at").alias("last_activity"))


def rolling_quota(activity: DataFrame, runs: DataFrame, tenant: str, now: Column, current_run: str | None = None, has_activity: bool = True) -> DataFrame:
    """(n, method): companies started in the last 24 hours, of activity metadata, or (without that table) of the runs' domain lists; the current run left out.

    activity: tenant_id, action, created_at, resource_id, metadata (JSON); runs: id, tenant_id, created_at, domains_json.
    """
    since = now - F.make_dt_interval(hours=F.lit(24))
    recent = lambda df, run: df.where((F.col("tenant_id") == tenant) & (F.col("created_at") >= since) & (F.lit(current_run is None) | (F.col(run) != F.lit(current_run or ""))))
    if has_activity:
        number = lambda key: F.nullif(F.get_json_object("metadata", f"$.{key}").try_cast("long"), F.lit(0).cast("long"))
        rows = recent(activity, "resource_id").where(F.lower("action").like("%run%started%"))
        return rows.agg(F.coalesce(F.sum(F.coalesce(number("domains_count"), number("effective_domain_count"), F.lit(0))), F.lit(0)).alias("n"), F.lit("user_activity").alias("method"))
    size = F.coalesce(F.size(F.from_json("domains_json", "array<string>")), F.lit(0))
    return recent(runs, "id").agg(F.coalesce(F.sum(F.when(size > 0, size).otherwise(0)), F.lit(0)).cast("long").alias("n"), F.lit("runs").alias("method"))


def duplicates(emails: DataFrame) -> DataFrame:
    """(tenant_id, email, n): addresses that a tenant has more than once."""
    return emails.groupBy("tenant_id", "email").agg(F.count("*").alias("n")).where("n > 1")


def catch_all_domains(rows: DataFrame) -> DataFrame:
    """By reason of results on catch-all domains: how many, on how many domains, how many are valid; and those that count as valid for nothing but an accepted recipient (misclassified).

    rows: email_domain, catch_all, verify_status, verify_reason.
    """
    own = rows.where("catch_all = 'catch_all'")
    valid = F.col("verify_status") == "valid"
    wrong = valid & F.col("verify_reason").startswith("rcpt_2xx")
    return own.groupBy(F.coalesce("verify_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("email_domain").alias("n_domains"), F.count_distinct(F.when(valid, F.col("email_domain"))).alias("n_valid_domains"), F.count_if(valid).alias("n_valid"), F.count_if(wrong).alias("n_misclassified"))


def run_totals(runs: DataFrame, companies: DataFrame, people: DataFrame, emails: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per run and company, per run): the companies of a run's domain list with their people, addresses and results by status; and their sums.

    runs: id, domains_json. A domain without a company counts in n_domains only.
    """
    asked = runs.select(F.col("id").alias("run_id"), F.explode(F.array_distinct(F.from_json("domains_json", "array<string>"))).alias("domain"))
    n = lambda df, name: df.where("company_id is not null").groupBy("company_id").agg(F.count("*").alias(name))
    told = emails.select("id", "company_id").join(latest.select(F.col("email_id").alias("id"), "verify_status"), "id")
    states = told.groupBy("company_id").agg(*[F.count_if(F.col("verify_status") == s).alias(s) for s in VERDICTS])
    c = companies.select(F.col("id").alias("company_id"), "domain")
    rows = asked.join(c, "domain", "left").join(n(people, "n_people"), "company_id", "left").join(n(emails, "n_emails"), "company_id", "left").join(states, "company_id", "left")
    counts = ("n_people", "n_emails", *VERDICTS)
    per_company = rows.fillna(0, list(counts))
    found = F.col("company_id").isNotNull()
    per_run = per_company.groupBy("run_id").agg(
        F.count("*").alias("n_domains"), F.count_if(found).alias("companies_found"), F.count_if(found & (F.col("n_people") > 0)).alias("with_people"), F.count_if(found & (F.col("n_people") == 0)).alias("zero_people"), F.count_if(F.col("n_emails") > 0).alias("with_emails"), *[F.sum(c).alias(c) for c in counts],
    )
    return per_company.where(found).select("run_id", "company_id", *counts), per_run
