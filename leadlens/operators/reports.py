"""Roll-ups of runs and batches, merges of partial results, and ranked or paged lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_summary(runs: DataFrame, users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs (id, user_id, status) with user_name, verified and valid (0 if there are none) and valid_percent (one decimal; 0 without results)."""
    rows = runs.join(users, "user_id", "left").join(metrics, "id", "left")
    share = F.round(F.try_divide(F.col("valid"), F.col("verified")) * 100, 1)
    return rows.select("id", "status", "user_name", F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce(share, F.lit(0.0)).alias("valid_percent"))


def status_counts(rows: DataFrame, key: Column, name: str, outcome: Column, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per key: all rows, and those whose outcome is in each named group."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("total"), *[F.count_if(outcome.isin(*v)).alias(k) for k, v in groups.items()])


def recompute_runs(runs: DataFrame, companies: DataFrame, people: DataFrame, emails: DataFrame) -> DataFrame:
    """Per run (id, domains: a JSON list; null or broken: no domains): companies found, with and without people, with emails, and people in all."""

    def per_company(df: DataFrame, name: str) -> DataFrame:
        return df.where("company_id is not null").groupBy("company_id").agg(F.count("*").alias(name))

    listed = runs.select("id", F.explode_outer(F.array_distinct(F.from_json("domains", "array<string>"))).alias("domain"))
    held = companies.select(F.col("id").alias("company_id"), "domain").join(per_company(people, "np"), "company_id", "left").join(per_company(emails, "ne"), "company_id", "left")
    known = F.col("company_id").isNotNull()
    return listed.join(held, "domain", "left").groupBy("id").agg(
        F.count("company_id").alias("companies"), F.count_if(F.col("np") > 0).alias("with_people"), F.count_if(known & F.col("np").isNull()).alias("zero_people"), F.count_if(F.col("ne") > 0).alias("with_emails"), F.coalesce(F.sum("np"), F.lit(0)).alias("people"),
    )


def discovery_rollup(results: DataFrame, counters: list[str], company: str, error: Column) -> DataFrame:
    """(name, n): sums of counters, distinct companies, and errors by type (the text before a colon, 50 characters at most)."""
    sums = results.agg(*[F.sum(c).cast("long").alias(c) for c in counters], F.count_distinct(company).alias("companies"))
    totals = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in [*counters, "companies"]])).alias("x")).select("x.*")
    kind = F.substring(F.split_part(error, F.lit(":"), F.lit(1)), 1, 50)
    return totals.union(results.where(error.isNotNull()).groupBy(F.concat(F.lit("error:"), kind).alias("name")).agg(F.count("*").alias("n")))


def merge_results(rows: DataFrame, key: str, total: Column, flag: Column, item: str, order: list[str], sample: int = 25) -> DataFrame:
    """Per key: the sum of total, whether any row has flag, and the first ``sample`` items in order.

    Items beyond the sample never reach the list: the rank limit applies before and after the shuffle.
    """
    merged = rows.groupBy(key).agg(F.sum(total).cast("long").alias("total"), F.bool_or(flag).alias("flagged"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.select(key, item, *[c for c in order if c not in (key, item)]).withColumn("place", place).where(F.col("place") <= sample)
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]).alias("sample"))
    return merged.join(lists, key, "left")


def attempts_in(rows: DataFrame, key: str, at: str, days: int, most: int) -> DataFrame:
    """Per key: the largest number of rows within ``days`` before any of them (it included), and whether that reaches ``most``."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at").rangeBetween(-days * 86_400_000_000, 0)
    counted = rows.select(key, micros.alias("__at")).select(key, F.count("*").over(w).alias("n"))
    return counted.groupBy(key).agg(F.max("n").alias("most"), (F.max("n") >= most).alias("blocked"))


def search_everywhere(lists: dict[str, tuple[DataFrame, str]], text: str, limit: int) -> DataFrame:
    """(kind, id, label): for each named table (its rows and label column) the first ``limit`` rows by id whose label contains the text, case aside."""
    out = None
    for kind, (rows, label) in lists.items():
        found = rows.where(F.lower(label).contains(text.lower())).orderBy("id").limit(limit).select(F.lit(kind).alias("kind"), "id", F.col(label).alias("label"))
        out = found if out is None else out.union(found)
    return out


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows (the first is 1), with total, page and total_pages (1 at least)."""
    total = rows.count()
    paged = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return paged.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(page), "total_pages": F.lit(max(1, math.ceil(total / size)))})


def latest_by_any(rows: DataFrame, names: list[Column], name: str, newest: list[str]) -> DataFrame:
    """For each value found under any of ``names`` the newest row (by the columns ``newest``, the last an id): name and that id."""
    spread = rows.select(F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias(name), *newest)
    return spread.groupBy(name).agg(F.max_by(newest[-1], F.struct(*newest)).alias(newest[-1]))


def best_match(rows: DataFrame, ranked: list[Column], name: str) -> DataFrame:
    """For each value under any of ``ranked``: the row of the best rank (position in the list), the largest id among those."""
    spread = rows.select("id", F.posexplode(F.array(*ranked)).alias("rank", name)).where(F.col(name).isNotNull())
    return spread.groupBy(name).agg(F.max_by(F.struct("id", "rank"), F.struct(-F.col("rank"), F.col("id"))).alias("x")).select(name, "x.*")


def signature(*parts: Column) -> Column:
    """Parts joined by bars, no-break spaces as spaces, runs of blanks as one."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.trim(F.regexp_replace(F.replace(joined, F.lit("\u00a0"), F.lit(" ")), "[ \\t]+", " "))
