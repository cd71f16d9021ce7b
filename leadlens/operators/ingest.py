"""Ingest: inbound records in normal form, legacy buckets, names out of headings, row caps, times and modes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import names
from leadlens.functions.once import once

#: The row cap of an import; roles that say nothing; credentials behind names; words of headings that aren't names (with the general ones, ``STOPWORDS``); modes and their spellings.
MAX_ROWS = 10_000
NO_ROLE = ("-", "—", "--", "na", "n/a", "none", "null")
CREDENTIALS = ("CPA", "MBA", "CFP", "CFA", "EA", "JD", "PhD", "MD", "RN", "PE", "PMP", "SPHR", "PHR", "SHRM", "CFE", "CIA", "CISA", "CMA", "CGMA", "CVA", "ABV", "ASA", "CEPA", "ChFC", "CLU", "RICP", "WMCP", "AIF", "AAMS", "CRPC", "CDFA", "CPA/PFS")
STOPWORDS = ("welcome", "team", "office", "info", "support", "example", "contact", "admin", "marketing", "billing", "hello", "hi", "building", "deliver", "delivery", "executive", "executives", "talent", "solution", "solutions", "partner", "partners", "growth", "strategy", "strategic", "turnaround", "restructuring", "pricing", "price", "resources", "resource", "service", "services", "company", "about", "blog", "careers", "leadership", "home", "our", "firm", "disclaimers", "privacy", "policy", "documents", "document", "payroll", "contractor", "testimonials", "testimonial", "more", "payment", "payments", "links", "link", "useful", "login", "log", "in", "out", "individual", "business", "preparation", "tax", "bookkeeping", "clients", "client", "cpa", "mba", "esq", "phd", "md", "jd", "certified", "public", "accountant", "advisor", "advisors", "manager", "director", "principal", "owner", "founder", "ambitious", "efficient", "dedicated", "specialized", "expertise", "fractional", "readiness", "quiz", "founderled", "founder-led", "process", "how", "works", "take", "book", "call", "option", "options", "faq", "terms", "linkedin", "view", "community")
MODES = {"all": ("full",), "full": ("full",), "everything": ("full",), "autodiscovery": ("autodiscovery",), "discovery": ("autodiscovery",), "crawl": ("autodiscovery",), "generate": ("generate",), "generation": ("generate",), "gen": ("generate",), "verify": ("verify",), "verification": ("verify",), "verif": ("verify",), "genverify": ("generate", "verify"), "generateverify": ("generate", "verify"), "generate_verify": ("generate", "verify"), "generation_verify": ("generate", "verify")}


def enforce_cap(rows: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """The rows, or an error if there are more than ``most``; counts no further than that."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"input has more than {most:,} rows; lower its size or raise the cap")
    return rows


def role_bucket(role: Column) -> Column:
    """The legacy bucket of a role: its family in lower case; a blank or a placeholder is other."""
    clean = F.trim(F.coalesce(role, F.lit("")))
    return F.when((clean == "") | F.lower(clean).isin(*NO_ROLE), "other").otherwise(F.lower(names.canonical_title(clean)[0]))


def heading_name(heading: Column) -> Column:
    """A person's name out of a heading: letters before the first comma, without stop words and single letters; NULL below two words."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(heading, "[^A-Za-z ,]+", " "), " +", " "))
    words = F.filter(F.split(F.split_part(clean, F.lit(","), F.lit(1)), " "), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*STOPWORDS))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100)))), " "))


def without_credentials(name: Column) -> Column:
    """A name without CPA, MBA and the like, in any case, with commas and brackets around them."""
    pattern = rf"(?i),?\s*\(?\b({'|'.join(map(re.escape, CREDENTIALS))})\b\)?"
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, pattern, "")), ",+$", ""))
    return once(clean, lambda c: F.when(c == "", name).otherwise(c))


def iso_z(at: Column) -> Column:
    """A UTC time as text, to the second, with a Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text as a UTC time without zone: Z, an offset, or none; NULL if it isn't one."""
    clean = F.trim(text)
    whole = clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.to_utc_timestamp(F.try_to_timestamp(F.when(whole, clean)), F.current_timezone()).cast("timestamp_ntz")


def modes(given: str | list | None) -> list[str]:
    """Pipeline modes by any spelling, in their order, without repeats; full wins; nothing given is full."""
    texts = [given] if isinstance(given, str) else list(given or [])
    tokens = [t for x in texts if x is not None for t in re.split(r"[+,\s]+", str(x).strip().lower()) if t]
    mapped = [m for t in tokens for m in MODES.get(t, (t,))]
    return ["full"] if not mapped or "full" in mapped else list(dict.fromkeys(mapped))


def normalize(records: DataFrame) -> DataFrame:
    """Inbound records in normal form; missing columns count as NULL.

    In: company, domain, role, first_name, last_name, full_name, title, source_url,
    notes. Out: these, trimmed (blank as NULL; names filled from full_name and in
    display case), with title_raw, title_norm, norm_domain, company_name_norm, company_norm_key,
    norm_role and errors (JSON array of tags). source_url and full_name stay as they are.
    """
    given = ("company", "domain", "role", "first_name", "last_name", "full_name", "title", "source_url", "notes")
    own = records.select(*[(names.nfkc(F.col(c).cast("string")) if c in records.columns else F.lit(None).cast("string")).alias(c) for c in given])
    parts = names.split_parts(F.coalesce("full_name", F.lit("")))
    filled = own.withColumn("__p", parts).withColumns({c: F.coalesce(c, F.nullif(F.col(f"__p.{c.split('_')[0]}"), F.lit(""))) for c in ("first_name", "last_name")})
    told = filled.withColumns({"__n": names.norm_parts(F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))), "__c": names.norm_company(F.col("company")), "title_norm": names.norm_title(F.col("title")), "norm_domain": names.idna(F.col("domain"))})
    out = told.withColumns({
        "first_name": F.coalesce(F.nullif(F.col("__n.first"), F.lit("")), "first_name", F.lit("")), "last_name": F.coalesce(F.nullif(F.col("__n.last"), F.lit("")), "last_name", F.lit("")),
        "title_raw": F.col("title"), "company_name_norm": F.col("__c.display"), "company_norm_key": F.col("__c.key"), "norm_role": F.col("role"), "errors": F.to_json(F.array_compact(F.array("__n.error"))),
    })
    return out.drop("__p", "__n", "__c")
