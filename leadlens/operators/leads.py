"""The lead view, primary addresses, facets, search, scoring and export policy."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.functions import emails as em
from leadlens.functions import labels
from leadlens.functions.names import UNTITLED, canonical_title
from leadlens.operators.latest import first_by, latest

#: Points of a score, and the default export policy.
ROLE_POINTS = {"Sales": 35, "Engineering": 25, "Marketing": 10, "Customer Success": 20, "Operations": 10}
SENIORITY_POINTS = {"C": 30, "VP": 25, "Head": 20, "Director": 18, "Manager": 12, "IC": 0}
CAP = 100
POLICY = {"allowed_statuses": ("valid", "risky_catch_all"), "min_icp_score_valid": 70, "min_icp_score_catch_all": 80, "exclude_roles": ("student", "intern"), "exclude_seniority": ("junior",), "exclude_industries": ("education", "government")}


#: Further points, by company size, industry and technology.
WEIGHTS = {"role_family": ROLE_POINTS, "seniority": SENIORITY_POINTS, "company_size": {}, "industry": {}, "tech": {}}


def _points(key: Column, table: dict[str, int]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0)) if pairs else F.lit(0)


def score(role_family: Column, seniority: Column, size: Column | None = None, industry: Column | None = None, tech: Column | None = None, domain: Column | None = None, weights: dict[str, dict[str, int]] = WEIGHTS, required: tuple[str, ...] = ("role_family",), cap: int = CAP) -> tuple[Column, Column]:
    """(score, reasons): 0 if a required one of domain, role_family, seniority is missing; else the points of each signal with their reasons, cut to 0..cap.

    tech: array<string>, looked up in lower case, every entry counts; weights: points by signal and value.
    """
    none = F.lit(None).cast("string")
    given = {"role_family": role_family, "seniority": seniority, "company_size": none if size is None else size, "industry": none if industry is None else industry}
    have = given | {"domain": none if domain is None else domain}
    missing = F.lit(False)
    for k in required:
        missing = missing | (F.coalesce(have[k], F.lit("")) == "")
    points = {k: _points(c, weights.get(k, {})) for k, c in given.items()}
    worth = lambda w: _points(F.lower(w), weights.get("tech", {}))
    words = F.array().cast("array<string>") if tech is None else F.filter(F.coalesce(tech, F.array().cast("array<string>")), lambda w: worth(w) != 0)
    told = lambda name, value, n: F.concat(F.lit(f"{name}:"), value, F.lit("+"), n)
    why = F.array_compact(F.array(*[F.when(points[k] != 0, told(k, given[k], points[k])) for k in given]))
    if tech is not None:
        why = F.concat(why, F.transform(words, lambda w: told("tech", w, worth(w))))
    total = sum(points.values(), F.lit(0)) if tech is None else F.aggregate(words, sum(points.values(), F.lit(0)), lambda n, w: n + worth(w))
    cut = F.greatest(F.lit(0), F.least(F.lit(cap), total))
    return F.when(missing, 0).otherwise(cut).cast("int"), F.when(missing, F.array(F.lit("missing_min_required"))).otherwise(why)


def titled(people: DataFrame) -> DataFrame:
    """``people`` with role_family and seniority of their titles; a title is judged once, however many people have it."""
    # judged behind a count: else Spark moves a filter on the outcome below the aggregate and across the join, and judges every person several times
    titles = people.select("title").distinct().groupBy("title").agg(F.count("*").alias("n"))
    family, seniority = canonical_title(F.when(F.col("n") > 0, F.col("title")))
    out = people.join(titles.select("title", family.alias("role_family"), seniority.alias("seniority")), "title", "left")
    return out.fillna(dict(zip(("role_family", "seniority"), UNTITLED))).select(*people.columns, "role_family", "seniority")


def view(emails: DataFrame, people: DataFrame, companies: DataFrame, results: DataFrame) -> DataFrame:
    """One row per address with its person, company and latest result."""
    told = ("verify_status", "verify_reason", "verified_at", "mx_host")
    v = latest(results.select("email_id", "id", "checked_at", *told), "view").select(F.col("email_id").alias("id"), *told)
    p = titled(people.select(F.col("id").alias("person_id"), "first_name", "last_name", "full_name", "title"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "industry", "size_bucket")
    out = emails.join(v, "id", "left").join(p, "person_id", "left").join(c, "company_id", "left")
    out = out.fillna(dict(zip(("role_family", "seniority"), UNTITLED)))  # an address without a person
    points, _ = score(F.col("role_family"), F.col("seniority"))
    return out.withColumn("icp_score", points).withColumn("email_domain", em.domain_split(F.col("email")))


def primary(leads: DataFrame) -> DataFrame:
    """The primary address of each person among valid ones."""
    valid = leads.where("verify_status = 'valid'")
    tier = F.when(labels.base_label(F.col("verify_status"), F.col("verify_reason")) == "valid_native", 0).otherwise(1)
    order = [labels.source_rank(F.col("source")), tier, labels.human_score(F.col("email"), F.col("first_name"), F.col("last_name")), F.col("verified_at").asc_nulls_first(), F.col("id")]
    return first_by(valid, ["person_id"], order)


def labelled(leads: DataFrame) -> DataFrame:
    """leads with verify_label and is_primary; is_primary is NULL where a person has no valid address."""
    own = primary(leads).select("person_id", F.col("id").alias("primary_id"))
    out = leads.join(own, "person_id", "left").withColumn("is_primary", F.col("id") == F.col("primary_id"))
    return out.withColumn("verify_label", labels.full_label(F.col("verify_status"), F.col("verify_reason"), F.col("is_primary"))).drop("primary_id")


def icp_bucket(c: Column) -> Column:
    return F.when(c.isNull(), None).when(c < 40, "0-39").when(c < 60, "40-59").when(c < 80, "60-79").otherwise("80-100")


def facets(leads: DataFrame, named: dict[str, Column], limit: int | None = 200) -> DataFrame:
    """(facet, value, n) of all facets in one scan and one exchange; NULL and blank values are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in named.items()])
    counts = leads.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    if limit is None:
        return counts
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


#: Columns that a substring search looks at.
SEARCHED = ("full_name", "title", "company", "email")
EXPORT_STATUSES = ("valid", "invalid", "risky_catch_all", "unknown_timeout")


def attribute(name: str) -> Column:
    """A company attribute (``attrs``: JSON text)."""
    return F.get_json_object("attrs", f"$.{name}")


def any_like(cols: list[Column], pattern: str) -> Column:
    """One of the columns is like the pattern, whatever its case; % and _ are wildcards; NULL isn't."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(c).like(pattern.lower()), F.lit(False))
    return out


def export_status(status: Column, wanted: str | None) -> Column:
    """valid: any status that begins so; others by equality; an unknown one filters nothing; a row without a result never passes."""
    if wanted not in EXPORT_STATUSES:
        return F.lit(True)
    s = F.lower(status)
    return F.coalesce(s.startswith("valid") if wanted == "valid" else s == wanted, F.lit(False))


def search(leads: DataFrame, *, tenant=None, statuses=None, icp_min=None, roles=None, seniority=None, industries=None, sizes=None, tech=None, source=None, recency_days=None, now=None, checked_counts=False, exported=None, status_filter=None, text=None) -> DataFrame:
    """Leads that pass every given filter; lists are alternatives, a NULL value never passes a list.

    industries, sizes: of the company's columns, or else of its ``attrs``; tech:
    any keyword occurs in ``attrs`` (% and _ are wildcards); source: published or
    generated; recency_days before ``now``: of the verified time, or (``checked_counts``) of
    the checked time without one; exported: yes or no; text: a substring of a searched column.
    """
    own = lambda name: F.col(name) if name in leads.columns else attribute(name)
    seen = F.coalesce("verified_at", "checked_at") if checked_counts else F.col("verified_at")
    checks = [
        None if tenant is None else F.col("tenant_id") == tenant,
        None if not statuses else F.col("verify_status").isin(*statuses),
        None if icp_min is None else F.col("icp_score").isNotNull() & (F.col("icp_score") >= icp_min),
        None if not roles else F.col("role_family").isin(*roles),
        None if not seniority else F.col("seniority").isin(*seniority),
        None if not industries else own("industry").isin(*industries),
        None if not sizes else own("size_bucket").isin(*sizes),
        None if not tech else F.greatest(*[any_like([F.col("attrs")], f"%{t}%") for t in tech], F.lit(False)),
        None if source not in ("published", "generated") else F.coalesce("is_published", F.lit(0)) == (1 if source == "published" else 0),
        None if recency_days is None else seen >= now - F.make_dt_interval(F.lit(recency_days)),
        None if exported not in ("yes", "no") else F.col("exported_at").isNotNull() if exported == "yes" else F.col("exported_at").isNull(),
        None if status_filter is None else export_status(F.col("verify_status"), status_filter),
        None if not text else any_like([F.col(c) for c in SEARCHED], f"%{text}%"),
    ]
    for check in checks:
        if check is not None:
            leads = leads.where(check)
    return leads


def page(rows: DataFrame, size: int, after: tuple | None = None, sort: str = "icp", ascending_ids: bool = False) -> DataFrame:
    """A page by keyset: icp score or verified time, descending, then id; strictly after ``after``.

    Missing scores count as -1 and missing times come last, ids descend; with
    ``ascending_ids`` (the other back end) missing keys come last and ids ascend.
    """
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    if sort not in ("icp", "verified"):
        raise ValueError(f"unknown sort {sort!r}")
    key = F.col("verified_at") if sort == "verified" else F.col("icp_score") if ascending_ids else F.coalesce(F.col("icp_score"), F.lit(-1))
    id_ = F.col("id")
    if after:
        later = id_ > after[1] if ascending_ids else id_ < after[1]
        rows = rows.where(key.isNull() & later if after[0] is None else (key < after[0]) | ((key == after[0]) & later) | key.isNull())
    return rows.orderBy(key.desc_nulls_last(), id_.asc() if ascending_ids else id_.desc()).limit(size)


def next_cursor(rows: list, size: int, sort: str) -> str | None:
    """The cursor behind a page's collected rows: only if the page is full and its last key isn't missing."""
    key = "verified_at" if sort == "verified" else "icp_score"
    if len(rows) < size or rows[-1][key] is None:
        return None
    return encode_cursor(sort, rows[-1][key], rows[-1]["id"])


def request(**given: str | None) -> dict:
    """Search parameters as strings -> typed ones: lists at commas, trimmed, without blanks; 1 to 100 rows (50 if not given); a wrong one is an error."""
    out: dict = {}
    for name, value in given.items():
        if value is None or not value.strip():
            continue
        if name in ("statuses", "roles", "seniority", "industries", "sizes", "tech"):
            out[name] = tuple(x.strip() for x in value.split(",") if x.strip())
        elif name in ("limit", "icp_min", "recency_days"):
            if not value.strip().lstrip("+-").isdigit():
                raise ValueError(f"{name} must be a whole number")
            out[name] = int(value)
        else:
            out[name] = value.strip()
    out.setdefault("limit", 50)
    if not 1 <= out["limit"] <= 100:
        raise ValueError("limit must be 1 to 100")
    if out.get("recency_days", 1) < 1:
        raise ValueError("recency_days must be positive")
    if out.setdefault("sort", "icp_desc") not in ("icp_desc", "verified_desc"):
        raise ValueError(f"unsupported sort {out['sort']!r}")
    return out


def encode_cursor(sort: str, key: object, id_: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"sort": sort, "key": key, "id": id_}, separators=(",", ":"), default=str).encode()).decode()


def decode_cursor(cursor: str, sort: str) -> tuple:
    """(key, id); a damaged cursor, or one of another sort, is an error."""
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if held["sort"] != sort:
            raise ValueError("cursor of another sort")
        return held["key"], int(held["id"])
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"bad cursor: {e}") from None


def export_reason(lead_status: Column, icp: Column, role: Column, seniority: Column, industry: Column, policy: dict = POLICY) -> Column:
    """'ok', or the first rule of the policy that excludes a lead."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s = low(lead_status)
    least = F.when(s == "valid", policy.get("min_icp_score_valid")).when(s == "risky_catch_all", policy.get("min_icp_score_catch_all"))
    return (
        F.when(~s.isin(*policy["allowed_statuses"]), "status_not_allowed")
        .when(least.isNotNull() & (icp.isNull() | (icp < least)), "icp_below_threshold")
        .when(low(role).isin(*policy["exclude_roles"]), "role_excluded")
        .when(low(seniority).isin(*policy["exclude_seniority"]), "seniority_excluded")
        .when(low(industry).isin(*policy["exclude_industries"]), "industry_excluded")
        .otherwise("ok")
    )


def escape_cell(c: Column) -> Column:
    """A quote before cells that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def suppress(rows: DataFrame, suppression: DataFrame, now: Column | None = None) -> DataFrame:
    """rows (email) without those suppressed by address, by its hash, or by domain.

    suppression: email, email_hash, domain; with a ``tenant_id`` on both sides only the own
    tenant's entries count, with ``expires_at`` only those that haven't expired by ``now``.
    """
    if now is not None and "expires_at" in suppression.columns:
        suppression = suppression.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    tenant = ["tenant_id"] if "tenant_id" in suppression.columns and "tenant_id" in rows.columns else []
    keyed = rows.withColumns({"__e": F.lower(F.trim("email")), "__h": em.email_hash(F.col("email")), "__d": em.domain_split(F.col("email"))})
    for key, held in (("__h", F.col("email_hash")), ("__d", F.lower("domain")), ("__e", F.lower(F.trim("email")))):
        keyed = keyed.join(suppression.select(*tenant, held.alias(key)).where(F.col(key).isNotNull()), [*tenant, key], "left_anti")
    return keyed.drop("__e", "__h", "__d")


def is_generated(note: Column, url: Column) -> Column:
    """An address that was made from a pattern: by its note (one more character behind "sequential"), and without a page that shows it."""
    noted = note.rlike("^(generated:|sequential_candidate:|unverified:|sequential.)")
    return F.coalesce(noted, F.lit(False)) & (F.trim(F.coalesce(url, F.lit(""))) == "")


def cleanup(emails: DataFrame, results: DataFrame, untested: bool = False) -> DataFrame:
    """Generated addresses to delete: the latest result is invalid, or (``untested``) there is none. emails: id, source_note, source_url."""
    last = latest(results, "view").select(F.col("email_id").alias("id"), "verify_status")
    made = emails.where(is_generated(F.col("source_note"), F.col("source_url")))
    bad = made.join(last.where("verify_status = 'invalid'"), "id", "left_semi")
    return bad.union(made.join(last, "id", "left_anti")) if untested else bad


#: The columns of a run's results, and how many rows an export has.
RESULT_COLUMNS = ("email", "first_name", "last_name", "full_name", "title", "company", "company_id", "company_domain", "icp_score", "verify_status", "verify_reason", "verified_at", "verify_label", "is_primary_for_person", "source_url")
EXPORT_ROWS = 10_000


def run_results(leads: DataFrame, people: DataFrame, companies: DataFrame, limit: int = EXPORT_ROWS) -> DataFrame:
    """The first ``limit`` results of a run in all ``RESULT_COLUMNS``: best score first, those without a score last, then the newest, unverified before."""
    own = people.select(F.col("id").alias("person_id"), "source_url")
    homes = companies.select(F.col("id").alias("company_id"), F.col("domain").alias("company_domain"))
    order = [F.col("icp_score").desc_nulls_last(), F.col("verified_at").desc_nulls_first(), "id"]
    # the rows that are shown first, then what belongs to them
    shown = labelled(leads).orderBy(*order).limit(limit)
    return shown.join(own, "person_id", "left").join(homes, "company_id", "left").orderBy(*order).withColumnRenamed("is_primary", "is_primary_for_person").select(*RESULT_COLUMNS)
