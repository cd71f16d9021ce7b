"""Search over leads: documents of people, full-text requests, facets of a page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import labels
from leadlens.operators import leads as L
from leadlens.operators.latest import first_by
from leadlens.operators.text import has_phrase

#: The parts of a person's document, by name.
FIELDS = ("full_name", "first_name", "last_name", "title", "role_family", "seniority", "company", "domain")
BUCKET_FACETS = ("verify_status", "icp_bucket", "role_family", "seniority", "size_bucket", "industry")


def document(columns: list[str]) -> Column:
    """The text that a person is found by."""
    return F.concat_ws(" ", *[F.col(c) for c in FIELDS if c in columns])


def documents(leads: DataFrame) -> DataFrame:
    """One row a person, with its text and company attributes: of several addresses the primary's, else the first by source and id."""
    order = [F.when(F.col("verify_status") == "valid", 0).otherwise(1), labels.source_rank(F.col("source")), F.col("id")]
    kept = first_by(leads.where("person_id is not null"), ["person_id"], order)
    return kept.withColumns({"text": document(leads.columns), "tech": F.from_json(L.attribute("tech"), "array<string>")})


def phrase_or_words(query: str, columns: list[str], text: Column) -> Column:
    """A request of the search box: AND, OR, NEAR and column:word are understood; all else is one literal phrase.

    NEAR is taken as AND. A blank request is an error.
    """
    q = query.strip()
    if not q:
        raise ValueError("query must be a non-empty string")
    if not re.search(r" (AND|OR|NEAR) ", q.upper()) and ":" not in q:
        return has_phrase(text, q.replace('"', " "))

    def word(part: str) -> Column:
        name, colon, rest = part.partition(":")
        return has_phrase(F.coalesce(F.col(name), F.lit("")), rest.strip('" ')) if colon and name in columns else has_phrase(text, part.strip('" '))

    out = F.lit(False)
    for alternative in re.split(r"\s+OR\s+", q, flags=re.I):
        every = F.lit(True)
        for part in re.split(r"\s+(?:AND|NEAR)\s+", alternative, flags=re.I):
            every = every & word(part.strip())
        out = out | every
    return out


def full_text(leads: DataFrame, query: str) -> DataFrame:
    """Leads of the people whose document matches: a row an address, people without a company left out."""
    found = leads.where(F.col("person_id").isNotNull() & F.col("company_id").isNotNull()).withColumn("__text", document(leads.columns))
    return found.where(phrase_or_words(query, leads.columns, F.col("__text"))).drop("__text")


def facets(docs: DataFrame, names: tuple[str, ...] = BUCKET_FACETS, cursor: tuple | None = None) -> DataFrame:
    """(facet, value, n) of the first page's request (none with a cursor); unknown names are left out, a missing score counts as lowest."""
    known = {k: F.coalesce(L.icp_bucket(F.col("icp_score")), F.lit("0-39")) if k == "icp_bucket" else F.col(k) for k in names if k in BUCKET_FACETS}
    out = L.facets(docs, known, limit=None)
    return out.limit(0) if cursor else out


def labelled_page(page: DataFrame) -> DataFrame:
    """A page's rows with their labels: the primary address of a person is chosen among the page's own rows."""
    return L.labelled(page)
