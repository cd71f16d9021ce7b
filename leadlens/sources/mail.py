"""Raw mail: messages as rows of decoded parts, and what delivery reports in them say."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import emails as em
from leadlens.functions import status

#: Headers that name who a message didn't reach; the beginning of addresses that bounces come back to; what such a message is put down as.
RECIPIENT_HEADERS = ("final-recipient", "original-recipient", "x-orig-recipient", "x-original-to", "delivered-to")
RETURN_PREFIX = "bounce+"
REASON = "seed_bounce"
PARTS = "id string, part int, depth int, kind string, headers map<string,string>, text string"


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(id, raw) of the message files below a folder; id: the file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("content").alias("raw"))


def _text(part: email.message.Message) -> str:
    """A text part's content: transfer encoding undone, bytes that its charset lacks left out; an unknown charset counts as UTF-8."""
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", errors="ignore")
    except LookupError:
        return raw.decode("utf-8", errors="ignore")


def _walk(part: email.message.Message, depth: int = 0) -> Iterator[tuple[int, email.message.Message]]:
    """A message and its parts, messages within messages and the blocks of delivery reports too, in their order."""
    yield depth, part
    if part.is_multipart():
        for inner in part.get_payload():
            yield from _walk(inner, depth + 1)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, raw in zip(batch["id"], batch["raw"]):
            whole = email.message_from_bytes(bytes(raw or b""), policy=email.policy.compat32)
            for n, (depth, part) in enumerate(_walk(whole)):
                kind = part.get_content_type()
                headers = {k.lower(): " ".join(str(v).split()) for k, v in reversed(part.items())}
                rows.append((key, n, depth, kind, headers, _text(part) if kind.startswith("text/") and not part.is_multipart() else None))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.replace("map<string,string>", "map").split(", ")])


def parts(mails: DataFrame) -> DataFrame:
    """``PARTS`` of messages (id, raw: binary): each part with its headers (the first of a name), text parts decoded. A null or broken message has one part."""
    return mails.select(F.col("id").cast("string").alias("id"), F.col("raw").cast("binary").alias("raw")).mapInPandas(_parts, PARTS)


def reports(mails: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """id, code, reason, hard, recipients, tokens of each message (id, raw).

    Recipients are addresses in the headers that name them and in decoded texts,
    without those to ignore and those that bounces come back to; tokens are what
    these carry. hard is null if nothing tells a report from other mail.
    """
    own = parts(mails)
    named = F.filter(F.transform(F.array(*map(F.lit, RECIPIENT_HEADERS)), lambda h: F.col("headers")[h]), lambda v: v.isNotNull())
    status_lines = F.concat_ws("\n", F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    said = own.select("id", "part", F.concat_ws("\n", F.array_join(named, "\n"), F.coalesce("text", F.lit(""))).alias("named"), F.concat_ws("\n", status_lines, F.coalesce("text", F.lit(""))).alias("all"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c]), "\n")  # noqa: E731  (parts of one message)
    g = said.groupBy("id").agg(joined("named").alias("named"), joined("all").alias("all"))
    code, why = status.dsn_code(F.col("all")), status.dsn_reason(F.col("all"))
    found = em.extract(F.col("named"))
    back = lambda a: a.startswith(RETURN_PREFIX)
    ours: Column = F.array(*map(F.lit, [a.lower() for a in ignore])) if ignore else F.array().cast("array<string>")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("all"), F.lit(r"\bbounce\+([a-z0-9._-]+)@"), F.lit(1)))
    return g.select("id", code.alias("code"), why.alias("reason"), F.when(code.isNotNull() | why.isNotNull(), status.hard_bounce(code, why)).alias("hard"), F.array_sort(F.filter(found, lambda a: ~back(a) & ~F.array_contains(ours, a))).alias("recipients"), F.array_sort(tokens).alias("tokens"))


def suppressed(found: DataFrame) -> DataFrame:
    """(email, reason, source) of reports' recipients, once each."""
    return found.select(F.explode("recipients").alias("email")).distinct().select("email", F.lit(REASON).alias("reason"), F.lit("bounce_monitor").alias("source"))
