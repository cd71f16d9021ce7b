"""Line dedup by a log-template tree.

A fixed-depth parse sends each line down three levels: its token count, its
leading tokens, and the constants that recur in that leaf. Tokens with digits
are variable fields from the start; in a leaf, a token that fewer than
``MIN_DOCS`` documents have at its place is a variable field too. What remains
of a line is its template. A template with enough constants that recurs in at
least ``MIN_DOCS`` documents is boilerplate: its lines are dropped from every
document but the first (smallest doc_id), so the text survives once.

That is op5, as its SQL has it. The pipeline's stage (``drop_lines``) also drops
lines that recur byte for byte, whatever their tokens are, and takes two
documents as recurrence for these and for templates of ``LONG`` tokens; three
remain for identical lines under ``MIN_TOKENS`` and for shorter templates.

The tree is never held anywhere: levels are grouped counts. Only leaves met in
several documents go on to the second count, and equal lines are one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import fresh, materialize, maybe_broadcast

#: Lines with fewer tokens are never dropped; tokens of a path; documents of a recurring template; least share of constants.
MIN_TOKENS, LEAD, MIN_DOCS, CONSTANT = 5, 3, 3, 0.75
#: The stage's rules: identical lines of MIN_TOKENS and templates of LONG tokens recur by so many documents.
LONG, TWO = 50, 2
FIELD = "<*>"
BLANK = r"[ \t\x0B\f\r]+"
#: Leaves (one long each) up to which they are broadcast: some 10 MB as a hashed relation.
LEAVES = 200_000


def tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*", FIELD)).otherwise(line)
    return F.filter(F.split(masked, BLANK), lambda x: x != "")


def _lines(docs: DataFrame, min_tokens: int, lead: int) -> DataFrame:
    """doc_id, mark (hash of the text), line_no, parts, leaf of every line that is long enough."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parted = keyed.select("doc_id", "mark", "line_no", tokens(F.col("line")).alias("parts")).where(F.size("parts") >= min_tokens)
    return parted.withColumn("leaf", F.xxhash64(F.size("parts"), *[F.col("parts")[k] for k in range(lead)]))


def recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS, lead: int = LEAD, min_docs: int = MIN_DOCS, constant: float = CONSTANT, constants: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, mark, gone array<int>): the lines to drop of each document that has any.

    constants: how many a template has at least.

    ``docs``: doc_id long, text string. mark: xxhash64 of the text, which tells rows of one doc_id apart.
    """
    lines = _lines(docs, min_tokens, lead)
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where((F.col("n") >= min_docs) & (F.col("a") < F.col("b"))).select("leaf")
    leaves = maybe_broadcast(materialize(leaves), LEAVES)
    met = lines.join(leaves, "leaf").select("leaf", F.array_join("parts", " ").alias("line"), "doc_id", "mark", "line_no")
    met = materialize(met.withColumn("same", F.xxhash64("line")))
    classes = met.groupBy("leaf", "same", "line", "doc_id").agg(F.count("*").alias("n")).groupBy("leaf", "same", "line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    classes = materialize(classes)
    # a leaf that only one document and line has can't make a template
    live = classes.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    live = maybe_broadcast(materialize(live), LEAVES)
    wide = classes.join(live, "leaf", "left_semi").select("leaf", "same", "docs", "first", F.posexplode(F.split("line", " ")).alias("place", "token"))
    support = wide.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs).withColumn("fixed", F.col("token") != FIELD)
    told = wide.join(support, ["leaf", "place", "token"], "left")
    # a template is known by its constants' places and values: order-free sums of their hashes
    parsed = told.groupBy("leaf", "same", "docs", "first").agg(
        F.count("*").alias("n"),
        F.count_if("fixed").alias("constants"),
        F.sum(F.when(F.col("fixed"), F.xxhash64("place", "token")).otherwise(F.xxhash64("place")).cast("decimal(38,0)")).alias("template"),
    )
    parsed = materialize(parsed.where(F.col("constants") >= F.greatest(F.lit(constants), F.col("n") * F.lit(constant))))
    templates = parsed.groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)
    known = parsed.select("leaf", "same", "template").join(templates.select("leaf", "template", "first"), ["leaf", "template"]).select("leaf", "same", "first")
    known = maybe_broadcast(materialize(known))
    hits = met.select("leaf", "same", "doc_id", "mark", "line_no").join(known, ["leaf", "same"]).where("doc_id > first")
    return materialize(hits.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone")))


def repeated(docs: DataFrame, min_docs: int = TWO, short_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, gone array<int>): lines that ``min_docs`` documents or more have byte for byte.

    Any line with a letter or digit counts, however many of its tokens hold
    digits; those of fewer than ``MIN_TOKENS`` tokens need ``short_docs``
    documents. Lines are told apart by 96 bits of hashes.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = keyed.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "mark", "line_no", F.xxhash64("line").alias("same"), F.hash("line").alias("also"), (F.size(tokens(F.col("line"))) < MIN_TOKENS).alias("short"))
    # a document counts a line once; both levels combine before their shuffle
    met = lines.select("same", "also", "short", "doc_id").distinct().groupBy("same", "also", "short").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    known = maybe_broadcast(materialize(met.where(F.col("docs") >= F.when(F.col("short"), short_docs).otherwise(min_docs)).select("same", "also", "first")), LEAVES)
    hits = lines.join(known, ["same", "also"]).where("doc_id > first")
    return materialize(hits.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone")))


def _without(docs: DataFrame, identical: bool, **options) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with columns of its own names added, and of it: the text left, its lines before, and those dropped."""
    id_, text_, mark_, gone_ = fresh(docs, "_id", "_text", "_mark", "_gone")
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), text_: F.col("text").cast("string")})
    plain = own.select(F.col(id_).alias("doc_id"), F.col(text_).alias("text"))
    gone = recurring(plain, **options)
    if identical:
        gone = gone.union(repeated(plain)).union(recurring(plain, min_tokens=LONG, min_docs=TWO)).groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_), F.col("gone").alias(gone_)).hint("merge")  # grows with the corpus: one shuffle of it at any size
    all_ = own.withColumn(mark_, F.xxhash64(text_)).join(gone, [id_, mark_], "left")
    split = F.split(text_, "\n")
    left = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(gone_, i)), "\n"))
    lines = F.when(F.col(text_).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    return all_, left, lines, F.coalesce(F.array_size(gone_), F.lit(0)).cast("long")


def dedup(docs: DataFrame, identical: bool = False, **options) -> DataFrame:
    """``docs`` with recurring lines removed from text, and n_lines and n_dropped added (in place of columns so called).

    identical: lines that recur byte for byte go too (``repeated``), and those of
    templates of ``LONG`` tokens that two documents have, beside those of templates.

    All other columns of ``docs`` (doc_id, text and any more) are kept; rows without
    doc_id or text stay as they are (no line of theirs counts). Two rows of
    one doc_id and text are treated alike. A text may become empty; its row stays.
    An empty table gives an empty result. Leading tokens, counts and thresholds are as in ``recurring``.
    """
    all_, left, lines, dropped = _without(docs, identical, **options)
    kept = [left.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return all_.select(*kept, lines.alias("n_lines"), dropped.alias("n_dropped"))


def op5(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines, identical ones included, removed and n_chars (if there is one) brought up to date.

    Every column is kept, whatever its name, and every row: rows without doc_id
    or text as they are, repeated rows alike, a text of dropped lines only as an
    empty one. Of a line that recurs the document with the smallest doc_id keeps it (rows that share that id all keep it).
    An empty table gives an empty result.
    """
    all_, left, _, dropped = _without(docs, True)
    counted = F.when(dropped > 0, F.length(left).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return all_.select(*[left.alias(c) if c == "text" else counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS parts FROM l),
t AS (SELECT *, len(parts) AS n, parts[1:3] AS lead FROM p WHERE len(parts) >= 5),
leaf AS (SELECT n, lead FROM t GROUP BY n, lead HAVING count(*) >= 3 AND min(doc_id) < max(doc_id)),
c AS (SELECT n, lead, parts, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM t JOIN leaf USING (n, lead) GROUP BY n, lead, parts),
w AS (SELECT *, unnest(parts) AS token, unnest(range(len(parts))) AS place FROM c),
s AS (SELECT n, lead, place, token FROM w GROUP BY n, lead, place, token HAVING sum(docs) >= 3),
f AS (
  SELECT w.n, w.lead, w.parts, any_value(w.docs) AS docs, any_value(w.first) AS first,
    list(CASE WHEN s.token IS NULL OR w.token = '<*>' THEN NULL ELSE w.token END ORDER BY w.place) AS template,
    count(s.token) FILTER (w.token <> '<*>') AS constants
  FROM w LEFT JOIN s ON w.n = s.n AND w.lead = s.lead AND w.place = s.place AND w.token = s.token
  GROUP BY w.n, w.lead, w.parts),
g AS (SELECT n, lead, template, min(first) AS first FROM f WHERE constants >= greatest(5, 0.75 * n) GROUP BY n, lead, template HAVING sum(docs) >= 3),
k AS (SELECT f.parts, g.first FROM f JOIN g ON f.n = g.n AND f.lead = g.lead AND f.template = g.template WHERE f.constants >= greatest(5, 0.75 * f.n)),
d AS (SELECT t.doc_id, t.line_no FROM t JOIN k ON t.parts = k.parts WHERE t.doc_id > k.first),
a AS (SELECT doc_id, list(line_no) AS gone FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '')
    ELSE array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]), chr(10)) END) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""
