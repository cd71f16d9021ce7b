"""Importance resampling of documents towards a target's word distribution.

Words are hashed to buckets; a bucket's gain tells how much commoner it is in
the target than in the corpus. A document's words never leave its row: higher-
order functions turn the text into an array of buckets and add the gains found
in one literal array, so the scan stays a map. Only bucket totals are shuffled
(at most ``BUCKETS`` a task), and the 40 bytes a document that ranking needs.

The draw is the Gumbel top-k: a document's weight plus noise hashed from its id.
Scores are whole numbers in a narrow range, so a histogram gives the cut and the
rank at which each score begins; the exact rank is counted among equal scores
only. The noise spreads scores, whatever the documents: about 0.04 % of them
share one. Rows that agree in all columns are one row with a count there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import materialize, maybe_broadcast
from leadlens.llm.duck import CRC_TABLE, crc32

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Between words: ASCII but for digits and (after lowering) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of a row that one array spans when they are told apart again.
SPAN = 1 << 16


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), "")


def features(own: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to ``longest`` of the words, joined by a space."""
    if longest == 1:
        return own
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.array_join(F.slice(own, i, n), " "))
    return F.concat(own, *(F.when(F.size(own) >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest + 1)))


def bucketed(table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``table`` (doc_id, text) as doc_id, n_words, buckets (int array, one a feature)."""
    own = table.select("doc_id", words(F.col("text")).alias("words"))
    return own.select("doc_id", F.size("words").alias("n_words"), F.transform(features(F.col("words"), longest), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")).alias("buckets"))


def totals(table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> dict[int, int]:
    """Features of each bucket: at most ``buckets`` numbers, summed in the tasks first."""
    of = bucketed(table.select(F.lit(0).alias("doc_id"), "text"), buckets, longest).select(F.explode("buckets").alias("bucket"))
    return {r["bucket"]: r["n"] for r in of.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * log ratio of the smoothed shares) of each bucket."""
    all_source, all_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * all_source / (float(source.get(b, 0) + 1) * all_target))) for b in range(buckets)]


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row: one map over the texts."""
    held = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    own = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), len(gain), longest)
    own = own.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(held, b + 1)).alias("sum"))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return own.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def draw(table: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` rows with the rank of those drawn (null for the others). ``table`` is read several times."""
    fit = table.where(F.col("n_words") >= least_words)
    histogram = sorted(fit.groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)  # whole numbers of a narrow range
    quota = sum(r["n"] for r in histogram) * percent // 100
    begins, before = [], 0
    for r in histogram:
        if before >= quota:
            break
        begins.append((r["score"], before))
        before += r["n"]
    names = ["doc_id", "n_features", "weight", "score"]
    if not begins:
        return table.select(*names, F.lit(None).cast("long").alias("rank"))
    reached = (F.col("n_words") >= least_words) & (F.col("score") >= begins[-1][0])
    start = table.sparkSession.createDataFrame(begins, "score long, before long")
    some = table.where(reached).groupBy(*names).agg(F.count("*").alias("n")).join(maybe_broadcast(start, 200_000), "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("first", F.col("before") + F.sum("n").over(order) - F.col("n") + 1).withColumn("last", F.col("first") + F.col("n") - 1)
    spans = some.withColumn("from", F.explode(F.sequence("first", "last", F.lit(SPAN).cast("long"))))
    ranked = spans.withColumn("rank", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (SPAN - 1), F.col("last")))))
    ranked = ranked.select(*names, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    return ranked.union(table.where(~reached).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text); rank: 1, 2, ... of the ``percent`` drawn.

    ``target``: a table with text. Null texts have no words; a document without
    features weighs 0. Documents under ``least_words`` are never drawn. Equal
    scores rank by doc_id, nulls last (a null's noise is that of an empty id);
    rows that repeat a doc_id are ranked each, those equal in all results in any
    order. Other columns are ignored; an empty ``docs`` gives an empty result,
    an empty target gains of its smoothing alone.
    """
    gain = gains(totals(docs, buckets, longest), totals(target, buckets, longest), buckets)
    return draw(materialize(scored(docs, gain, longest, seed)), percent, least_words)

ORACLE = f"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', 0, NULL, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') FROM benchmark),
used AS (SELECT side, row, unnest(ws) AS w FROM texts),
named AS (SELECT w, {crc32("w")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT w FROM used), crc_table),
counted AS (SELECT side, row, bucket, count(*) AS n FROM used JOIN named USING (w) GROUP BY ALL),
per AS (SELECT b.i AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM range({BUCKETS}) b(i) LEFT JOIN counted ON counted.bucket = b.i GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM per) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM per) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM per),
weighed AS (SELECT row, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total FROM counted JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
scores AS (
  SELECT doc_id, row, len(ws)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN weighed USING (row) WHERE side = 'd'),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scores),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS all_ FROM final WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * all_ // 100 THEN k END::BIGINT AS rank
FROM final LEFT JOIN ranked USING (row)
"""
