"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, exact sets decide.

SimHash links of two bits reach little beyond exact copies (at similarity 0.8
two fingerprints differ in about ten of 64 bits, further than anchors can cover)
and now and then join texts that aren't alike, so they are candidates here, among
others. Texts whose sets of five-word shingles are equal are one class, and
classes that agree in all ``ROWS`` MinHash values of one of ``BANDS`` bands are
candidates (at similarity 0.8, 1 - (1 - 0.8**5)**25 = 0.99995 of the pairs).
Whether a candidate counts is told by the two whole sets (64-bit hashes of the
shingles), not by the MinHash values.

Each class is first compared with the least of its bucket, then with the others
there that are not yet connected to it. In a bucket beyond ``CROWD`` classes that
second look is an exact set join with prefix, size and position filters over all
classes of such buckets: shingles are put in the order of their rarity, and two
sets of the wanted similarity share one of their first ones (of the smaller set,
the first ninth). For each shingle, classes of its commonest component are looked
up by the others only, never by each other, so a large group costs its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm import graph
from leadlens.llm.common import blocks, code_points, column, materialize, maybe_broadcast, mix, shingle_hashes, texts, words_of

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: Classes of a bucket that are all compared with each other; larger ones go by the prefix join.
CROWD = 32
#: Candidate classes (one long each) up to which they are broadcast.
CLASSES = 500_000
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(rows: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and each row's start (plus the end); a row without words has the hash of its stripped text."""
    flat, starts = code_points(rows)
    _, _, _, hashes, first = words_of(flat, starts)
    h, row = shingle_hashes(hashes, first, width)
    bare = np.flatnonzero(np.diff(first) == 0)
    if len(bare):
        own = [int.from_bytes(hashlib.blake2b(rows[k].strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in bare]
        h, row = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([row, bare])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(rows) + 1))


def _classes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    size = np.diff(starts).astype(np.uint64)
    return mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1]) + size)


def signatures(docs: DataFrame, code: Callable[[str], int], width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, fp, class, size, bands) of every row; mark: xxhash64 of the text, fp: ``code`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own = texts(batch)
            h, starts = _sets(own, width)
            fps = np.array([code(x) for x in own], np.uint64).view(np.int64)
            keys = []
            for band in range(BANDS):
                key = np.full(batch.num_rows, np.uint64(band + 1))
                for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(h ^ seed), starts[:-1]))
                keys.append(key)
            flat = np.stack(keys, 1).ravel().view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "mark"), pa.array(fps), pa.array(_classes(h, starts).view(np.int64)), pa.array(np.diff(starts)), bands], ["doc_id", "mark", "fp", "class", "size", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, fp long, class long, size long, bands array<long>")


def _shingles(docs: DataFrame, width: int) -> DataFrame:
    """(class, set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            h, starts = _sets(texts(batch), width)
            yield pa.RecordBatch.from_arrays([pa.array(_classes(h, starts).view(np.int64)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h.view(np.int64)))], ["class", "set"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "class long, set array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets have the threshold's similarity."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    sets = materialize(_shingles(docs, width).join(maybe_broadcast(wanted, CLASSES), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set")))
    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    # shared / (all - shared) >= threshold, without division
    near = shared >= F.lit(threshold) * (F.size("sa") + F.size("sb") - shared)
    return materialize(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(near).select("a", "b"))


def _prefix_pairs(docs: DataFrame, crowd: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of different roots, among all those of ``crowd`` (class, size, root), that may reach the threshold; none that does is missing."""
    wanted = crowd.select("class")
    sets = _shingles(docs, width).join(maybe_broadcast(wanted, CLASSES), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))
    each = materialize(sets.select("class", F.explode("set").alias("shingle")))
    common = each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    ranked = each.join(common, "shingle", "left").withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy(F.coalesce("held", F.lit(1)), "shingle")) - 1)
    # the first common shingle leaves enough of both sets behind it
    need = lambda share, size: F.ceil(F.lit(share) * size - 1e-9)
    rows = ranked.where("held is not null").join(crowd, "class").where(F.col("at") <= F.col("size") - need(threshold, F.col("size")))
    rows = materialize(rows.select("shingle", "class", "size", "root", "at"))
    share = 2 * threshold / (1 + threshold)
    by_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    most = by_root.groupBy("shingle").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    rows = materialize(rows.join(most, "shingle"))
    few = rows.where("root <> main").select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("class", "size", "root", "at")))
    less = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("class") < F.col("class_b")))
    low, at_low, high = F.least("size", "size_b"), F.when(less, F.col("at")).otherwise(F.col("at_b")), F.greatest("size", "size_b")
    behind = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    met = (F.col("root") != F.col("root_b")) & (low >= F.lit(threshold) * high) & (at_low <= low - need(share, low)) & (behind >= need(share / 2, low + high))
    return rows.join(few, "shingle").where(met).select(F.least("class", "class_b").alias("a"), F.greatest("class", "class_b").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame, likely: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between classes that connect the near copies found; all verified. ``likely``: candidates beside the bands'."""
    classes = signed.groupBy("class").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    spread = classes.select("class", "size", F.explode("bands").alias("key"))
    buckets = materialize(spread.groupBy("key").agg(F.count("*").alias("n"), F.min_by("size", "class").alias("least_size"), F.min("class").alias("least")).where("n > 1"))
    met = materialize(spread.join(buckets, "key"))
    alike = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)
    stars = met.where((F.col("class") != F.col("least")) & alike(F.col("size"), F.col("least_size"))).select(F.col("least").alias("a"), F.col("class").alias("b"))
    stars = materialize(stars.union(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    found = _verified(docs, stars, width, threshold)
    roots = graph.connected_components(found).select(F.col("node").alias("class"), "root")
    rooted = met.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).select("key", "class", "size", "root", "n")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    some = materialize(rooted.join(open_, "key", "left_semi"))
    calm = some.where(F.col("n") <= CROWD).drop("n")
    other = calm.select("key", F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    rest = calm.join(other, "key").where((F.col("class") < F.col("b")) & (F.col("root") != F.col("root_b")) & alike(F.col("size"), F.col("size_b"))).select(F.col("class").alias("a"), "b").distinct()
    crowd = materialize(some.where(F.col("n") > CROWD).select("class", "size", "root").distinct())
    if not crowd.isEmpty():
        rest = rest.union(_prefix_pairs(docs, crowd, width, threshold)).distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"))
    return materialize(found.union(_verified(docs, rest, width, threshold)))
