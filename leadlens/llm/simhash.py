"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two 32-bit halves are looked at in turn. The anchors of a half
are the code words of the perfect (31, 26) Hamming code on its low 31 bits:
every point lies within covering radius 1 of exactly one anchor, its home. Two
fingerprints that differ in at most two bits differ in at most one bit in one
of the halves; there, the home of one lies within 1 + 1 of the other. So each
fingerprint goes to every anchor within two bits (16 of them, or only itself
if it is a code word), and comparisons happen per anchor, exactly. An anchor
with more than ``CROWD`` fingerprints is not compared in one task: its members
go to the finer anchors of the whole space (each point and its 64 neighbours,
where two points that share an anchor are within two bits by construction), so
no group exceeds 65 members however dense the data are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm import graph, near_copies
from leadlens.llm.common import column, fresh, materialize, maybe_broadcast

WIDTH, SEED = 3, 42
#: Members beyond which an anchor is split over finer anchors.
CROWD = 2048
#: A hash block: bounds the unpacked bits to 64 * this many bytes.
HASHES = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one text; zero without words."""
    flat = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not flat:
        return 0
    n = len(flat) - width + 1
    digest = xxhash.xxh64_intdigest
    if n < 1:
        hashes = np.array([digest(b" ".join(flat), seed)], np.uint64)
    else:
        joined = b" ".join(flat)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
        begins = np.concatenate([[0], ends[: n - 1]]).tolist()
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(begins, (ends[width - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES):
        part = hashes[k : k + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > len(hashes)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs`` (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the input, anchor and whether it is the home, for uint64 points of 31 bits."""
    syndrome = np.zeros(len(half), np.uint64)
    for bit in range(31):
        syndrome ^= ((half >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    one = np.uint64(1)
    home = half ^ np.where(syndrome > 0, one << (syndrome - (syndrome > 0).astype(np.uint64)), np.uint64(0))
    at, out, is_home = [np.arange(len(half))], [home], [np.ones(len(half), bool)]
    for i in range(1, 32):
        other = np.uint64(i) ^ syndrome
        good = np.flatnonzero((syndrome > 0) & (other > np.uint64(i)))
        at.append(good)
        out.append(half[good] ^ (one << np.uint64(i - 1)) ^ (one << (other[good] - one)))
        is_home.append(np.zeros(len(good), bool))
    return np.concatenate(at), np.concatenate(out), np.concatenate(is_home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for side in (0, 1):
            at, anchor, home = _anchors((fps >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(side << 31)).view(np.int64)), pa.array(fps[at].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _spanning(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (at most one fewer than the members) that connect what is within two bits, in blocks."""
    left = np.arange(len(fps))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            near = np.bitwise_count(fps[left] ^ fps[node]) <= 2
            found = left[near]
            if len(found):
                yield np.full(len(found), fps[node]), fps[found]
                frontier, left = np.concatenate([frontier, found]), left[~near]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor's rows may go on in the next batch."""
    small = 8

    def pairs(anchor: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(anchor)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
        size = end - begin
        run = np.repeat(size, size)
        a, b = [], []
        for d in range(1, small):
            i = np.flatnonzero((anchor[:-d] == anchor[d:]) & (run[:-d] <= small)) if len(anchor) > d else np.zeros(0, np.int64)
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= 2]
            a.append(fps[i])
            b.append(fps[i + d])
        for k in np.flatnonzero(size > small):
            for x, y in _spanning(fps[begin[k] : end[k]]):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    kept = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.concatenate([kept[0], column(batch, "anchor").to_numpy()])
        fps = np.concatenate([kept[1], column(batch, "fp").to_numpy().view(np.uint64)])
        last = int(np.searchsorted(anchor, anchor[-1]))
        kept = (anchor[last:], fps[last:])
        if last:
            yield pairs(anchor[:last], fps[:last])
    if len(kept[0]):
        yield pairs(*kept)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fps = column(batch, "fp").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((fps[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fps, 65).view(np.int64))], ["z", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints, enough to connect all that are within two bits.

    ``distinct``: one column fp, no repeats. Every pair within two bits is
    compared at some anchor; per anchor, only links that join parts not yet
    connected are kept, so a dense group yields no pair list.
    """
    spread = distinct.mapInArrow(_replicate, "anchor long, fp long, home boolean")
    crowded = materialize(spread.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"))
    few = maybe_broadcast(crowded)
    calm = spread.join(few, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    near = calm.mapInArrow(_compare, "a long, b long")
    dense = spread.join(few, "anchor", "left_semi").select("fp").distinct().mapInArrow(_neighbours, "z long, fp long")
    least = dense.groupBy("z").agg(F.min("fp").alias("a"), F.sort_array(F.collect_set("fp")).alias("all"))  # 65 at most
    finer = least.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return near.union(finer).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id: the smallest doc_id reachable by links of at most two bits,
    the row's own included. Empty or null texts have fingerprint zero and link
    like any other. A null doc_id keeps its row and never is a component_id
    unless all ids of the component are null. Repeated rows give a row each;
    other columns are ignored; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = graph.connected_components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(ids, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, component_id) for every row: components of texts at ``near_copies``' similarity, found by two bits or by its bands.

    mark: xxhash64 of the text. component_id: a value of the component's own, no
    doc_id: two components may hold rows of one doc_id.
    """
    signed = materialize(near_copies.signatures(docs, fingerprint))
    held = materialize(signed.select("fp", "class").distinct())
    least = materialize(held.groupBy("fp").agg(F.min("class").alias("least")))
    same = held.join(least, "fp").select(F.col("least").alias("a"), F.col("class").alias("b")).where("a <> b")
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab"]
    close = links(least.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    likely = materialize(same.union(close.where("a <> b")).distinct())
    roots = graph.connected_components(near_copies.links(docs, signed, likely))
    rooted = signed.join(roots.withColumnRenamed("node", "class"), "class", "left")
    return rooted.select("doc_id", "mark", F.coalesce("root", "class").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest doc_id, and of its texts the one of least hash.

    Near copies: a Jaccard similarity of five-word shingles of 0.8 or more, told
    by the whole sets; links go on from text to text. Rows are
    told apart by doc_id and text, so rows that repeat a doc_id with different
    texts are decided each by its own group. Rows without a doc_id can't be
    named by a component and stay.
    """
    id_, mark_ = fresh(docs, "_id", "_mark")
    found = materialize(near_copies_of(docs).where("doc_id is not null"))
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    gone = found.join(best, "component_id").where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("mark") != F.col("best.mark"))).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).distinct()
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), mark_: F.xxhash64(F.col("text").cast("string"))})
    kept = own.join(maybe_broadcast(materialize(gone)), [id_, mark_], "left_anti")
    if not found.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.where(F.col(id_).isNotNull()).dropDuplicates([id_, mark_]).union(kept.where(F.col(id_).isNull()))
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
