"""Substring dedup by a compacted De Bruijn graph of word k-mers.

Edges are runs of ``EDGE`` words. Of the edges that lie in a window of ``WINDOW``
words the least by hash is taken (ties: the first), so equal windows take the same
one and about one edge in 13 is in the graph; a document's first and last edge are
taken too. Edges next to each other in a document are at most ``WINDOW - EDGE + 1``
words apart, no more than an edge is long, so they overlap and leave no word out.

Grouped by edge, Spark counts who follows and who precedes it. An edge that occurs
in two documents goes back to its places by a join, with its least document (its
source) and whether its successor and its predecessor are the same everywhere.
Where both ends of a link say so the link doesn't branch, and places so linked are
compacted to a path: a span of the document. Every place of such a path is whole,
so a window inside it occurs wherever its taken edge occurs, and the source
decides for it. Windows that hang over the end of their edge's path are few;
they are grouped by their own hash, and decide by the least document there.
(An edge's path ends at the same distance everywhere, so a window either lies in
its path in all documents or in none.)

Words are told apart by 128 bits, edges and windows too; a text's order is never
lost, since all spans are places in documents. No group is gathered but a
document's own spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, materialize, mix

WINDOW, EDGE = 50, 26
#: Edges of a window.
CHOICE = WINDOW - EDGE + 1
#: Words of a segment, about, and words beside it that it also sees.
SEGMENT, MARGIN = 150_000, 128
#: Distinct words whose hashes a worker remembers; then it starts anew.
REMEMBERED = 400_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the two lanes.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NONE = np.uint64(0)


def slices(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        if end < len(raw):
            found = SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


class Lexicon:
    """128-bit hashes of words, as two arrays, remembered for a bounded number of words."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash = np.zeros((0, 2), np.uint64)

    def lanes(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.reset()
        new = list(set(words).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            made = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), "<u8").reshape(-1, 2)
            self.hash = np.concatenate([self.hash, made])
        return self.hash[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


_LEXICON = Lexicon()


def runs(h: np.ndarray, n: int, lane: int) -> np.ndarray:
    """The hash of each ``n`` consecutive elements, by doubling."""
    out, have = None, 0
    part, size = h, 1
    while True:
        if n & 1:
            k = max(len(h) - have - size + 1, 0)
            out = part if out is None else out[:k] * np.uint64(pow(LANES[lane], size, 1 << 64)) + part[have : have + k]
            have += size
        n >>= 1
        if not n:
            return mix(out[: max(len(h) - have + 1, 0)])
        k = max(len(part) - size, 0)
        part = part[:k] * np.uint64(pow(LANES[lane], size, 1 << 64)) + part[size : size + k]
        size *= 2


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive elements."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


class Segment:
    """Consecutive words of one row: ``own`` of them count here, the others are seen."""

    __slots__ = ("row", "offset", "words", "own", "ends")

    def __init__(self, row: int, offset: int, words: list[bytes], own: tuple[int, int], ends: tuple[bool, bool]):
        self.row, self.offset, self.words, self.own, self.ends = row, offset, words, own, ends


def segments(row: int, raw: bytes) -> Iterator[Segment]:
    """A row's words in segments; one for most rows, none for a row under ``WINDOW`` words."""
    held: list[bytes] = []
    offset, low = 0, 0
    for part in slices(raw):
        held += part.split()
        if len(held) >= SEGMENT + 2 * MARGIN:
            yield Segment(row, offset, held, (low, len(held) - MARGIN), (offset == 0, False))
            offset += len(held) - 2 * MARGIN
            held, low = held[-2 * MARGIN :], MARGIN
    if offset + len(held) >= WINDOW:
        yield Segment(row, offset, held, (low, len(held)), (offset == 0, True))


class Graph:
    """The edges taken of some segments."""

    def __init__(self, parts: list[Segment]):
        self.parts = parts
        flat = [w for s in parts for w in s.words]
        self.lanes = _LEXICON.lanes(flat)
        size = np.array([len(s.words) for s in parts], np.int64)
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        self.edge = [runs(self.lanes[:, k], EDGE, k) for k in (0, 1)]
        place = np.arange(len(self.edge[0]), dtype=np.uint64)
        least = _least((self.edge[0] & ~np.uint64(0xFFFFFF)) | place, CHOICE) & np.uint64(0xFFFFFF)
        count = np.maximum(size - WINDOW + 1, 0)
        self.part = np.repeat(np.arange(len(parts)), count)  # of each window
        self.window = np.repeat(self.begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.taken = least[self.window].astype(np.int64)
        ends = [x for s, b, e in zip(parts, self.begin.tolist(), self.end.tolist()) for x, real in zip((b, e - EDGE), s.ends) if real]
        self.at = np.unique(np.concatenate([self.taken, np.array(ends, np.int64)]))
        self.of = np.searchsorted(self.end, self.at, "right")  # segment of each edge taken

    def own(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        low, high = (np.array([s.own[k] for s in self.parts]) + self.begin for k in (0, 1))
        return (at >= low[of]) & (at < high[of])

    def column(self, values: list) -> np.ndarray:
        """A value of each segment's row, by row."""
        return np.array([values[s.row] for s in self.parts])

    def offsets(self) -> np.ndarray:
        return np.array([s.offset for s in self.parts]) - self.begin


def _graphs(batch: pa.RecordBatch) -> Iterator[Graph]:
    parts, size = [], 0
    for row, raw in enumerate(column(batch, "text").to_pylist()):
        for s in segments(row, raw or b""):
            parts.append(s)
            size += len(s.words)
            if size >= SEGMENT:
                yield Graph(parts)
                parts, size = [], 0
    if parts:
        yield Graph(parts)


EDGES = "x long, y long, before long, after long, doc_id long"
PLACES = "x long, y long, doc_id long, mark long, at long"
WINDOWS = "x long, y long, doc_id long, mark long, at long"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge taken, with a hash of its successor and of its predecessor and their distances (zero: a document's end)."""
    for batch in blocks(batches):
        ids = column(batch, "doc_id").to_pylist()
        for g in _graphs(batch):
            near = g.of[1:] == g.of[:-1]
            gap = np.diff(g.at).astype(np.uint64)
            x, y = (e[g.at] for e in g.edge)
            after, before = np.zeros(len(g.at), np.uint64), np.zeros(len(g.at), np.uint64)
            after[:-1] = np.where(near, mix(x[1:] + y[1:] * gap) | np.uint64(1), NONE)
            before[1:] = np.where(near, mix(x[:-1] + y[:-1] * gap) | np.uint64(1), NONE)
            keep = g.own(g.at, g.of)
            yield _batch(EDGES, x[keep], y[keep], before[keep], after[keep], g.column(ids)[g.of[keep]])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge taken, with its place."""
    for batch in blocks(batches):
        ids, marks = column(batch, "doc_id").to_pylist(), column(batch, "mark").to_pylist()
        for g in _graphs(batch):
            keep = g.own(g.at, g.of)
            of = g.of[keep]
            yield _batch(PLACES, g.edge[0][g.at[keep]], g.edge[1][g.at[keep]], g.column(ids)[of], g.column(marks)[of], g.at[keep] + g.offsets()[of])


def _hanging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their paths -> windows that hang over the end of their edge's path."""
    for batch in blocks(batches):
        ids, marks, lows, highs = (column(batch, c).to_pylist() for c in ("doc_id", "mark", "lows", "highs"))
        for g in _graphs(batch):
            hashes = [runs(g.lanes[:, k], WINDOW, k) for k in (0, 1)]
            hangs = np.zeros(len(g.window), bool)
            edges = np.searchsorted(g.part, np.arange(len(g.parts) + 1))
            for k, s in enumerate(g.parts):
                low, high = (np.sort(np.array(v[s.row], np.int64)) - s.offset + g.begin[k] for v in (lows, highs))
                w, taken = g.window[edges[k] : edges[k + 1]], g.taken[edges[k] : edges[k + 1]]
                i = np.searchsorted(low, taken, "right") - 1
                inside = (i >= 0) & (taken + EDGE <= high[i])
                hangs[edges[k] : edges[k + 1]] = inside & ~((w >= low[i]) & (w + WINDOW <= high[i]))
            on = np.flatnonzero(hangs & g.own(g.window, g.part))
            at, of = g.window[on], g.part[on]
            yield _batch(WINDOWS, hashes[0][at], hashes[1][at], g.column(ids)[of], g.column(marks)[of], at + g.offsets()[of])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        out: list[list] = [[], [], []]
        for raw, lows, highs in zip(*(column(batch, c).to_pylist() for c in ("text", "lows", "highs"))):
            total, gone, kept = 0, 0, []
            if lows:
                order = np.argsort(lows, kind="stable")
                low, high = np.array(lows)[order], np.maximum.accumulate(np.array(highs)[order])
            for part in slices(raw or b""):
                words = part.split()
                if lows:
                    i = np.searchsorted(low, np.arange(total, total + len(words)), "right") - 1
                    stays = (i < 0) | (high[i] <= np.arange(total, total + len(words)))
                    total += len(words)
                    gone += int((~stays).sum())
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                else:
                    total += len(words)
                if words:
                    kept.append(b" ".join(words))
            for held, v in zip(out, (total, gone, b" ".join(kept))):
                held.append(v)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def paths(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, low, high, source): compacted paths of the repeated edges as spans of words, with their least document.

    ``texts``: doc_id, mark, text (binary). Paths that one document alone holds aren't among them.
    """
    ends = [f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("least", F.min), ("most", F.max))]
    met = texts.select("doc_id", "text").mapInArrow(_edges, EDGES).groupBy("x", "y").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), *ends)
    sole = lambda c: ((F.col(f"least_{c}") == F.col(f"most_{c}")) & (F.col(f"least_{c}") != 0)).alias(c)
    edges = materialize(met.where("source < last").select("x", "y", "source", sole("before"), sole("after")))
    found = texts.mapInArrow(_places, PLACES).join(edges, ["x", "y"])
    # rows that repeat with their doc_id put an edge in one place several times
    once = found.groupBy("doc_id", "mark", "at").agg(F.min("source").alias("source"), F.min("before").alias("before"), F.min("after").alias("after"))
    along = Window.partitionBy("doc_id", "mark").orderBy("at")
    linked = F.coalesce(F.lag("after").over(along) & F.col("before"), F.lit(False))
    numbered = once.withColumn("begins", (~linked).cast("int")).withColumn("path", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc_id", "mark", "path").agg(F.min("at").alias("low"), (F.max("at") + EDGE).alias("high"), F.min("source").alias("source")).drop("path")


def spans(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, low, high): spans of words to remove, that windows cover which also start in a smaller doc_id's row."""
    found = materialize(paths(texts))
    own = found.groupBy("doc_id", "mark").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    hanging = materialize(texts.join(own, ["doc_id", "mark"]).mapInArrow(_hanging, WINDOWS))
    first = hanging.groupBy("x", "y").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    later = hanging.join(first, ["x", "y"]).where("source < doc_id").select("doc_id", "mark", F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high"))
    return found.where((F.col("source") < F.col("doc_id")) & (F.col("high") - F.col("low") >= WINDOW)).select("doc_id", "mark", "low", "high").union(later)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (string) for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``WINDOW`` words that covers it also starts in a row
    with a smaller doc_id; rows of one doc_id don't remove from each other. Null
    text has no words; a null doc_id is neither smaller nor larger, its rows stay
    whole; repeated rows have a row each; other columns are ignored; an empty
    table gives an empty result. Kept words are joined by a space.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    long = own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1))
    gone = spans(long).distinct().groupBy("doc_id", "mark").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    return own.join(gone, ["doc_id", "mark"], "left").select("doc_id", "text", "lows", "highs").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op13(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
