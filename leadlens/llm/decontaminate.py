"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct five-word shingles, classes
bounded by powers of two). MinHash orders an item's shingles by a random hash;
its signature is the k smallest values. A class with upper bound u gets the
sketch length that the threshold t implies for its largest members,
k = u - ceil(t * u) + 1: a document that contains at least t of an item misses
fewer than k of its shingles, so whatever the document's length, it holds one
of the k smallest hashes of the item. Documents, however long, are streamed
once past the index of sketch values (no signature of a document is needed, so
length costs no recall), and each (document, item) found there is verified by
counting the item's exact shingle strings in the document.

An item of fewer than five words is one shingle of its own width: the classes
of sizes below five look for that run of words anywhere in a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, code_points, column, materialize, maybe_broadcast, shingle_hashes, texts, words_of

WIDTH, THRESHOLD = 5, 0.8
#: Items that one pass over the documents looks for; a larger benchmark takes several passes.
ITEMS_A_PASS = 20_000
#: Benchmark text bytes of one pass at most, by splitting further.
BYTES_A_PASS = 16 << 20
#: Bits of the table that tells most shingles at once to be in no sketch.
FILTER_BITS = 22

SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def _words(text: str) -> list[str]:
    flat, starts = code_points([text])
    low, begin, end, _, _ = words_of(flat, starts)
    return ["".join(map(chr, low[s:e])) for s, e in zip(begin, end)]


def shingles(text: str, width: int = WIDTH) -> set[str]:
    """Distinct word shingles; fewer words than ``width``: the whole sequence, no words: none."""
    words = _words(text)
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


class Index:
    """Sketches of the items of one pass."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.items = [(i, s) for i, t in items if (s := shingles(t, width))]
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}  # by words of a shingle
        for at, (_, own) in enumerate(self.items):
            flat, starts = code_points(sorted(own))
            _, _, _, words, first = words_of(flat, starts)
            size = min(width, int(first[1]))
            hashes = np.unique(shingle_hashes(words, first, size)[0])
            bound = 1 << max(len(own) - 1, 0).bit_length()  # of the size class
            parts.setdefault(size, []).append((at, hashes[: bound - math.ceil(threshold * bound) + 1]))
        self.classes = []
        for size, sketches in sorted(parts.items()):
            values = np.concatenate([x for _, x in sketches])
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.classes.append((size, values[order], np.concatenate([np.full(len(x), at) for at, x in sketches])[order], np.packbits(seen)))

    def candidates(self, rows: list[str]) -> set[tuple[int, int]]:
        flat, starts = code_points(rows)
        _, _, _, hashes, first = words_of(flat, starts)
        out: set[tuple[int, int]] = set()
        for size, values, owners, seen in self.classes:
            h, row = shingle_hashes(hashes, first, size, short=False)
            key = h >> np.uint64(64 - FILTER_BITS)
            hit = np.flatnonzero((seen[(key >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (key & np.uint64(7)).astype(np.uint8))) & 1)
            h, row = h[hit], row[hit]
            lo, hi = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
            out |= {(int(r), int(owners[k])) for r, a, b in zip(row[hi > lo], lo[hi > lo], hi[hi > lo]) for k in range(a, b)}
        return out

    def matches(self, rows: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """Row, item_id, the item's distinct shingles, those that the row holds."""
        own: tuple[int, set[str], str] = (-1, set(), "")
        for r, at in sorted(self.candidates(rows)):
            if own[0] != r:
                own = (r, shingles(rows[r], self.width), f" {' '.join(_words(rows[r]))} ")
            item, need = self.items[at]
            only = next(iter(need))
            short = only.count(" ") + 1 < self.width
            shared = int(f" {only} " in own[2]) if short else len(need & own[1])
            if shared >= self.threshold * len(need) - 1e-9:
                yield r, item, len(need), shared


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) where a document contains at least ``threshold`` of an item's shingles.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored.
    Words are runs of letters and digits, lower case. An item of fewer than
    ``width`` words is one shingle, its whole sequence, and is contained where
    these words stand together; texts without words (null, empty) match nothing.
    Repeated documents or items each give their rows; a null id stays null. An
    empty table on either side gives an empty result. A benchmark beyond
    ``ITEMS_A_PASS`` items or ``BYTES_A_PASS`` bytes is searched in blocks, so what is sent
    to the executors at once stays bounded.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(n / ITEMS_A_PASS), math.ceil(size / BYTES_A_PASS))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], width, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                found = list(index.value.matches(texts(batch)))
                ids = column(batch, "doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                item, need, shared = (pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([ids, item, need, shared, pa.array([x[3] / x[2] for x in found], pa.float64())], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        got = docs.mapInArrow(run, SCHEMA)
        out = got if out is None else out.union(got)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns are kept.

    Rows without a doc_id are searched but only named ones can be dropped; of rows
    that share a doc_id all go if one of them contains an item. Null and empty
    texts and texts without words stay; an empty table on either side drops nothing.
    """
    leaked = materialize(contamination(docs, items).where("doc_id is not null").select("doc_id").distinct())
    return docs.join(maybe_broadcast(leaked), "doc_id", "left_anti").select(docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
its AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n_shingles AS containment
FROM its JOIN ds USING (s) JOIN n USING (item_id) WHERE item_id IN (SELECT item_id FROM i WHERE len(w) >= 5)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0 FROM (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM i WHERE len(w) BETWEEN 1 AND 4) JOIN d ON contains(' ' || array_to_string(d.w, ' ') || ' ', s)
"""
