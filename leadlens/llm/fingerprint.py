"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for one text, the modular prefix arrays of two polynomial
hashes. Any span's hash is a difference of two entries, so equality of any two
spans costs O(1) and a longest common extension a binary search over lengths.
The fingerprint is the whole text's hash, its length and a bottom-k sketch of
the hashes of all spans of ``SPAN`` characters, read off the same arrays.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, mix

#: Fixed primes below 2**31, so that a product of two residues fits 64 bits, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, SKETCH = 12, 64
#: Documents of a bucket at least, text bytes of one at most about, and buckets of a small input at most.
LEAST, BYTES, BUCKETS = 64, 64 << 20, 4096


class _Powers:
    """Base**k and its inverse modulo each prime, grown by doubling."""

    KEPT = 1 << 21

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> _Powers:
        """Powers below ``n`` at least; those of a longer text than ``KEPT`` are made for it and let go."""
        if n > max(self.KEPT, len(self.up[0])):
            own = _Powers()
            own.up, own.down, own.KEPT = list(self.up), list(self.down), n
            return own.reach(n)
        while len(self.up[0]) < n:
            size = len(self.up[0])
            for k, (p, b) in enumerate(zip(PRIMES, BASES)):
                for held, root in ((self.up, b), (self.down, pow(b, -1, p))):
                    held[k] = np.concatenate([held[k], held[k] * np.uint64(pow(root, size, p)) % np.uint64(p)])
        return self


@functools.cache
def _powers() -> _Powers:
    return _Powers()


class Prefix:
    """Prefix hashes of one text's code points (array or string)."""

    def __init__(self, text: str | np.ndarray):
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(text, str) else text
        self.n = len(cps)
        self.powers = _powers().reach(self.n + 1)
        cps = cps.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(cps * self.powers.up[k][: self.n] % np.uint64(p), out=out[1:])  # terms below 2**31: no overflow below 2**33 characters
            out %= np.uint64(p)
            self.sums.append(out)

    def spans(self, begin: np.ndarray, length: int, k: int = 0) -> np.ndarray:
        """Hash k of the spans of ``length`` at ``begin``: equal spans, equal hashes, wherever they stand."""
        p = np.uint64(PRIMES[k])
        return (self.sums[k][begin + length] + p - self.sums[k][begin]) % p * self.powers.down[k][begin] % p

    def span(self, begin: int, length: int) -> tuple[int, ...]:
        at = np.array([begin])
        return tuple(int(self.spans(at, length, k)[0]) for k in range(len(PRIMES)))

    def equal(self, begin: int, other: Prefix, other_begin: int, length: int) -> bool:
        return self.span(begin, length) == other.span(other_begin, length)

    def extension(self, begin: int, other: Prefix, other_begin: int) -> int:
        """Length of the longest common run from ``begin`` here and ``other_begin`` there."""
        low, high = 0, min(self.n - begin, other.n - other_begin)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(begin, other, other_begin, mid) else (low, mid - 1)
        return low

    def sketch(self, span: int = SPAN, size: int = SKETCH) -> np.ndarray:
        """The ``size`` least distinct mixed span hashes (32 bits each); a shorter text is one span."""
        if not self.n:
            return np.zeros(0, np.uint64)
        length = min(span, self.n)
        h = mix(self.spans(np.arange(self.n - length + 1), length) + np.uint64(length)) >> np.uint64(32)
        few = 4 * size
        if len(h) > few:
            least = np.unique(np.partition(h, few - 1)[:few])
            if len(least) >= size:
                return least[:size]
        return np.unique(h)[:size]

    def fingerprint(self) -> str:
        return f"{self.n:x}." + "".join(f"{x:08x}" for x in self.span(0, self.n)) + "." + "".join(f"{int(x):08x}" for x in self.sketch())


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """Estimated share of common spans (Dice) of two fingerprints: 1 for equal ones, 0 for unrelated ones."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (f.rpartition(".")[2] for f in (a, b)))
    if not x or not y:
        return 0.0
    both = sorted(x | y)[:size]
    j = sum(v in x and v in y for v in both) / len(both)
    return 2 * j / (1 + j)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and place; in each bucket the last row is only there to be the others' next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_until"]
    held: tuple | None = None
    for batch in blocks(batches):
        out: list[tuple] = []
        for bucket, extra, doc_id, text in zip(*(column(batch, c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
            cps = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            prefix = Prefix(cps)
            fp = prefix.fingerprint()
            if held is not None and held[0] == bucket:
                out.append(_row(held, cps, fp))
            held = None if extra else (bucket, doc_id, cps, prefix, fp)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names)


def _row(held: tuple, following: np.ndarray, next_fp: str) -> tuple:
    _, doc_id, cps, prefix, fp = held
    cut = len(cps) // 3
    edited = np.concatenate([cps[: len(cps) - cut], following[:cut]])
    own = Prefix(edited)
    edited_fp = own.fingerprint()
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(cps), digest, fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp), prefix.extension(0, own, 0)


def with_edits(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Fingerprints of every text and of its edit: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_until.

    The edit replaces the last third (rounded down) by the beginning of the next
    document in descending doc_id; after the last comes the first. Null text
    counts as empty; a null doc_id counts as smaller than any; rows that repeat
    a doc_id follow each other by the hash of their text; a single row is its
    own next; other columns are ignored; an empty table gives an empty result.

    Ranges of (doc_id, hash of the text) become buckets, so many that none holds
    much more than ``BYTES`` of text: an id that a large share of the rows has is
    split by its texts. Each bucket also gets the first row of the next bucket, so
    one shuffle of the texts is enough.
    same_until: the longest common extension of text and edited text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    ids = docs.select(key.alias("k"))
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_until long")
    n = max(1, min(buckets, count // LEAST), size // BYTES)
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0]  # one long for each bucket
    # an id that fills several buckets is cut by the hash of the text
    edges = sorted({(k, -(2**63) + i * (2**64 // m)) for k, m in Counter(cuts).items() for i in range(m)})
    placed = _bucketed(docs, edges)
    # the first row of each bucket, by (key descending, hash of text, text)
    first = placed.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("top"), F.count("*").alias("n"))
    tops = sorted((r["bucket"], r["top"]["k"], r["top"]["h"]) for r in first.collect())
    heads = spark.createDataFrame([(k, h, tops[i - 1][0]) for i, (_, k, h) in enumerate(tops)], "k long, h long, into int")
    copies = placed.join(F.broadcast(heads), ["k", "h"]).dropDuplicates(["into"]).select(F.col("into").alias("bucket"), "k", "h", "doc_id", "text", F.lit(True).alias("extra"))
    rows = placed.select("bucket", "k", "h", "doc_id", "text", F.lit(False).alias("extra")).union(copies)
    parts = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("k"), F.desc("h"))
    return parts.select("bucket", "extra", "doc_id", "text").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_until long")


def _bucketed(docs: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """docs with k, h (hash of the text) and the bucket, by (k, h): 0 for the largest."""
    keys, hashes = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def bucket(k: pd.Series, h: pd.Series) -> pd.Series:
        k, h = k.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        while (some := low < high).any():  # edges of the same id, by the hash
            mid = (low + high) // 2
            less = some & (hashes[np.minimum(mid, len(hashes) - 1)] < h)
            low, high = np.where(less, mid + 1, low), np.where(some & ~less, mid, high)
        return pd.Series(len(keys) - low).astype("int32")

    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    return keyed.withColumn("bucket", bucket("k", "h"))
