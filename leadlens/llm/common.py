"""Shared helpers: reading, shared-folder tables, size-checked broadcasts, numpy text scans."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; bounds a Python worker's memory.
BLOCK_BYTES = 1 << 20
#: Rows up to which a counted side may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder (of its own only in local mode)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shared_")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written in here drop their shuffle files when they are done, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else ``df`` (shuffle join).

    ``df`` should be a materialized table of few, narrow columns: it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``size`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_table() -> np.ndarray:
    """uint32 by code point: its lower case if it is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low[0])
    return out


_POWERS: list[np.ndarray] = []
#: Powers that a worker keeps; those of a longer text are made for it and let go.
KEPT_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**k and its inverse modulo 2**64, for k < n at least."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(1 << 16, 1 << int(n - 1).bit_length()) if n <= KEPT_POWERS else n
    inverse = pow(int(MULT), -1, 1 << 64)
    made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, m, np.uint64))]) for m in (MULT, np.uint64(inverse))]
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def code_points(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by a line feed, and each row's start (plus the end)."""
    flat = np.frombuffer(("\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in rows])]).astype(np.int64)
    return flat, starts


def words_of(flat: np.ndarray, starts: np.ndarray, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits, lower case) of ``code_points`` output; longer ones than ``longest`` (if given) in pieces.

    Returns lowered code points (0 outside words), word begins, word ends,
    64-bit word hashes, and for each row the index of its first word (plus the total).
    """
    low = word_table()[flat]
    inside = low != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if longest and len(begin) and (end - begin).max() > longest:
        parts = -(-(end - begin) // longest)
        begin = np.repeat(begin, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(begin + longest, np.repeat(end, parts))
    up, down = powers(len(flat) + 1)
    prefix = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(low * up[: len(flat)], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return low, begin, end, hashes, np.searchsorted(begin, starts)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` word hashes that stays in its row, and the row of each.

    A row of one to ``width`` - 1 words has its whole sequence as one shingle (if ``short``).
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    acc = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        acc = acc * MULT + hashes[k : k + len(acc)]
    whole = row[: len(acc)] == row[width - 1 : width - 1 + len(acc)]
    out, rows = [mix(acc[whole])], [row[: len(acc)][whole]]
    for r in np.flatnonzero((count > 0) & (count < width)) if short else ():
        x = count[r : r + 1].astype(np.uint64)
        for k in range(first[r], first[r + 1]):
            x = x * MULT + hashes[k : k + 1]
        out.append(mix(x))
        rows.append(np.array([r]))
    return np.concatenate(out), np.concatenate(rows)
