"""Bounded-space online packing of token sequences into windows.

Each partition is one stream: documents are tokenized and cut into pieces of at
most a window; a fixed number of windows stays open, a piece goes where it fits
best, and when none has room the fullest is emitted and a new one opened. (If
the fullest still misses ``CUT`` tokens or more, the piece is cut to fill it
first; smaller gaps are left as padding and documents whole.) What
is still open at a partition's end is merged, window by window, in a second
step over groups of bounded size. Both the stream's state and a group are
bounded whatever the input, and token ids never leave the task that made them.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, materialize, mix, powers, texts

WINDOW, OPEN, END_ID = 1024, 64, 0
TOKENIZER = "byte_bpe_50k.json"
#: The least gap of an emitted window that is worth cutting a piece for.
CUT = 32
#: Open windows that one group of the final merge holds, about.
MERGE_GROUP = 4096
#: Bytes of remembered pieces (key, place, ids) that a worker keeps; then it starts anew.
REMEMBERED = 72 << 20
#: Longer pieces are encoded each time.
LONG = 48

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


@functools.cache
def _blank() -> np.ndarray:
    """By code point: whether it is white space."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return out


class Encoder:
    """Token ids of whole texts, each distinct space-led piece encoded once.

    The tokenizer's own split always ends a unit before a space that is
    followed by a non-space, so pieces cut there are encoded independently. A
    text that holds one of the tokenizer's added tokens is one piece. Pieces are
    found by a 64-bit hash and known by their code points: one that shares its
    hash with another, or is longer than ``LONG``, is encoded by itself. What is
    remembered is arrays of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.uint32)
        self.spelt, self.first, self.length = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _pieces(self, rows: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one string and as code points; begin, end and key of each piece; pieces of each row."""
        joined = "".join(rows)
        flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        start = np.cumsum(sizes) - sizes
        if not len(flat):
            return joined, flat, *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
        first = np.zeros(len(flat), bool)
        first[:-1] = (flat[:-1] == 32) & ~_blank()[flat[1:]]
        first[(start + sizes - 1)[sizes > 0]] = False  # a text's last space leads nothing
        for k, text in enumerate(rows):
            if any(t in text for t in self.added):
                first[start[k] : start[k] + sizes[k]] = False
        first[start[sizes > 0]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(flat))
        up, down = powers(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        keys = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        return joined, flat, begin, end, keys, np.diff(np.searchsorted(begin, np.append(start, len(flat))))

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, size and ids of the pieces, encoded now."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.cumsum(size) - size, size, np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(size.sum()))

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and each text's number of them."""
        if len(self.keys) * 19 + len(self.ids) * 4 + len(self.spelt) * 8 > REMEMBERED:
            self.reset()
        joined, flat, begin, end, keys, per = self._pieces(rows)
        length = end - begin
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        alone = length > LONG  # pieces that are encoded by themselves
        other = np.flatnonzero(~alone & (at[which] != np.arange(len(keys))))
        triples = _triples(flat)
        twin = at[which[other]]
        alone[other[~_equal(length[other], length[twin], lambda on, k: _spelling(triples, begin[twin[on]], length[twin[on]], k), lambda on, k: _spelling(triples, begin[other[on]], length[other[on]], k))]] = True
        near = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        held = self.keys[near] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        met = np.flatnonzero(held & ~alone[at])
        here, there = at[met], near[met]
        wrong = met[~_equal(length[here], self.length[there], lambda on, k: _spelling(triples, begin[here[on]], length[here[on]], k), lambda on, k: self.spelt[self.first[there[on]] + k])]
        alone |= np.isin(which, wrong)
        where, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        if len(self.keys):
            where, size = self.begin[near].astype(np.int64), self.size[near].astype(np.int64)
        new = np.flatnonzero(~held & ~alone[at])
        single = np.flatnonzero(alone)
        asked = np.concatenate([at[new], single])
        old, ids = len(self.ids), self.ids
        if len(asked):
            b, n, more = self._learn([joined[i:j] for i, j in zip(begin[asked].tolist(), end[asked].tolist())])
            ids = np.concatenate([ids, more])
            where[new], size[new] = old + b[: len(new)], n[: len(new)]
        where, size = where[which], size[which]
        if len(single):
            where[single], size[single] = old + b[len(new) :], n[len(new) :]
        # the end id of each text stands behind its pieces
        used = np.append(ids, np.uint32(END_ID))
        ends = np.cumsum(per)
        place, count = np.insert(where, ends, len(used) - 1), np.insert(size, ends, 1)
        stop = np.cumsum(count)
        out = used[np.arange(stop[-1]) + np.repeat(place - (stop - count), count)] if len(rows) else used[:0]
        counts = np.diff(np.concatenate([[0], stop[ends + np.arange(len(rows))]]))
        if len(new):
            into = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, into, distinct[new])
            self.begin, self.size = np.insert(self.begin, into, (old + b[: len(new)]).astype(np.uint32)), np.insert(self.size, into, n[: len(new)].astype(np.uint16))
            fresh = at[new]
            size = -(-length[fresh] // 3)
            first = np.cumsum(size) - size
            self.first = np.insert(self.first, into, (len(self.spelt) + first).astype(np.uint32))
            self.length = np.insert(self.length, into, length[fresh].astype(np.uint8))
            step = np.arange(size.sum()) - np.repeat(first, size)
            self.spelt = np.concatenate([self.spelt, _spelling(triples, np.repeat(begin[fresh], size), np.repeat(length[fresh], size), step)])
            self.ids = ids[: old + int(n[: len(new)].sum())]
        return out, counts


#: Of three code points in one number, those of the first none to three.
_FIRST = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)


def _triples(flat: np.ndarray) -> np.ndarray:
    """Each code point and the two behind it (zeros at the end) as one number."""
    wide = np.zeros(len(flat) + 2, np.uint64)
    wide[: len(flat)] = flat
    return wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)


def _spelling(triples: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The ``k``th three code points of runs that are longer than 3 k."""
    return triples[begin + 3 * k] & _FIRST[np.minimum(length - 3 * k, 3)]


def _equal(size: np.ndarray, other: np.ndarray, one: Callable, two: Callable) -> np.ndarray:
    """Whether runs are equal: of one length, and in each three code points that ``one`` and ``two`` give of some of them."""
    out = size == other
    on, k = np.flatnonzero(out), 0
    while len(on):
        out[on] = one(on, k) == two(on, k)
        k += 1
        on = on[out[on] & (size[on] > 3 * k)]
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(name: str) -> Encoder:
    """The worker's encoder: what it remembers serves the worker's later tasks too."""
    import public_tokenizers

    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(public_tokenizers.path(name))
    return _ENCODERS[name]


class _Stream:
    """The open windows of one partition."""

    def __init__(self, window: int, count: int, base: int):
        self.window, self.count, self.next = window, count, base
        self.room: list[tuple[int, int]] = []  # (free, sequence id), by free
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _emit(self, sequence: int, still_open: bool) -> None:
        offset = 0
        for doc_id, start, raw, n in self.held.pop(sequence):
            length = len(raw) // 4
            self.out.append((doc_id, start, length, zlib.crc32(raw), n, sequence, offset, still_open))
            offset += length

    def put(self, doc_id: int | None, start: int, raw: bytes, n: int) -> None:
        """raw: the piece's ids as little-endian uint32; n: the document's tokens."""
        length = len(raw) // 4
        k = bisect.bisect_left(self.room, (length, -1))
        if k < len(self.room):
            free, sequence = self.room.pop(k)
        else:
            if len(self.room) == self.count:
                gap, fullest = self.room.pop(0)
                if gap >= CUT:
                    self.held[fullest].append((doc_id, start, raw[: 4 * gap], n))
                    self._emit(fullest, False)
                    return self.put(doc_id, start + gap, raw[4 * gap :], n)
                self._emit(fullest, False)
            free, sequence = self.window, self.next
            self.next += 1
            self.held[sequence] = []
        self.held[sequence].append((doc_id, start, raw, n))
        if free == length:
            self._emit(sequence, False)
        else:
            bisect.insort(self.room, (free - length, sequence))

    def close(self) -> None:
        for _, sequence in self.room:
            self._emit(sequence, True)
        self.room = []

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.bool_() if n == "open" else pa.int64()) for k, n in enumerate(names)], names)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs``: doc_id, text (null: empty, packed as the end id alone); other
    columns are ignored, a null doc_id stays null, repeated rows are packed
    each. ``tokenizer``: a file of the public tokenizers. Documents longer than a
    window are cut, others only to fill a window that is emitted. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        stream = _Stream(window, open_windows, TaskContext.get().partitionId() << 40)
        for batch in blocks(batches):
            ids, counts = encoder.encode(texts(batch))
            raw = ids.astype("<u4").tobytes()
            at = 0
            for doc_id, n in zip(column(batch, "doc_id").to_pylist(), counts.tolist()):
                for start in range(0, n, window):
                    length = min(window, n - start)
                    stream.put(doc_id, start, raw[4 * (at + start) : 4 * (at + start + length)], n)
                at += n
            yield stream.batch()
        stream.close()
        yield stream.batch()

    placed = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA))
    left = placed.where("open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    groups = max(1, left.count() // MERGE_GROUP)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "sequence_id"], ascending=False)
        room: list[tuple[int, int]] = []
        into, base = [], []
        for sequence, fill in zip(part.sequence_id, part.fill):
            k = bisect.bisect_left(room, (fill, -1))
            free, target = room.pop(k) if k < len(room) else (window, sequence)
            into.append(target)
            base.append(window - free)
            if free > fill:
                bisect.insort(room, (free - fill, target))
        return pd.DataFrame({"sequence_id": part.sequence_id, "into": into, "base": base})

    merged = left.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("part").applyInPandas(lambda p: merge(p), "sequence_id long, into long, base long")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    moved = placed.where("open").join(merged, "sequence_id").select(*names[:5], F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return placed.where("not open").select(names).union(moved)
