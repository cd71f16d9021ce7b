"""Exact substring dedup by prefix-free parsing.

A rolling hash of ``TRIGGER`` bytes marks triggers, alike wherever the same
bytes stand. From each trigger to the end of the next runs a phrase; the
distinct phrases are the dictionary, and a document's sequence of phrases is
its parse. A byte's place in the corpus order is given by the phrase suffix that begins
there, ended by a trigger (no such suffix is a prefix of another), and then by the
parse suffix behind it. Two strings of ``LENGTH`` bytes are neighbours in that order iff
they are equal, so what repeats is read off two sorted tables:

1. Suffix array of the parse: for each trigger, the parse suffix behind it, cut where it
   covers ``LENGTH`` bytes, as a string of phrase names (16 bits each, and 64 bits of
   the whole with the phrase before it). The longest common prefix with its
   neighbours decides most starts: if suffix and phrase before equal a neighbour's,
   every start in that phrase repeats; if the common prefix can't fill ``LENGTH``, none does.
2. Suffix array of the dictionary, combined with the parse: the starts left, where repeats begin
   or end, are sorted by the name of their phrase suffix (64 bits) and then by that of what the
   parse puts behind it to fill ``LENGTH`` (32 bits). Equal neighbours repeat.
   Of occurrences that agree in step 1 one at either side stands for all, and of those in
   one block of text one goes on.

Phrases and their suffixes are ordered by name (hash), not by the alphabet: any order of
them makes an order of the corpus in which equal strings meet, and names are what the disk
budget has room for: the bytes themselves would take 9 times the input. The parse is range
partitioned with the place itself as last key, so a passage that a third of all
documents hold is spread over partitions as evenly as any other; a partition's first and last rows go on as
undecided. The starts need no order across partitions: they are dealt by their names, which a block has
few times at most, so that nothing is sampled (that would work out every start twice). Nothing is collected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import KEPT_POWERS, MULT, blocks, column, materialize, mix, powers, shuffles_dropped, trim

LENGTH, TRIGGER, PERIOD = 400, 12, 64
#: Furthest start before a trigger whose window still holds the trigger.
REACH = LENGTH - TRIGGER
#: Phrases of a parse suffix that have a name each (further ones share one), and the longest length that is kept of a phrase.
PHRASES, LONG = 16, 255
#: Passes over the starts of step 2, each for a share of the names: bounds what is on disk at once.
PASSES = 3

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULT)

#: A second modulus: a Thue-Morse word of 1,024 bytes and its complement (for some letters of 512) agree modulo 2**64, whatever the base.
PRIME, BASE = (1 << 31) - 1, 62089911
#: Bytes whose sum of bytes times powers stays below 2**63.
SUMMED = 1 << 24
_PRIME_POWERS: list[np.ndarray] = []


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo PRIME, for k < n at least."""
    if _PRIME_POWERS and len(_PRIME_POWERS[0]) >= n:
        return _PRIME_POWERS[0], _PRIME_POWERS[1]
    size, made = max(1 << 16, 1 << int(n - 1).bit_length()) if n <= KEPT_POWERS else n, []
    for base in (BASE, pow(BASE, -1, PRIME)):
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out[: size - len(out)] * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
        made.append(out.astype(np.uint32))
    if n <= KEPT_POWERS:
        _PRIME_POWERS[:] = made
    return made[0], made[1]


class Text:
    """A block of texts as bytes with prefix hashes (modulo 2**64 and PRIME) of their bytes."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.n = len(self.flat)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUES[self.flat] * up[: self.n], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    @functools.cached_property
    def prime_sums(self) -> np.ndarray:
        """Prefix sums for PRIME, not reduced within ``SUMMED`` bytes."""
        up, self.prime_down = _prime_powers(self.n + 1)
        out = np.zeros(self.n + 1, np.uint64)
        for i in range(0, self.n, SUMMED):
            part = out[i + 1 : i + 1 + SUMMED]
            np.cumsum(np.multiply(self.flat[i : i + SUMMED], up[i : min(i + SUMMED, self.n)], dtype=np.uint64), out=part)
            if self.n > SUMMED:
                part += out[i]
                part %= np.uint64(PRIME)
        return out

    def hash_any(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash by both moduli, for strings of any length (``hash`` is for up to ``LENGTH`` bytes, or where a collision only costs time)."""
        prime = (self.prime_sums[end] + np.uint64(PRIME) - self.prime_sums[begin]) % np.uint64(PRIME) * self.prime_down[begin] % np.uint64(PRIME)
        return mix(self.hash(begin, end) + prime * MULT)

    @functools.cached_property
    def rolling(self) -> np.ndarray:
        """The hash of the ``TRIGGER`` bytes from each place on."""
        return mix((self.sums[TRIGGER:] - self.sums[:-TRIGGER]) * self.down[: self.n - TRIGGER + 1])

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Trigger places and the row of each; a trigger's bytes lie in one row."""
        if self.n < TRIGGER:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.rolling < np.uint64((1 << 64) // PERIOD))
        row = np.searchsorted(self.end, at, "right")
        inside = at + TRIGGER <= self.end[row]
        return at[inside], row[inside]

    def parse(self) -> tuple[np.ndarray, ...]:
        """For each trigger that ends a phrase with whole windows: row, place, nearest and furthest start before it, 64-bit name of that phrase and the suffix; and of each suffix the number of phrases, their names and lengths."""
        at, row = self.triggers()
        n = len(at)
        index = np.arange(n)
        opens = np.concatenate([[True], row[1:] != row[:-1]])[:n]
        closes = np.concatenate([row[1:] != row[:-1], [True]])[-n:] if n else opens
        begin = np.where(opens, self.start[row], np.concatenate([[0], at[:-1]])[:n])
        end = np.where(closes, self.end[row], np.concatenate([at[1:], [0]])[:n] + TRIGGER)  # of the phrase that a trigger begins
        row_last = np.flatnonzero(closes)[np.cumsum(opens) - 1] if n else index
        last = np.minimum(np.searchsorted(at, at + LENGTH - 2 - TRIGGER, "right") - 1, row_last)  # the phrase that reaches LENGTH
        far = np.minimum(at - begin, REACH)
        near = np.clip(at + LENGTH - self.end[row], 1, LENGTH)
        use = np.flatnonzero(far >= near)
        name, size = (self.hash(at, end) >> np.uint64(48)).astype(np.uint16), np.minimum(end - at, LONG).astype(np.uint8)
        count = np.minimum(last[use] - use + 1, PHRASES)
        stop = np.cumsum(count)
        phrase = np.repeat(use - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
        names, sizes = name[phrase], size[phrase]
        many = np.flatnonzero(last[use] - use + 1 > PHRASES)  # the last name stands for all further phrases
        more = use[many] + PHRASES - 1
        names[stop[many] - 1] = (self.hash(at[more], end[last[use[many]]]) >> np.uint64(48)).astype(np.uint16)
        sizes[stop[many] - 1] = LONG
        whole = self.hash_any(begin[use], end[last[use]])
        return row[use], at[use], near[use], far[use], whole, count, names, sizes

    def without_trigger(self) -> tuple[np.ndarray, np.ndarray]:
        """row and start of the windows that hold no trigger behind their first byte."""
        at, row = self.triggers()
        rows = np.concatenate([row, np.arange(len(self.size))])
        last = self.start.copy()
        last[row] = at  # of repeated rows the last assignment stays
        opens = np.concatenate([[True], row[1:] != row[:-1]]) if len(at) else np.zeros(0, bool)
        low = np.concatenate([np.where(opens, self.start[row], np.concatenate([[0], at[:-1]])[: len(at)]), last])
        high = np.minimum(np.concatenate([at - REACH, self.end + 1]), self.end[rows] - LENGTH + 1)  # exclusive
        count = np.maximum(high - low, 0)
        return np.repeat(rows, count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())


PARSE = "suffix binary, whole long, doc long, low int, span int, near int, sizes binary"
FOUND = "doc long, low int, span int, todo boolean"
#: Values of ``near`` for runs that only pass through step 1: repeated, or to be sorted in step 2.
REPEATED, TODO = -1, -2


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return column(batch, "text").cast(pa.binary()).to_pylist()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _runs(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts -> row, first and length less one of what they make up together."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1] + 1)]))
    return row[new], low[new], np.maximum.reduceat(high, new) - low[new]


def _strings(size: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings of the given sizes that stand one behind the other in ``data``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        text, doc = Text(_bytes(batch)), column(batch, "doc").to_numpy()
        row, at, near, far, whole, count, names, sizes = text.parse()
        # a suffix with its phrase before that the block has again: its starts are settled here, one of it goes on
        _, first, which, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[which] > 1)
        own_row, own = text.without_trigger()
        _, own_first, own_which, own_n = np.unique(text.hash(own, own + LENGTH), return_index=True, return_inverse=True, return_counts=True)
        twice, alone = np.flatnonzero(own_n[own_which] > 1), np.sort(own_first)
        kept = np.zeros(len(row), bool)
        kept[first] = True
        arrays = [_strings(2 * count[kept], names[np.repeat(kept, count)]), pa.array(whole[kept].view(np.int64)), pa.array(doc[row[kept]]), pa.array((at - text.start[row])[kept].astype(np.int32)), pa.array(far[kept].astype(np.int32)), pa.array(near[kept].astype(np.int32)), _strings(count[kept], sizes[np.repeat(kept, count)])]
        yield pa.RecordBatch.from_arrays(arrays, _names(PARSE))
        settled = (np.concatenate([row[again], own_row[twice]]), np.concatenate([(at - far)[again], own[twice]]), np.concatenate([(at - near)[again], own[twice]]))
        for (r, low, span), kind in ((_runs(*settled), REPEATED), (_runs(own_row[alone], own[alone], own[alone]), TODO)):
            spread = mix(doc[r].view(np.uint64) + low.astype(np.uint64))  # anywhere in the order
            arrays = [_strings(np.full(len(r), 8), spread.view(np.uint8)), pa.array(spread.view(np.int64)), pa.array(doc[r]), pa.array((low - text.start[r]).astype(np.int32)), pa.array(span.astype(np.int32)), pa.array(np.full(len(r), kind, np.int32)), _strings(np.zeros(len(r), np.int64), np.zeros(0, np.uint8))]
            yield pa.RecordBatch.from_arrays(arrays, _names(PARSE))


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Sorted batches, each between the row before and the row behind it; and where its own rows begin and stop."""
    held = before = None

    def frame(after: pa.RecordBatch | None) -> tuple[pa.RecordBatch, int, int]:
        parts = [x for x in (before, held, after) if x is not None]
        joined = pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(k) for x in parts]) for k in range(held.num_columns)], schema=held.schema)
        begin = int(before is not None)
        return joined, begin, begin + held.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield frame(batch.slice(0, 1))
            before = held.slice(held.num_rows - 1)
        held = batch
    if held is not None:
        yield frame(None)
        trim()


def _units(strings: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of numbers of ``width`` bytes, filled up with zeros, and how many each has."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    kind = np.uint16 if width == 2 else np.uint8
    data = strings.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    count = np.diff(offsets) // width
    out = np.zeros((len(count), PHRASES), kind)
    out[np.arange(PHRASES) < count[:, None]] = flat
    return out, count


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parse's suffix array -> runs of starts that repeat, and (todo) those that step 2 tells apart."""
    for frame, begin, stop in _framed(batches):
        suffix, count = _units(column(frame, "suffix"), 2)
        size, _ = _units(column(frame, "sizes"), 1)
        whole, at, span, near = (column(frame, c).to_numpy() for c in ("whole", "low", "span", "near"))
        size = size.astype(np.int64)
        end = np.cumsum(size - TRIGGER, axis=1) + TRIGGER  # of each phrase, behind the trigger
        end[(np.cumsum(size == LONG, axis=1) > 0) | (size == 0)] = LENGTH
        common = np.cumprod((suffix[1:] == suffix[:-1]) & (np.arange(PHRASES) < np.minimum(count[1:], count[:-1])[:, None]), axis=1).sum(axis=1)
        alike = (common == count[1:]) & (common == count[:-1])
        same = alike & (whole[1:] == whole[:-1])
        rows = np.arange(begin, stop)
        again, reach = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        for pair in (rows - 1, rows):  # with the row before, and with the row behind
            there = (pair >= 0) & (pair < len(same))
            pair = np.clip(pair, 0, max(len(same) - 1, 0))
            if not len(same):
                reach[:] = LENGTH
                continue
            bound = np.where(alike[pair], LENGTH, end[rows, np.minimum(common[pair], PHRASES - 1)])  # a common prefix ends in the first phrase that differs
            again |= there & same[pair]
            reach = np.maximum(reach, np.where(there, np.where(same[pair], 0, bound), LENGTH))  # at a partition's border: unknown
        at, span, near = at[rows], span[rows], near[rows]
        plain = near >= 0
        nearest = np.maximum(near, LENGTH - reach)
        left = plain & (nearest <= span)
        parts = [(plain & again, at - span, span - near, False), (left, at - span, span - nearest, True), (near == REPEATED, at, span, False), (near == TODO, at, span, True)]
        docs = column(frame, "doc").slice(begin, stop - begin)
        for pick, low, length, todo in parts:
            if pick.any():
                yield pa.RecordBatch.from_arrays([docs.filter(pa.array(pick)), pa.array(low[pick].astype(np.int32)), pa.array(length[pick].astype(np.int32)), pa.array(np.full(pick.sum(), todo))], _names(FOUND))


#: ``low`` is inverted (negative) for starts that their block settles: these only pass through, by any alpha.
STARTS = "alpha long, rest int, doc long, low int"


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur more than once, and one place of every key."""
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    goes = np.ones(len(key), bool)
    if not len(twice):
        return np.zeros(0, np.int64), goes
    again = np.flatnonzero(np.isin(key, twice))
    goes[again] = False
    goes[again[np.unique(key[again], return_index=True)[1]]] = True
    return again, goes


def _starts(batches: Iterator[pa.RecordBatch], share: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Texts with the runs left -> the names of each start's phrase suffix (those of one share, by the window's first bytes), and of what fills the window behind it."""
    for batch in blocks(batches, size=1 << 20):
        text = Text(_bytes(batch))
        at, _ = text.triggers()
        at = np.append(at, text.n + LENGTH)
        lows, spans = column(batch, "lows"), column(batch, "spans")
        per = pc.list_value_length(lows).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), per)
        low, span = lows.flatten().to_numpy().astype(np.int64), spans.flatten().to_numpy().astype(np.int64)
        for part in np.array_split(np.arange(len(low)), 1 + int((span + 1).sum()) // 150_000):
            count = span[part] + 1
            own = np.repeat(row[part], count)
            start = np.repeat(low[part] + text.start[row[part]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            # a window's first bytes tell its share, before anything else is worked out of it
            on = np.flatnonzero((text.rolling[start] >> np.uint64(32)) % np.uint64(shares) == np.uint64(share))
            start, own = start[on], own[on]
            k = np.searchsorted(at, start, "right")
            some = at[k] <= start + REACH  # else the window is one phrase's, or the document ends in it
            cut = np.where(some, at[k] + TRIGGER, start + LENGTH)
            alpha = text.hash(start, cut)
            rest = (text.hash(np.where(some, at[k], start), start + LENGTH) >> np.uint64(32)).astype(np.uint32)
            doc, place = column(batch, "doc").to_numpy()[own], (start - text.start[own]).astype(np.int32)
            # what these starts have again is settled here, one of it goes on: no name has more rows than there are such batches
            again, goes = _again(alpha ^ (rest.astype(np.uint64) * MULT))
            spread = mix(doc[again].view(np.uint64) + place[again].astype(np.uint64))
            arrays = [np.concatenate([alpha[goes], spread]).view(np.int64), np.concatenate([rest[goes], np.zeros(len(again), np.uint32)]).view(np.int32), np.concatenate([doc[goes], doc[again]]), np.concatenate([place[goes], ~place[again]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], _names(STARTS))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The combined order -> starts with an equal neighbour, and settled ones (a negative ``low``)."""
    for frame, begin, stop in _framed(batches):
        low = column(frame, "low").to_numpy()
        equal = (low[1:] >= 0) & (low[:-1] >= 0)
        for name in ("alpha", "rest"):
            col = column(frame, name).to_numpy()
            equal &= col[1:] == col[:-1]
        equal = np.concatenate([[False], equal, [False]])
        pick = (equal[1:] | equal[:-1] | (low < 0))[begin:stop]
        if pick.any():
            low = low[begin:stop][pick]
            yield pa.RecordBatch.from_arrays([column(frame, "doc").slice(begin, stop - begin).filter(pa.array(pick)), pa.array(np.where(low < 0, ~low, low))], ["doc", "low"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        out: list[list] = [[], [], [], []]
        for raw, lows, spans in zip(_bytes(batch), column(batch, "lows"), column(batch, "spans")):
            gone, runs, kept = 0, 0, raw
            if lows.is_valid and len(lows):
                low = lows.values.to_numpy().astype(np.int64)
                edge = np.bincount(low, minlength=len(raw) + 1) - np.bincount(low + spans.values.to_numpy() + LENGTH, minlength=len(raw) + 1)
                cover = np.cumsum(edge)[: len(raw)] > 0
                gone, runs = int(cover.sum()), int((cover & ~np.concatenate([[False], cover[:-1]])).sum())
                kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
            for held, x in zip(out, (len(raw), gone, runs, kept)):
                held.append(x)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of ``docs`` (doc_id, text).

    Each byte that lies in a ``LENGTH``-byte string that also starts elsewhere
    in any row is removed. Null text counts as empty; rows that repeat (with or
    without their doc_id) are documents of their own and repeat each other; a
    null doc_id stays null; other columns are ignored; an empty table gives an
    empty result. Strings never cross documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("doc", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    long = docs.where(F.octet_length("text") >= LENGTH).select("doc", "text")
    with shuffles_dropped(docs.sparkSession):
        order = ["suffix", "whole", "doc", "low"]
        parse = long.mapInArrow(_scan, PARSE).repartitionByRange(*order).sortWithinPartitions(*order)
        found = materialize(parse.mapInArrow(_settle, FOUND))
        todo = found.where("todo").groupBy("doc").agg(F.collect_set(F.struct("low", "span")).alias("s"))
        runs = materialize(long.join(todo, "doc").select("doc", "text", F.col("s.low").alias("lows"), F.col("s.span").alias("spans")))
        single = None
        for share in range(PASSES):
            starts = runs.mapInArrow(functools.partial(_starts, share=share, shares=PASSES), STARTS)
            part = materialize(starts.repartition("alpha", "rest").sortWithinPartitions("alpha", "rest", "low").mapInArrow(_repeated, "doc long, low int"))
            single = part if single is None else single.union(part)
    spans = found.where("not todo").select("doc", "low", "span").union(single.select("doc", "low", F.lit(0).alias("span")))
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("low", "span")).alias("s"))
    all_ = docs.join(spans, "doc", "left").select("doc_id", "text", F.col("s.low").alias("lows"), F.col("s.span").alias("spans"))
    return all_.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
