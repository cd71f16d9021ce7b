"""Token counts by a compiled finite-state transducer.

The tokenizer (lower-casing, a split into words, byte-pair merges with a
word-end mark) is compiled into one deterministic transducer over code points
whose transitions carry how many tokens they add. A byte-pair encoding is
canonical exactly if each pair of neighbouring tokens is, so the encoding of a
word's prefix is decided by, for each position that a vocabulary entry may
still reach across, the last token before it: finitely many states. The
machine is compiled as its states are met and kept for the worker's life.

A text is cut into chunks that run side by side, one array step per character.
A chunk's effect is a map from entry state to (exit state, tokens). White space
sends every state to the start, so a chunk with white space has a constant exit.
The map of a chunk without any is tabulated at the states that may enter it:
first the one that the characters before it lead to from the start, then those
that the scan asks for, which are tried on all later chunks of the run at once.
A prefix scan composes the maps pairwise, over twice as many chunks each round,
and so gives every chunk's entry state and tokens; no chunk waits for the one before it.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, texts

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
END = "</w>"
CHUNK = 256
#: Characters before a chunk that give its first entry state to try; entries of a chunk's map.
WARM, ENTRIES = 48, 8
#: Compiled transitions that a worker keeps; then it compiles anew.
KEPT = 3_000_000

START, LETTERS, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: The endings that the tokenizer's split takes with a leading quote.
ONE, TWO = "stmd", {"r": (QUOTE_R, "e"), "v": (QUOTE_V, "e"), "l": (QUOTE_L, "l")}
#: White space in the tokenizer's patterns (Unicode White_Space).
SPACE = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@functools.cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Machine:
    """The transducer. State 0 is the start; ``step`` maps arrays of (state, code point)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = set(spec["model"]["vocab"])
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.prefixes = {t[:k] for t in self.vocab for k in range(len(t) + 1)}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.parts: dict[str, list[str]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.of: list[tuple] = []
        self.number((START, ()))
        self.bits, self.used = 16, 0
        self.keys, self.to, self.adds = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)

    def number(self, state: tuple) -> int:
        n = self.states.setdefault(state, len(self.of))
        if n == len(self.of):
            self.of.append(state)
        return n

    # ---- byte-pair part
    def symbols(self, token: str) -> list[str]:
        stem, end = (token[: -len(END)], True) if token.endswith(END) and len(token) > len(END) else (token, False)
        out = list(stem)
        if end:
            out[-1] += END
        return out

    def merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def fit(self, left: str | None, right: str) -> bool:
        """Whether ``right`` can follow ``left`` (None: begin a word) in a canonical encoding."""
        got = self.fits.get((left, right))
        if got is None:
            want = [right] if left is None else [left, right]
            got = self.fits[left, right] = self.merged([s for t in want for s in self.symbols(t)]) == want
        return got

    #: Before any byte of a word: nothing pending, no token yet.
    FRESH = (("", None, 0),)

    def byte(self, live: tuple, symbol: str) -> tuple[tuple, int]:
        """live: (pending text, last token before it, tokens before it less those of the whole prefix)."""
        grown = [(u + symbol, t, d) for u, t, d in live if u + symbol in self.prefixes]
        last, count = next((u, d + 1) for u, t, d in grown if u in self.vocab and self.fit(t, u))
        return (*((u, t, d - count) for u, t, d in grown), ("", last, 0)), count

    def final(self, live: tuple) -> int:
        """Tokens of the whole word less those of it as a prefix."""
        return next(d + 1 for u, t, d in live if u and u + END in self.vocab and self.fit(t, u + END))

    def eat(self, live: tuple, char: str) -> tuple[tuple, int]:
        table, total = byte_symbols(), 0
        for b in char.encode("utf-8", "surrogatepass"):
            live, n = self.byte(live, table[b])
            total += n
        return live, total

    def word(self, text: str) -> int:
        live, total = self.FRESH, 0
        for c in text:
            live, n = self.eat(live, c)
            total += n
        return total + self.final(live)

    # ---- split into words
    def move(self, state: tuple, cp: int) -> tuple[tuple, int]:
        mode, live = state
        char, n = chr(cp), 0
        kind = "space" if cp in SPACE else unicodedata.category(char)[0]
        if mode == QUOTE:
            if char in ONE:
                return (START, ()), self.word("'" + char)
            if char in TWO:
                return (TWO[char][0], ()), 0
            mode, live = MARKS, self.eat(self.FRESH, "'")[0]
            n = 1
        elif mode in (QUOTE_R, QUOTE_V, QUOTE_L):
            first, second = next((k, v[1]) for k, v in TWO.items() if v[0] == mode)
            if char == second:
                return (START, ()), self.word("'" + first + char)
            live, m = self.eat(self.FRESH, first)
            mode, n = LETTERS, self.word("'") + m
        into = {"space": START, "L": LETTERS, "N": START}.get(kind, MARKS)
        if mode in (LETTERS, MARKS) and (into != mode or kind in ("space", "N")):
            n += self.final(live)
            mode = START
        if kind == "space":
            return (START, ()), n
        if kind == "N":
            return (START, ()), n + self.word(char)
        if mode == START:
            if char == "'":
                return (QUOTE, ()), n
            live = self.FRESH
        live, m = self.eat(live, char)
        return (into, live), n + m

    # ---- compiled table: open addressing on state * 2^21 + code point
    def slots(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        off = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(off):
            at[off] = (at[off] + 1) & mask
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held != -1)]
        return at

    def add(self, keys: list[int]) -> None:
        if (self.used + len(keys)) * 2 > len(self.keys):
            full = np.flatnonzero(self.keys != -1)
            old = self.keys[full], self.to[full], self.adds[full]
            while (self.used + len(keys)) * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.to, self.adds = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)
            for k in range(0, len(full), 1 << 14):
                self._insert(*(x[k : k + (1 << 14)] for x in old))
        moved = [self.move(self.of[k >> 21], k & 0x1FFFFF) for k in keys]
        self._insert(np.array(keys, np.int64), np.array([self.number(s) for s, _ in moved], np.int32), np.array([n for _, n in moved], np.int16))
        self.used += len(keys)

    def _insert(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        while len(keys):  # of keys that want the same free slot one gets it; the others try again
            at = self.slots(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys
            self.to[at[won]], self.adds[at[won]] = to[won], adds[won]
            keys, to, adds = keys[~won], to[~won], adds[~won]

    def step(self, state: np.ndarray, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state * (1 << 21) + cps
        at = self.slots(keys)
        unknown = self.keys[at] == -1
        if unknown.any():
            self.add(np.unique(keys[unknown]).tolist())
            at = self.slots(keys)
        return self.to[at].astype(np.int64), self.adds[at]

    # ---- texts
    def prepare(self, text: str) -> tuple[str, int]:
        """The text as the machine reads it, and the tokens of special strings in it."""
        parts = re.split("|".join(map(re.escape, self.special)), text) if any(s in text for s in self.special) else [text]
        parts = [p if p.isascii() or unicodedata.is_normalized("NFC", p) else unicodedata.normalize("NFC", p) for p in parts]
        return "\n".join(parts).replace("Σ", "σ").lower(), len(parts) - 1

    def counts(self, rows: list[str]) -> np.ndarray:
        if self.used > KEPT:
            self.reset()
        ready = [self.prepare(t) for t in rows]
        flat = np.frombuffer(("\n".join(t for t, _ in ready) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t, _ in ready])
        lanes = -(-len(flat) // CHUNK)
        grid = np.full(lanes * CHUNK, 10, np.int64)
        grid[: len(flat)] = flat
        grid = grid.reshape(lanes, CHUNK)
        reset = (grid == 32) | (grid == 10)
        has = reset.any(axis=1)
        head = np.where(has, reset.argmax(axis=1) + 1, CHUNK)  # characters up to the first sure reset
        added = np.zeros((lanes, CHUNK), np.int16)
        leave = np.zeros(lanes, np.int64)
        masked = np.ascontiguousarray(np.where(np.arange(CHUNK) < head[:, None], 10, grid).T)
        for k in range(CHUNK):  # the constant part of every chunk's map
            leave, added[:, k] = self.step(leave, masked[k])
        enter = np.concatenate([[0], leave[:-1]])
        self._scan(grid, has, leave, enter, added)
        now = np.flatnonzero(has & (head > 0))
        now = now[np.argsort(-head[now], kind="stable")]
        state, size = enter[now], head[now]
        for k in range(int(size.max(initial=0))):  # what stands before a chunk's first reset
            on = int(np.searchsorted(-size, -k, "left"))
            state[:on], added[now[:on], k] = self.step(state[:on], grid[now[:on], k])
        total = np.concatenate([[0], np.cumsum(added.ravel(), dtype=np.int64)])[np.concatenate([[0], ends])]
        return np.diff(total) + np.array([n for _, n in ready])

    def _through(self, state: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of lanes that run side by side from their entry states."""
        total = np.zeros(len(state), np.int64)
        for k in range(grid.shape[1]):
            state, n = self.step(state, grid[:, k])
            total += n
        return state, total

    def _scan(self, grid: np.ndarray, has: np.ndarray, leave: np.ndarray, enter: np.ndarray, added: np.ndarray) -> None:
        """Entry states of all lanes and tokens of those without a reset (``has``), by composing maps."""
        lane = np.flatnonzero(~has)
        if not len(lane):
            return
        n = len(lane)
        opens = np.concatenate([[True], np.diff(lane) > 1])
        head = np.flatnonzero(opens)[np.cumsum(opens) - 1]  # the first lane of each one's run
        entry, out, tokens = (np.full((n, ENTRIES), -1, np.int64) for _ in range(3))
        guess = np.where(opens, enter[lane], 0)
        warm = np.flatnonzero(~opens)
        guess[warm] = self._through(np.zeros(len(warm), np.int64), grid[lane[warm] - 1, -WARM:])[0]
        entry[:, 0] = guess
        out[:, 0], tokens[:, 0] = self._through(guess, grid[lane])
        held = np.ones(n, np.int64)  # entries in use
        while True:
            # compose[i, m]: exit of lane i if the first lane that the map covers is entered by its entry m
            compose, first, step = out.copy(), np.arange(n), 1
            while step < n:
                i = np.flatnonzero(first > head)
                if not len(i):
                    break
                before = compose[first[i] - 1]
                match = (before[:, :, None] == entry[first[i]][:, None, :]) & (before >= 0)[:, :, None]
                composed = np.where(match.any(axis=2), np.take_along_axis(compose[i], match.argmax(axis=2), 1), -1)
                compose[i], first[i] = composed, first[first[i] - 1]
                step *= 2
            leaves = compose[:, 0]
            enters = np.where(opens, guess, np.concatenate([[0], leaves[:-1]]))
            known = (entry == enters[:, None]) & (enters >= 0)[:, None]
            missing = np.flatnonzero((enters >= 0) & ~known.any(axis=1))
            if not len(missing):
                break
            # each state asked for is tried on that lane and the later ones of its run
            later = np.concatenate([np.arange(k, k + int(np.searchsorted(head[k:], head[k], "right"))) for k in missing])
            state = np.repeat(enters[missing], [int(np.searchsorted(head[k:], head[k], "right")) for k in missing])
            fresh = ~(entry[later] == state[:, None]).any(axis=1)
            later, state = later[fresh], state[fresh]
            place = np.where(held[later] < ENTRIES, held[later], 1 + held[later] % (ENTRIES - 1))
            entry[later, place] = state
            out[later, place], tokens[later, place] = self._through(state, grid[lane[later]])
            held[later] += 1
        slot = known.argmax(axis=1)
        added[lane, CHUNK - 1] = tokens[np.arange(n), slot]
        leave[lane] = out[np.arange(n), slot]
        enter[1:] = leave[:-1]


_MACHINES: dict[str, Machine] = {}


def machine(name: str) -> Machine:
    import public_tokenizers

    if name not in _MACHINES:
        _MACHINES[name] = Machine(public_tokenizers.path(name))
    return _MACHINES[name]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Null text counts as empty (no bytes, no tokens); a null doc_id stays null;
    repeated rows give a row each; other columns are ignored; an empty table
    gives an empty result. Special strings in a text count one token each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(tokenizer)
        for batch in blocks(batches):
            rows = texts(batch)
            n = own.counts(rows)
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
