"""Conversation structure repair by a recursive query over grammar states.

Turns are dealt by conversation and sorted; each task streams them and hands
batches of whole conversations to DuckDB, where one recursive query advances all
of them by one turn an iteration. For each conversation and grammar state (start,
after system, after user, after assistant) it keeps the cheapest cost and, of the
edits that cost so little, the least audit string.

A conversation longer than a batch goes on from piece to piece: what passes
between pieces is, for each state, the cost, the audit so far, the running hash of
the repaired text, and which of the audits is less. No audit is the beginning of
another (each ends with the edit of the same turn), so their order settles that of
whatever follows. Texts of a long conversation are therefore never held together;
its audit is, being one value of the result, and 16 bytes a turn to know repeats.
Its turns are read by one task: the hash of its text can only be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import column, trim
from leadlens.llm.duck import CRC_TABLE, crc32

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Grammar (s?(ua)+)?: from state by a role's initial to state; the empty start and "a" may end.
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ENDS = ("", "a")
BLANK = " \t\n\x0b\x0c\r"
#: Turns of a batch (and bytes, about); turns of a conversation that one recursion walks.
BATCH, BATCH_BYTES, PIECE = 8192, 8 << 20, 512

TURNS = "conv_id long, turn long, role string, text string, copies int"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserts(state: str) -> list[tuple[str, str]]:
    """(state, edits) reached by inserting at most two turns."""
    out = [(state, "")]
    for k in range(2):
        out += [(STEPS[(s, i)], edits + "I") for s, edits in out if len(edits) == k for i in ROLES if (s, i) in STEPS]
    return out


def _moves() -> pa.Table:
    """Inserts and then one turn's edit: state before and after, edit, the initial it needs (null: any), cost, letters."""
    rows = []
    for start in ("", "s", "u", "a"):
        for state, edits in _inserts(start):
            paid = INSERT * len(edits)
            rows.append((start, state, "D", None, paid + DELETE, edits + "D"))
            for (s, initial), into in STEPS.items():
                if s == state:
                    rows.append((start, into, "K", initial, paid, edits + "K"))
                    if initial in ROLES:
                        rows.append((start, into, "R", None, paid + REROLE, edits + "R"))
    return pa.table({n: [r[k] for r in rows] for k, n in enumerate(("was", "state", "edit", "initial", "cost", "letters"))})


READ = f"""
SELECT c, n, turn, role, text, role[1] AS initial,
  CASE WHEN bare = '' THEN 'blank' WHEN before OR row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
       WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
FROM (SELECT *, rtrim(text, '{BLANK}') AS bare FROM turns)"""

COUNTED = """
SELECT c, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (n > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(initial, n) AS opens, arg_max(initial, n) AS closes
FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY n) || initial AS pair FROM faulted) GROUP BY c ORDER BY c"""

def walk_sql(piece: int) -> str:
    """One piece of each conversation, a turn an iteration, from the frontier's states; $piece: which."""
    return f"""
WITH RECURSIVE piece AS (
  SELECT c, n - $piece * {piece} + 1 AS pos, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra
  FROM faulted WHERE n // {piece} = $piece),
walk AS (
  SELECT c, 0::BIGINT AS pos, state, row(cost, rank, '') AS best FROM frontier
  UNION ALL
  SELECT p.c, p.pos, m.state, min(row(w.best[1] + m.cost + CASE WHEN m.edit = 'D' THEN 0 ELSE p.extra END, w.best[2], w.best[3] || m.letters))
  FROM walk w JOIN piece p ON p.c = w.c AND p.pos = w.pos + 1
  JOIN moves m ON m.was = w.state AND (m.edit = 'D' OR NOT p.must) AND (m.initial IS NULL OR m.initial = p.initial)
  GROUP BY p.c, p.pos, m.state)
SELECT c, state, best[1] AS cost, best[2] AS rank, best[3] AS letters
FROM walk JOIN (SELECT c, max(pos) AS pos FROM piece GROUP BY c) USING (c, pos) ORDER BY c, rank, letters"""


WALK = walk_sql(PIECE)


class _Path:
    """The best edits that end in a state: cost, audit (in pieces), and the hash of the repaired text so far."""

    __slots__ = ("cost", "audit", "sha", "some", "state")

    def __init__(self) -> None:
        self.cost, self.audit, self.sha, self.some, self.state = 0, None, hashlib.sha256(), False, ""

    def then(self, letters: str, cost: int, turns: Iterator[tuple[str, str]]) -> _Path:
        """This path followed by the letters' edits of the turns (role, text)."""
        new = _Path()
        new.cost, new.audit, new.sha, new.some, new.state = cost, (self.audit, letters), self.sha.copy(), self.some, self.state
        for letter in letters:
            role, text = next(turns) if letter != "I" else ("", "")
            if letter == "D":
                continue
            if letter != "K":  # the grammar leaves one role of the two
                role = next(ROLES[i] for i in ROLES if (new.state, i) in STEPS)
            new.state = STEPS[new.state, role[0]]
            new.sha.update((("\n" if new.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            new.some = True
        return new

    def letters(self) -> str:
        parts, held = [], self.audit
        while held:
            held, part = held
            parts.append(part)
        return "".join(reversed(parts))


class _Talk:
    """A conversation: its best paths in the order of their audits, its counts, and what tells repeats if it goes on."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.paths, self.counts = conv_id, [_Path()], np.zeros(4, np.int64)
        self.low = self.high = self.closes = None
        self.turns, self.seen = 0, np.zeros(0, "V16")

    def add(self, got: dict) -> None:
        """Counts of a batch (``COUNTED``)."""
        self.counts += [got[k] for k in ("blank", "duplicate", "truncated", "illegal")]
        self.counts[3] += self.closes is not None and self.closes + got["opens"] not in ("su", "ua", "au")
        self.closes = got["closes"]
        if got["low"] is not None:
            self.turns += got["turns"] - (got["low"] == self.high)
            self.low, self.high = got["low"] if self.low is None else self.low, got["high"]

    def row(self) -> tuple:
        ways = []
        for rank, path in enumerate(self.paths):
            for state, edits in _inserts(path.state):
                if state in ENDS:
                    ways.append((path.cost + INSERT * len(edits), rank, edits))
        cost, rank, edits = min(ways)
        best = self.paths[rank].then(edits, cost, iter(()))
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return (self.conv_id, gaps, *self.counts.tolist(), cost, best.letters(), best.sha.hexdigest())


def _marks(roles: list[str], texts: list[str]) -> np.ndarray:
    return np.array([hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in zip(roles, texts)], "V16")


class _Repair:
    """Batches of turns, sorted by conversation and turn, to rows of ``REPAIRED``."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '600MB'")
        self.db.register("moves_", _moves())
        self.db.execute("CREATE TABLE moves AS FROM moves_")
        self.open: _Talk | None = None

    def _rows(self, sql: str, values: dict | None = None) -> list[dict]:
        got = self.db.execute(sql, values)
        names = [d[0] for d in got.description]
        return [dict(zip(names, r)) for r in got.fetchall()]

    def run(self, table: pa.RecordBatch, more: bool) -> list[tuple]:
        """Rows of the conversations of ``table``; if ``more``, the last one may go on and waits."""
        ids = column(table, "conv_id")
        own = np.stack([pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(ids, 0).to_numpy()])
        first = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
        talks = [_Talk(ids[int(k)].as_py()) for k in first]
        held = self.open is not None and self.open.conv_id == talks[0].conv_id
        out = []
        if self.open is not None and not held:
            out.append(self.open.row())
        if held:
            talks[0] = self.open
        talk = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        again = np.repeat(np.arange(table.num_rows), column(table, "copies").to_numpy())
        table, talk = table.take(pa.array(again)), talk[again]
        if table.num_rows:
            self._walk(table, talk, talks, held, more)
        self.open = talks.pop() if more else None
        return out + [t.row() for t in talks]

    def _walk(self, table: pa.RecordBatch, talk: np.ndarray, talks: list[_Talk], held: bool, more: bool) -> None:
        place = np.arange(len(talk)) - np.searchsorted(talk, talk)
        roles, said = column(table, "role").to_pylist(), column(table, "text").to_pylist()
        before = np.zeros(len(talk), bool)
        if held:
            k = int(np.searchsorted(talk, 1))
            before[:k] = np.isin(_marks(roles[:k], said[:k]), talks[0].seen)
        if more:
            k = int(np.searchsorted(talk, len(talks) - 1))
            talks[-1].seen = np.unique(np.concatenate([talks[-1].seen, _marks(roles[k:], said[k:])]))
        turns = pa.table({"c": talk, "n": place, "turn": column(table, "turn"), "role": column(table, "role"), "text": column(table, "text"), "before": before})
        self.db.register("turns", turns)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE faulted AS {READ}")
        for got in self._rows(COUNTED):
            talks[got["c"]].add(got)
        start = np.searchsorted(talk, np.arange(len(talks)))
        for piece in range(int(place.max()) // PIECE + 1):
            on = np.unique(talk[place == piece * PIECE]).tolist()
            rows = [(c, p.state, p.cost, rank) for c in on for rank, p in enumerate(talks[c].paths)]
            self.db.register("frontier", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("c", "state", "cost", "rank"))}))
            paths: dict[int, list[_Path]] = {c: [] for c in on}
            for got in self._rows(WALK, {"piece": piece}):
                c = got["c"]
                was = talks[c].paths[got["rank"]]
                k = int(start[c]) + piece * PIECE
                paths[c].append(was.then(got["letters"], got["cost"], zip(roles[k : k + PIECE], said[k : k + PIECE])))
            for c, found in paths.items():
                talks[c].paths = found
        self.db.unregister("turns")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in REPAIRED.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    repair, waiting, size = None, [], 0
    for batch in batches:
        for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
            repair = repair or _Repair()
            waiting.append(part)
            size += part.num_rows * (BATCH_BYTES // BATCH) + pc.sum(pc.binary_length(column(part, "text"))).as_py()
            if size >= 2 * BATCH_BYTES:
                yield rows(repair.run(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], True))
                waiting, size = [], 0
    if repair is not None:
        if waiting:
            yield rows(repair.run(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], False))
        elif repair.open is not None:
            yield rows([repair.open.row()])
        repair.db.close()
    trim()


def damage(conversations: DataFrame) -> DataFrame:
    """``TURNS`` of ``conversations`` (conv_id, turn, role, text), damaged by a hash of conversation and turn.

    A null counts as one space, in the hash too; turn and conv_id stay null in the
    result. copies: 0 if the turn is dropped, 2 if it is repeated, else 1.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """A row of ``REPAIRED`` for each conversation of ``turns`` (``TURNS``; copies: how often a turn stands, 0 for not at all).

    Turns go by turn (nulls first), then role and text, so ties have one order. A
    null conv_id is a conversation of its own; null roles and texts count as one
    space. A role counts by its first letter, in lower case only; an empty role
    has none and is never kept. Equal rows are duplicates of the first. A
    conversation without turns has zeros, no audit and the hash of nothing. Other
    columns are ignored; an empty table gives an empty result.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    dealt = own.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_repair, REPAIRED)


def op12(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations))


def _paid(state: str, cost: int | str, letters: str) -> str:
    return f"row({state}[1] + {cost}, {state}[2] || '{letters}')"


def _oracle() -> str:
    """DuckDB SQL of ``op12``: one row a conversation and turn, the four states side by side; roles of the repaired turns by their parity."""
    none, least = "row(1000000000, '')", lambda *x: f"list_min([{', '.join(x)}])"
    keep = lambda states, initial: [f"CASE WHEN NOT must AND initial = '{initial}' THEN {_paid(x, 'extra', 'K')} ELSE {none} END" for x in states]
    rerole = lambda states: [f"CASE WHEN NOT must THEN {_paid(x, f'extra + {REROLE}', 'R')} ELSE {none} END" for x in states]
    gone = lambda x: _paid(x, DELETE, "D")
    one, two = lambda x: _paid(x, INSERT, "I"), lambda x: _paid(x, 2 * INSERT, "II")
    return f"""
WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT * EXCLUDE key, {crc32("key")} % 20 AS kind FROM given, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM hashed)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faulted AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'b' WHEN min(n) OVER (PARTITION BY conv_id, role, text) < n THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulted GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, row(0, '') AS e, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL
  SELECT conv_id, n, {gone("e")}, {least(gone("s"), *keep("e", "s"))}, {least(gone("u"), *keep("esa", "u"), *rerole("esa"))}, {least(gone("a"), *keep("u", "a"), *rerole("u"))}
  FROM (
    SELECT f.conv_id, f.n, f.initial, f.fault IN ('b', 'd') AS must, CASE f.fault WHEN 't' THEN {TRUNCATED} ELSE 0 END AS extra, e, s,
      {least("u", one("e"), one("s"), one("a"))} AS u, {least("a", one("u"), two("e"), two("s"))} AS a
    FROM walk w JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)),
ended AS (SELECT conv_id, {least("e", "a", one("u"), two("s"))} AS best FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS top FROM walk) WHERE n = top),
letters AS (SELECT conv_id, unnest(string_split(best[2], '')) AS letter, generate_subscripts(string_split(best[2], ''), 1) AS k FROM ended WHERE best[2] <> ''),
used AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS n FROM letters),
kept AS (SELECT u.*, f.role, f.text, f.initial, row_number() OVER (PARTITION BY u.conv_id ORDER BY k) AS j FROM used u LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.n = u.n AND letter <> 'I' WHERE letter <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM (SELECT *, max((j = 1 AND letter = 'K' AND initial = 's')::INT) OVER (PARTITION BY conv_id) AS system FROM kept) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best[1]::BIGINT AS cost, best[2] AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
