"""Conversation repair against a search through all edits."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from leadlens.llm import conversations

BARE = " \t\n\x0b\x0c\r"


def brute_repair(rows, every=True):
    """rows: (turn, role, text) of one conversation after damage -> result columns but conv_id; every: go on from each audit, not only from the best of a turn and state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BARE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:  # by cost, then audit: the first end is the answer
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state, audit if every else "") in done:
            continue
        done.add((i, state, audit if every else ""))
        for role in ("user", "assistant"):
            if (state, role[0]) in step and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[state, role[0]], (*kept, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if faults[i] not in ("blank", "duplicate"):
                paid = 3 * (faults[i] == "truncated")
                if role[:1] and (state, role[0]) in step:
                    heapq.heappush(heap, (cost + paid, audit + "K", i + 1, step[state, role[0]], (*kept, f"{role}:{text}")))
                for own in ("user", "assistant"):
                    if (state, own[0]) in step:
                        heapq.heappush(heap, (cost + paid + 3, audit + "R", i + 1, step[state, own[0]], (*kept, f"{own}:{text}")))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def brute_damage(rows):
    groups = {}
    for conv, turn, role, text in rows:
        held = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return sorted(((c, *brute_repair(r)) for c, r in groups.items()), key=str)


def made(n, longest, rng):
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "unknown", "", None, "User"])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No", "", None, " \t\n", "What?! ", f"Word {turn}.", "é日😀."])))
    return out


def test_repair(spark):
    rows = made(120, 6, random.Random(5))
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, state int").repartition(5)
    got = sorted((tuple(r) for r in conversations.op12(table).collect()), key=str)
    assert got == brute_damage(rows)
    assert conversations.op12(table.limit(0)).count() == 0


def test_repair_in_pieces(monkeypatch):
    """Conversations longer than a piece and than a batch go on with what was kept of them."""
    import pyarrow as pa

    rng = random.Random(6)
    rows = []
    for conv, n in ((1, 40), (2, 3), (3, 90), (4, 1), (5, 25)):
        talk = [(t // 2, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice([f"Word {rng.randint(0, 30)}.", "No", " "])) for t in range(n)]
        rows += [(conv, *r, 1) for r in sorted(talk)]
    want = sorted((c, *brute_repair([r[1:4] for r in g], False)) for c, g in ((c, list(g)) for c, g in itertools.groupby(rows, lambda r: r[0])))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32())])
    for piece, bytes_, cut in ((512, 8 << 20, 1000), (8, 8 << 20, 7), (4, 0, 5), (3, 1, 1), (512, 0, 13)):
        monkeypatch.setattr(conversations, "PIECE", piece)
        monkeypatch.setattr(conversations, "BATCH_BYTES", bytes_)
        monkeypatch.setattr(conversations, "WALK", conversations.walk_sql(piece))
        table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
        got = [tuple(r.values()) for b in conversations._repair(iter(table.to_batches(cut))) for r in b.to_pylist()]
        assert sorted(got) == want


@pytest.mark.parametrize("table", ["conversations"])
def test_repair_of_given_table(spark, data, table):
    given = spark.read.parquet(f"{data}/{table}.parquet")
    got = sorted((tuple(r) for r in conversations.op12(given).collect()), key=str)
    assert got == brute_damage([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in given.collect()])
