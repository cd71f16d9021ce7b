"""Word windows that repeat from smaller documents, against plain sets of windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from leadlens.llm import substring_dedup


def brute_windows(rows, width=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = b" ".join(w[i : i + width])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        cover = np.zeros(len(w), bool)
        if d is not None:
            for i in range(len(w) - width + 1):
                if least[b" ".join(w[i : i + width])] < d:
                    cover[i : i + width] = True
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out.append((d, len(w), int(cover.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(rng):
    """Passages of several lengths in several documents, edited copies, chained overlaps, periodic and short-vocabulary texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n, v=vocabulary: [rng.choice(v) for _ in range(n)]
    passages = [text(rng.choice([49, 50, 51, 60, 74, 75, 76, 120, 300])) for _ in range(25)]
    rows = []
    for d in range(120):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, 20)])
            w += p[a : len(p) - rng.choice([0, 0, rng.randint(0, 20)])] + text(rng.choice([0, 1, 2, 30]))
        rows.append((d, w))
    for d in range(120, 180):
        w = list(rng.choice(rows[:120])[1])
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((d, w))
    for d in range(180, 200):
        rows.append((d, (text(rng.randint(1, 30), vocabulary[:2]) * 60)[: rng.randint(40, 400)]))
    for d in range(200, 215):
        rows.append((d, text(rng.randint(60, 300), ["a"]) + text(rng.randint(0, 3))))
    gaps = [" ", "\n", " \t ", "\r\n", "\x0b"]
    return [(d, "".join(x + rng.choice(gaps) for x in w)) for d, w in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    rows = made(random.Random(seed))
    order = list(range(len(rows)))
    random.Random(seed).shuffle(order)
    rows = [(order[d], t) for d, t in rows]
    rows += [rows[3], rows[3], (rows[4][0], rows[3][1]), (None, rows[5][1]), (None, None), (rows[130][0], rows[130][1] + " more")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in substring_dedup.op13(table).collect()), key=str) == brute_windows(rows)


def test_window_edges(spark, data, edge, edge_rows, none):
    assert sorted((tuple(r) for r in substring_dedup.op13(edge).collect()), key=str) == brute_windows(edge_rows)
    assert substring_dedup.op13(none).count() == 0
    given = spark.read.parquet(f"{data}/documents.parquet")
    assert sorted((tuple(r) for r in substring_dedup.op13(given).collect()), key=str) == brute_windows([(r["doc_id"], r["text"]) for r in given.collect()])


def test_segments(monkeypatch):
    """A text read in segments gives the places, links and spans that it gives in one piece."""
    rng = random.Random(3)
    long = " ".join(rng.choice("abc") * rng.randint(1, 2) if rng.random() < 0.5 else f"w{rng.randint(0, 90)}" for _ in range(6000)).encode()
    rows = [long, b"x " * 49, b"y " * 50, b" ".join(long.split()[900:1700])]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4), pa.int64()), "mark": pa.array([0] * 4, pa.int64()), "text": rows, "lows": [[100, 700], [], [0], [0]], "highs": [[400, 2000], [], [30], [260]]})
    whole = [sorted(tuple(r.values()) for b in f(iter([batch])) for r in b.to_pylist()) for f in (substring_dedup._edges, substring_dedup._places, substring_dedup._hanging, substring_dedup._cut)]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 500)
    parts = substring_dedup.slices
    monkeypatch.setattr(substring_dedup, "slices", lambda raw: parts(raw, 900))
    cut = [sorted(tuple(r.values()) for b in f(iter([batch])) for r in b.to_pylist()) for f in (substring_dedup._edges, substring_dedup._places, substring_dedup._hanging, substring_dedup._cut)]
    assert cut == whole and all(whole)
    assert b" ".join(b" ".join(p.split()) for p in parts(long, 37)) == long
