"""Importance resampling against plain counts, and its SQL on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from leadlens.llm import conversations, resampling

UPPER = str.maketrans(resampling.UPPER, resampling.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_draw(rows, target, longest=1, percent=10, least=20, buckets=10_000, seed=2024):
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(b for x in texts for b in features(x)) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * big_s / (float(s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = collections.defaultdict(list)
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        drawn[r].append(k + 1)
    left = {r: list(v) for r, v in drawn.items()}
    return sorted(((*r[:4], left[r].pop() if left.get(r) else None) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_draw(spark, data, edge, edge_rows, none):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, target = [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()]
    assert got(resampling.resample(docs, bench)) == brute_draw(rows, target)
    assert got(resampling.resample(edge, bench.limit(3))) == brute_draw(edge_rows, [r["text"] for r in bench.limit(3).collect()])
    assert got(resampling.resample(edge, bench.limit(0), percent=60, least_words=1)) == brute_draw(edge_rows, [], percent=60, least=1)
    assert resampling.resample(none, bench).count() == 0


def test_repeated_rows_and_longer_features(spark, monkeypatch):
    rows = [(i % 7, f"Alpha beta {'gamma ' * (i % 3)}É日 {i % 7}") for i in range(60)] + [(3, None), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(4)
    target = spark.createDataFrame([("beta gamma delta",), (None,)], "text string")
    monkeypatch.setattr(resampling, "SPAN", 4)
    for longest in (1, 3):
        assert got(resampling.resample(docs, target, percent=50, least_words=2, longest=longest)) == brute_draw(rows, ["beta gamma delta", None], longest, 50, 2)


def test_sql_on_odd_rows(spark):
    """The SQL of op11 and op12 on nulls, repeats and letters of other scripts."""
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": pd.array([1, 2, 3, 4, None, 6], "Int64"), "text": ["É日 a0-B " * 12, None, "", "a " * 30, "b a\n" * 15, "a " * 30]})
    benchmark = pd.DataFrame({"text": ["a b", None]})
    docs = spark.createDataFrame([(None if pd.isna(d) else int(d), t) for d, t in documents.itertuples(index=False)], "doc_id long, text string")
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    rows = lambda sql: sorted(con.execute(sql).fetchall(), key=str)
    assert rows(resampling.ORACLE) == got(resampling.resample(docs, spark.createDataFrame([("a b",), (None,)], "text string")))
    talks = [(c, t, r, x) for c in (1, 2, None) for t, r, x in ((0, "user", "Hi."), (1, "assistant", None), (2, None, "So?"), (None, "user", "Hi."), (2, "", "é!"), (4, "system", "x"))] + [(9, 3, "user", "a")]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks)
    table = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    assert rows(conversations.ORACLE) == sorted((tuple(r) for r in conversations.op12(table).collect()), key=str)
