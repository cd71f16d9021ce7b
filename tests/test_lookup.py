"""Companies by names nearly theirs, against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from leadlens.operators import lookup


def names(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out = []
    for b in base:
        c = list(b)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(c) + 1)
            c[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        out += [b, "".join(c)]
    return out


def test_ratio():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert lookup.ratio(a, b) == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio(), abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_misses_nothing(spark, seed):
    held = names(120, seed) + ["axbc", "Acme Holding", "acme  holding", None, ""]
    asked = names(25, seed) + ["abyc", "ACME HOLDING", "holding acme", "", None]
    companies = spark.createDataFrame(list(enumerate(held)), "id long, name string")
    queries = spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(asked)], "query string, name string")
    got = {(r["query"], r["id"]): r["similarity"] for r in lookup.lookup(queries, companies, most=10_000).collect()}
    low = lambda t: (t or "").strip().lower()
    words = lambda t: set(low(t).split())
    want = {}
    for k, q in enumerate(asked):
        if low(q):
            sure = [i for i, h in enumerate(held) if low(h) and words(q) <= words(h)]
            for i, h in enumerate(held):
                r = SequenceMatcher(None, low(q), low(h), autojunk=False).ratio()
                if low(h) and (i in sure or (len(sure) < lookup.LEAST_HITS and r >= lookup.LEAST_RATIO)):
                    want[f"q{k}", i] = round(r, 6)
    assert got == want


def test_plan_reads_the_index_by_key(spark):
    companies = spark.createDataFrame([(k, f"name {k}") for k in range(20)], "id long, name string")
    plan = lookup.lookup(companies.selectExpr("string(id) AS query", "name"), companies)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        lookup.lookup(companies.selectExpr("string(id) AS query", "name"), companies, least=0.5)
