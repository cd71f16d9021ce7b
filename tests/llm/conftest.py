import random

import pytest
from pyspark.sql import types as T

CLASHES = ["fp", "doc", "core", "low", "mark", "leaf", "bucket", "k", "h", "score", "gone", "row", "n_lines", "n_dropped", "_text", "_id", "__text", "__mark", "n_bytes", "start", "seq"]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls anywhere, empty and very long texts, ties and repeats, and extra columns with clashing names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(200)
    line = "Alpha beta gamma delta epsilon zeta eta."
    rows = [
        (1, None), (2, ""), (3, base), (4, base), (3, base), (None, base), (None, None), (5, base.replace(words[0], "changed")), (6, text(9000)), (7, "one two"),
        (8, "aaaa " * 900), (9, f"{line}\n{text(30)}"), (10, f"{text(20)}\n{line}"), (11, f"{line}\n{line}"), (12, "!!! ??? ..."), (13, "日本語 😀 é́ ß İ"), (14, "x" * 30000), (15, " \n\t "),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHES])
    return spark.createDataFrame([(*r, *([None] * len(CLASHES))) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows(edge):
    return [(r["doc_id"], r["text"]) for r in edge.collect()]


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
