"""Companies by a name that is nearly theirs: an inverted index of bigrams, then the similarity of what it finds.

Names of joint length T and Ratcliff-Obershelp ratio r have M = r T / 2 letters
matched, in runs of which two are parted by an unmatched letter at least: at most
T - 2 M + 1 runs, so M less that many bigrams in common. From r = 0.75 on that is
one or more, but for T of 5 or 8; so names of up to five letters go by their
letters. A name's candidates are the companies that hold one of its rarest bigrams,
as many as that bound leaves, and whose length fits: none of the wanted ratio is
missing, and the index is read by key, not scanned by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of a lookup; hits by words below which similar names are looked for too.
MOST, LEAST_HITS = 10, 3
#: The least ratio for which the index is exact (see above).
LEAST_RATIO = 0.75
#: Names up to this length go by letters; no longer than the second are those that one of them can be like.
SHORT, SHORT_REACH = 5, 8


def spelling(name: Column) -> Column:
    """What is compared: lower case, trimmed; null as blank."""
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def _bag(text: Column, n: int) -> Column:
    """The runs of ``n`` letters, numbered among equal ones, so that sets of them count as bags."""
    plain = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.transform(plain, lambda g, i: F.concat(F.lit(f"{n}:"), g, F.lit("#"), F.size(F.filter(F.slice(plain, 1, i + 1), lambda x: x == g)).cast("string")))


def index(companies: DataFrame) -> DataFrame:
    """(gram, held, id, name, length) of companies (id, name): bigrams, of short names letters too; held: companies with the gram."""
    own = companies.select("id", "name", spelling(F.col("name")).alias("text")).where(F.length("text") > 0)
    both = F.when(F.length("text") <= SHORT_REACH, F.concat(_bag(F.col("text"), 2), _bag(F.col("text"), 1))).otherwise(_bag(F.col("text"), 2))
    grams = own.select("id", "name", F.length("text").alias("length"), F.explode(both).alias("gram"))
    return grams.join(grams.groupBy("gram").agg(F.count("*").alias("held")), "gram").select("gram", "held", "id", "name", "length")


def _longest(a: str, b: str, i: int, j: int, k: int, m: int) -> tuple[int, int, int]:
    """Begin in both and size of the longest common run of a[i:j] and b[k:m]; of several the first in a, then in b."""
    best, row = (i, k, 0), [0] * (m - k + 1)
    for x in range(i, j):
        new = [0] * (m - k + 1)
        for y in range(k, m):
            if a[x] == b[y]:
                n = new[y - k + 1] = row[y - k] + 1
                if n > best[2]:
                    best = (x - n + 1, y - n + 1, n)
        row = new
    return best


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp: twice the matched letters over all; the longest common run, then the same on both sides of it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        x, y, n = _longest(a, b, i, j, k, m) if i < j and k < m else (0, 0, 0)
        if n:
            total += n
            todo += [(i, x, k, y), (x + n, j, y + n, m)]
    return 2 * total / (len(a) + len(b)) if a or b else 1.0


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["similarity"] = [ratio(x, y) for x, y in zip(b["text"], b["other"])]
        yield b.drop(columns=["text", "other"])


def lookup(names: DataFrame, companies: DataFrame, most: int = MOST, least_hits: int = LEAST_HITS, least: float = LEAST_RATIO) -> DataFrame:
    """query, id, name, similarity, rank: for each name (query, name) its ``most`` likeliest companies (id, name).

    Candidates are the companies that hold all words of the name; if they are
    fewer than ``least_hits``, those of a ratio of ``least`` or more too. Ties go by id. A blank name finds nothing.
    """
    if least < LEAST_RATIO:
        raise ValueError(f"the index is exact from a ratio of {LEAST_RATIO} on")
    asked = names.select("query", spelling(F.col("name")).alias("text")).where(F.length("text") > 0).distinct()
    words = lambda text: F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    held = companies.select("id", "name", F.explode(words(spelling(F.col("name")))).alias("word"))
    wanted = asked.select("query", "text", words(F.col("text")).alias("words"))
    by_word = wanted.select("query", "text", F.size("words").alias("all"), F.explode("words").alias("word")).join(held, "word").groupBy("query", "text", "id", "name").agg(F.count("*").alias("n"), F.first("all").alias("all")).where("n = all").select("query", "text", "id", "name")
    enough = by_word.groupBy("query").agg(F.count("*").alias("hits")).where(F.col("hits") >= least_hits).select("query")
    few = asked.join(enough, "query", "left_anti")
    entries = index(companies)
    held_by = entries.select("gram", "held").distinct()
    span = least / (2 - least)  # of lengths, at that ratio
    shortest = F.ceil(F.length("text") * span)
    short = F.length("text") <= SHORT
    joint = F.length("text") + shortest
    shared = F.greatest(F.lit(1), F.ceil(F.when(short, F.lit(least / 2) * joint).otherwise(F.lit(1.5 * least - 1) * joint - 1) - 1e-9))
    own = F.when(short, _bag(F.col("text"), 1)).otherwise(_bag(F.col("text"), 2))
    grams = few.select("query", "text", shared.alias("shared"), F.explode(own).alias("gram")).join(held_by, "gram", "left")
    rank = F.row_number().over(Window.partitionBy("query", "text").orderBy(F.coalesce("held", F.lit(0)), "gram"))
    size = F.when(short, F.length("text")).otherwise(F.length("text") - 1)
    rare = grams.withColumn("n", rank).where((F.col("n") <= size - F.col("shared") + 1) & F.col("held").isNotNull())
    fits = F.least(F.length("text"), F.col("length")) >= F.lit(span) * F.greatest(F.length("text"), F.col("length")) - 1e-9
    by_gram = rare.select("query", "text", "gram").join(entries.drop("held"), "gram").where(fits).select("query", "text", "id", "name").distinct()
    pairs = by_word.withColumn("sure", F.lit(True)).unionByName(by_gram.withColumn("sure", F.lit(False))).groupBy("query", "text", "id", "name").agg(F.max("sure").alias("sure"))
    told = pairs.select("query", "id", "name", "sure", "text", spelling(F.col("name")).alias("other")).mapInPandas(_ratios, "query string, id long, name string, sure boolean, similarity double")
    best = told.where(F.col("sure") | (F.col("similarity") >= least)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
    return best.where(F.col("rank") <= most).select("query", "id", "name", F.round("similarity", 6).alias("similarity"), "rank")

