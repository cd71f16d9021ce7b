"""Bounded, deterministic samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(docs: DataFrame, modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder 0 of nothing (null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


#: Characters of a sample's texts of one label, about; the row that passes it is the last.
CHARS_A_CLASS = 4_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows_a_class: int, chars_a_class: int = CHARS_A_CLASS) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows_a_class`` documents of either label, whole texts whatever their length.

    Documents are taken in the order of a hash of their id and text, which doesn't
    depend on partitioning, until either bound is reached: so many rows of either
    label, or so many characters. Never a row whose remainder is ``held_out``. A
    document with several label rows counts with the largest label; null labels and
    null texts are left out; rows of one doc_id and text count once.
    """
    names = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    names = names.where(remainder(names, modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("mark", F.xxhash64("doc_id", "text"))
    # ids first, so that texts move for the chosen rows only
    short = own.select("doc_id", "mark", F.length("text").alias("n")).join(names, "doc_id")
    chosen = []
    for y in (0, 1):
        total = 0
        for r in short.where(F.col("y") == y).distinct().orderBy("mark", "doc_id").limit(rows_a_class).collect():  # bounded by rows_a_class
            if total >= chars_a_class:
                break
            total += r["n"]
            chosen.append((r["doc_id"], r["mark"], y))
    if not chosen:
        return []
    keys = docs.sparkSession.createDataFrame(chosen, "doc_id long, mark long, y int")
    rows = own.join(F.broadcast(keys), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("text", "y", "doc_id").collect()  # 2 * rows_a_class rows
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["y"]) for r in rows]
