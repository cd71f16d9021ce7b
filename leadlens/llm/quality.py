"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of hashed byte trigrams and of a few shape terms
(repetition, capitals, punctuation, digits), weighted by tf-idf with document
frequencies of all documents, and projected on the leading singular vectors of
a labelled sample. The sample's vectors are broadcast (bounded rows); for every
document the exact cosines to all of them are computed block by block, and the
nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, texts
from leadlens.llm.sample import labelled, remainder

BITS, RANK, NEIGHBOURS = 12, 48, 20
#: The labelled sample: documents of either label at most (and ``sample.CHARS_A_CLASS`` characters).
ROWS_A_CLASS = 1500
THRESHOLD, MODULUS, HELD_OUT = 0.7, 4, 2
#: Bounds between the bins of each shape term, and the terms' weight beside the trigrams.
SHAPES = {
    "repeated": (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "capitals": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75),
    "marks": (0.01, 0.03, 0.05, 0.08, 0.15, 0.25, 0.4),
    "digits": (0.002, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6),
}
SHAPE_WEIGHT = 0.35
TERMS = (1 << BITS) + 8 * len(SHAPES)
#: Documents whose term counts are held together.
ROWS = 256


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.int64)  # 1 capital, 2 mark, 3 digit
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 if c.isupper() else 3 if c.isdigit() else 2 if not c.isalpha() and not c.isspace() else 0
    return kinds


KINDS = _byte_kinds()


def terms(rows: list[str]) -> np.ndarray:
    """(rows, TERMS) float32 of log term frequencies, the trigram part of unit length, shape terms of a fixed weight."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n\n" for t in rows]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(rows)), size)
    big = flat.astype(np.uint32)
    h = (big[:-2] * np.uint32(0x9E3779B1) + big[1:-1] * np.uint32(0x85EBCA77) + big[2:] * np.uint32(0xC2B2AE3D)) & np.uint32(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    whole = row[:-2] == row[2:]
    out = np.zeros((len(rows), TERMS), np.float32)
    grams = np.bincount((row[:-2][whole] << BITS) + h[whole], minlength=len(rows) << BITS).reshape(len(rows), -1).astype(np.float32)
    n = np.maximum(grams.sum(axis=1), 1)
    kinds = np.bincount(row * 4 + KINDS[flat], minlength=4 * len(rows)).reshape(-1, 4) / np.maximum(size - 2, 1)[:, None]
    shapes = ((grams**2).sum(axis=1) / n**2, kinds[:, 1], kinds[:, 2], kinds[:, 3])
    tf = np.log1p(grams)
    out[:, : 1 << BITS] = tf
    for k, (value, bounds) in enumerate(zip(shapes, SHAPES.values())):
        out[np.arange(len(rows)), (1 << BITS) + 8 * k + np.searchsorted(bounds, value)] = 1
    return out


def _parts(rows: list[str]) -> Iterator[np.ndarray]:
    for k in range(0, len(rows), ROWS):
        yield terms(rows[k : k + ROWS])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in blocks(batches):
            for part in _parts(texts(batch)):
                total += (part > 0).sum(axis=0)
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], total]))], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r["term"] + 1] = r["n"]
    return out[1:], int(out[0])


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray

    def weighted(self, part: np.ndarray) -> np.ndarray:
        part = part * self.idf
        grams, shapes = part[:, : 1 << BITS], part[:, 1 << BITS :]
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        shapes *= SHAPE_WEIGHT / max(1e-9, float(self.idf[1 << BITS :].mean()))
        return part

    def latent(self, part: np.ndarray) -> np.ndarray:
        out = self.weighted(part) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = []
        for part in _parts(rows):
            if not len(self.votes):
                out.append(np.full(len(part), 0.5))
                continue
            cosine = self.latent(part) @ self.vectors.T
            k = min(neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 4
            out.append((weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit(rows: list[tuple[str, int]], frequency: np.ndarray, n: int, rank: int = RANK, seed: int = 5) -> Model:
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    model = Model(idf, np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    if not rows:
        return model
    matrix = np.concatenate([model.weighted(p) for p in _parts([t for t, _ in rows])])
    rng = np.random.default_rng(seed)
    space = rng.normal(size=(TERMS, rank + 8)).astype(np.float32)
    for _ in range(3):  # randomized singular vectors by power iteration
        space, _ = np.linalg.qr(matrix.T @ (matrix @ space))
    _, _, right = np.linalg.svd(matrix @ space, full_matrices=False)
    model.basis = np.ascontiguousarray((space @ right.T)[:, :rank])
    out = matrix @ model.basis
    model.vectors = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    model.votes = np.array([y for _, y in rows], np.float64)
    return model


def train(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> Model:
    """A model of at most ``rows_a_class`` labelled documents of either class, none held out; term statistics of all documents."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return fit(labelled(docs, labels, "quality", MODULUS, HELD_OUT, rows_a_class), *document_frequencies(docs))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: whole texts; null text counts as empty and is scored like one.

    A null doc_id stays null; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result. Without any labelled row
    every score is 0.5. Of neighbours that tie at the border of the nearest ones any may vote.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * rows_a_class short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(held.value.score(texts(batch)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(out, MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
