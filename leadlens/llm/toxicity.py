"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Input is a sequence of words. A word is described by its embedding (hashed), by the
last states of a smaller bidirectional gated network that reads its characters,
one embedding each, and by the log-odds of its hash and of its character
four-grams in the fitting sample. The network reads overlapping windows of
words in both directions; attention pools the states of a window into one
logit, and a document's score is that of its highest window. Embeddings and both networks are
trained together by backpropagation through time in numpy on a bounded sample
of labelled documents; a document's label is taught to the window that the
current model scores highest in it (and to as many others of documents that
aren't toxic).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, code_points, column, mix, texts, words_of
from leadlens.llm.sample import labelled, remainder

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 4
#: States of the character network in either direction, its letters (one embedding each), and the most that a word has; longer ones are read as several.
CHAR_HIDDEN, LETTERS, LONGEST = 4, 192, 24
WORD_BITS, EMBED_BITS, GRAM_BITS, GRAM = 16, 12, 16, 4
#: The fitting sample: documents of either label at most (and ``sample.CHARS_A_CLASS`` characters).
ROWS_A_CLASS = 1500
THRESHOLD = 0.5
#: Passes over the sample, and step sizes (of the word embeddings a smaller one: each sees few words).
EPOCHS, RATE, EMBED_RATE = 6, 0.01, 0.001
#: Windows that go through the recurrent steps together.
LANES = 1024
MODULUS, HELD_OUT = 5, 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Words:
    """The words of some texts: bucket, first word of each row (plus the total), four-gram buckets of all places, begins, ends; and their distinct spellings."""

    def __init__(self, rows: list[str]):
        flat, starts = code_points([t + "\n\n" for t in rows])  # so that no four-gram reaches into the next text
        low, self.begin, self.end, hashes, self.first = words_of(flat, starts, LONGEST)
        self.bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        c = np.concatenate([[0], low, np.zeros(GRAM, np.uint32)]).astype(np.uint64)  # a place before each word shows its edge
        acc = np.zeros(len(low) + 1, np.uint64)
        for k in range(GRAM):
            acc = acc * np.uint64(1000003) + c[k : k + len(acc)]
        self.grams = (mix(acc) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
        self.known, at, self.spelling = np.unique(hashes, return_index=True, return_inverse=True)
        size = (self.end - self.begin)[at]
        place = np.minimum(self.begin[at][:, None] + np.arange(LONGEST), max(len(low) - 1, 0))
        point = low[place] if len(at) else np.zeros((0, LONGEST), np.uint32)
        letters = np.where(point < 128, point, 128 + point % (LETTERS - 128)).astype(np.uint8)
        self.letters, self.size = np.where(np.arange(LONGEST) < size[:, None], letters, 0).astype(np.uint8), size


class Sample:
    """The words of many texts, piece by piece: what of ``Words`` the network reads, and the odds of each word."""

    def __init__(self, parts: list[tuple[Words, np.ndarray]]):
        self.bucket = np.concatenate([w.bucket for w, _ in parts])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.first) for w, _ in parts]))])
        self.odds = np.concatenate([o for _, o in parts])
        known, at = np.unique(np.concatenate([w.known for w, _ in parts]), return_index=True)
        self.letters, self.size = np.concatenate([w.letters for w, _ in parts])[at], np.concatenate([w.size for w, _ in parts])[at]
        self.spelling = np.concatenate([np.searchsorted(known, w.known)[w.spelling] for w, _ in parts])


def pieces(rows: list[str], chars: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """The rows in runs of about ``chars`` characters, with the place of each run's first: bounds the memory of a scan."""
    begin, held = 0, 0
    for k, text in enumerate(rows):
        if held and held + len(text) > chars:
            yield begin, rows[begin:k]
            begin, held = k, 0
        held += len(text)
    if rows:
        yield begin, rows[begin:]


class Model:
    """Parameters; picklable, a few megabytes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.word_odds, self.gram_odds = np.zeros(1 << WORD_BITS, f), np.zeros(1 << GRAM_BITS, f)
        h, c = HIDDEN, CHAR_HIDDEN
        self.inputs = 3 + EMBED + 2 * c
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(f)
        self.p = {
            "E": normal(0.05, 1 << EMBED_BITS, EMBED), "C": normal(0.5, LETTERS, EMBED), "Wc": normal(0.3, 2, EMBED, 3 * c), "Uc": normal(0.3, 2, c, 3 * c), "bc": np.zeros((2, 3 * c), f),
            "W": normal(0.3, 2, self.inputs, 3 * h), "U": normal(0.3, 2, h, 3 * h), "b": np.zeros((2, 1, 3 * h), f),
            "A": normal(0.3, 2 * h, h), "a": normal(0.3, h), "v": normal(0.3, 2 * h), "c": np.zeros(1, f),
        }

    # ---- features
    def fit_odds(self, rows: list[str], y: np.ndarray) -> None:
        counts = [np.zeros((2, len(odds))) for odds in (self.word_odds, self.gram_odds)]
        for begin, part in pieces(rows):
            w = Words(part)
            row = np.repeat(np.arange(len(part)), np.diff(w.first))
            for held, (bucket, doc) in zip(counts, ((w.bucket, row), self._grams_with_rows(w, row))):
                seen = np.unique(doc.astype(np.int64) * held.shape[1] + bucket)
                doc, bucket = seen // held.shape[1], seen % held.shape[1]
                for label in (0, 1):
                    held[label] += np.bincount(bucket[y[begin + doc] == label], minlength=held.shape[1])
        blur = 3 / max(8, len(y))  # a bucket needs several documents to stand out
        for odds, (neg, pos) in zip((self.word_odds, self.gram_odds), counts):
            odds[:] = np.clip(np.log((pos / max(1, (y == 1).sum()) + blur) / (neg / max(1, (y == 0).sum()) + blur)), -3, 5) / 2

    @staticmethod
    def _grams_with_rows(w: Words, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = w.end - w.begin + 1
        at = np.arange(size.sum()) + np.repeat(w.begin - (np.cumsum(size) - size), size)
        return w.grams[at], np.repeat(row, size)

    def odds(self, w: Words) -> np.ndarray:
        """(words, 3): word odds, greatest and mean four-gram odds."""
        out = np.zeros((len(w.bucket), 3), np.float32)
        if len(out):
            odds = self.gram_odds[w.grams]
            # places begin-1+1 .. end of the shifted array are the word's own: cut by reduceat between begin and end
            cut = np.minimum(np.stack([w.begin, w.end + 1], 1).ravel(), len(odds) - 1)
            out[:, 0] = self.word_odds[w.bucket]
            out[:, 1] = np.maximum.reduceat(odds, cut)[::2]
            out[:, 2] = np.add.reduceat(odds, cut)[::2] / (w.end - w.begin + 1)
        return out

    def inputs_of(self, odds: np.ndarray, bucket: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Odds, word embeddings, and the states of the character network (``spelt``), side by side."""
        return np.concatenate([odds, self.p["E"][bucket & ((1 << EMBED_BITS) - 1)], spelt], axis=-1)

    # ---- character network
    def spell(self, letters: np.ndarray, size: np.ndarray, keep: bool = False):
        """(n, 2 * CHAR_HIDDEN): the last states of the network that reads each word's letters forward and backward."""
        p, c = self.p, CHAR_HIDDEN
        order = np.argsort(-size, kind="stable")
        letters, size = letters[order], size[order]
        known = np.matmul(p["C"], p["Wc"]) + p["bc"][:, None]  # (2, LETTERS, 3c)
        state, kept = np.zeros((2, len(size), c), p["C"].dtype), []
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k, "left"))  # words that have a letter left
            read = np.stack([letters[:n, k], letters[np.arange(n), size[:n] - 1 - k]])
            old = state[:, :n]
            g, r = np.stack([known[0][read[0]], known[1][read[1]]]), np.matmul(old, p["Uc"])
            zr = _sigmoid(g[..., : 2 * c] + r[..., : 2 * c])
            cand = np.tanh(g[..., 2 * c :] + zr[..., c:] * r[..., 2 * c :])
            if keep:
                kept.append((n, read, old.copy(), zr, cand, r[..., 2 * c :]))
            state[:, :n] = old + zr[..., :c] * (cand - old)
        out = np.empty((len(size), 2 * c), state.dtype)
        out[order] = np.concatenate([state[0], state[1]], axis=1)
        return (out, (order, kept)) if keep else out

    def spell_back(self, saved, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the character network for d = d loss / d states."""
        p, c = self.p, CHAR_HIDDEN
        order, kept = saved
        ds = np.stack([d[order, :c], d[order, c:]])
        table, g = np.zeros((2, LETTERS, 3 * c), d.dtype), np.zeros_like(p["Uc"])
        for n, read, old, zr, cand, rc in reversed(kept):
            z, r, own = zr[..., :c], zr[..., c:], ds[:, :n]
            dz = own * (cand - old) * z * (1 - z)
            dc = own * z * (1 - cand**2)
            dr = dc * rc * r * (1 - r)
            rec = np.concatenate([dz, dr, dc * r], axis=-1)
            for side in (0, 1):
                np.add.at(table[side], read[side], np.concatenate([dz[side], dr[side], dc[side]], axis=-1))
            g += np.matmul(old.transpose(0, 2, 1), rec)
            ds[:, :n] = own * (1 - z) + np.matmul(rec, p["Uc"].transpose(0, 2, 1))
        return {"Uc": g, "bc": table.sum(axis=1), "Wc": np.matmul(p["C"].T, table), "C": np.matmul(table, p["Wc"].transpose(0, 2, 1)).sum(axis=0)}

    # ---- network
    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (time, windows, inputs) and its mask (0 past a text's end); the logit of each window."""
        x, mask = x
        p, h = self.p, HIDDEN
        t, n, _ = x.shape
        both = np.stack([x, x[::-1]])
        pre = np.matmul(both.reshape(2, t * n, -1), p["W"]).reshape(2, t, n, 3 * h) + p["b"][:, None]
        m = np.stack([mask, mask[::-1]])
        state = np.zeros((2, n, h), x.dtype)
        states = np.zeros((2, t, n, h), x.dtype)
        kept = []
        for k in range(t):
            r = np.matmul(state, p["U"])
            g = pre[:, k]
            zr = _sigmoid(g[..., : 2 * h] + r[..., : 2 * h])
            cand = np.tanh(g[..., 2 * h :] + zr[..., h:] * r[..., 2 * h :])
            z = zr[..., :h] * m[:, k, :, None]  # past the text's end the state stays
            if keep:
                kept.append((state, zr, cand, r[..., 2 * h :]))
            state = state + z * (cand - state)
            states[:, k] = state
        joined = np.concatenate([states[0], states[1, ::-1]], axis=-1)
        hid = np.tanh(joined @ p["A"])
        score = hid @ p["a"] + np.where(mask > 0, 0, -1e9).astype(x.dtype)
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = (weight[..., None] * joined).sum(axis=0)
        logit = pooled @ p["v"] + p["c"][0]
        return (logit, (both, m, kept, joined, hid, weight, pooled)) if keep else logit

    def backward(self, saved, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the word network and of its inputs for d = d loss / d logit of each window."""
        both, m, kept, joined, hid, weight, pooled = saved
        p, h = self.p, HIDDEN
        g = {"v": pooled.T @ d, "c": np.array([d.sum()], d.dtype)}
        dp = d[:, None] * p["v"]
        dj = weight[..., None] * dp
        dw = (joined * dp).sum(axis=-1)
        ds = weight * (dw - (weight * dw).sum(axis=0))
        g["a"] = np.einsum("tn,tnh->h", ds, hid)
        dh = ds[..., None] * p["a"] * (1 - hid**2)
        g["A"] = np.einsum("tni,tnh->ih", joined, dh)
        dj = dj + dh @ p["A"].T
        t, n = both.shape[1:3]
        out = np.stack([dj[..., :h], dj[::-1, :, h:]])
        g |= {k: np.zeros_like(p[k]) for k in "WUb"}
        dx = np.zeros_like(both)
        ds_ = np.zeros((2, n, h), d.dtype)
        for k in range(t - 1, -1, -1):
            ds_ = ds_ + out[:, k]
            state, zr, cand, rc = kept[k]
            z_, r_ = zr[..., :h], zr[..., h:]
            mask = m[:, k, :, None]
            dz = ds_ * (cand - state) * mask * z_ * (1 - z_)
            dc = ds_ * z_ * mask * (1 - cand**2)
            dr = dc * rc * r_ * (1 - r_)
            rec = np.concatenate([dz, dr, dc * r_], axis=-1)
            pre = np.concatenate([dz, dr, dc], axis=-1)
            g["W"] += np.matmul(both[:, k].transpose(0, 2, 1), pre)
            g["b"] += pre.sum(axis=1, keepdims=True)
            g["U"] += np.matmul(state.transpose(0, 2, 1), rec)
            dx[:, k] = np.matmul(pre, p["W"].transpose(0, 2, 1))
            ds_ = ds_ * (1 - z_ * mask) + np.matmul(rec, p["U"].transpose(0, 2, 1))
        return g, dx[0] + dx[1, ::-1]

    def loss_step(self, words: Words | Sample, odds: np.ndarray, at: np.ndarray, slope) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits of the windows ``at`` (time, windows; -1: none) and all gradients, for d = slope(logits)."""
        mask = (at >= 0).astype(odds.dtype)
        used, inverse = np.unique(words.spelling[at], return_inverse=True)
        inverse = inverse.reshape(at.shape)
        spelt, saved_letters = self.spell(words.letters[used], words.size[used], keep=True)
        x = self.inputs_of(odds[at], words.bucket[at], spelt[inverse]) * mask[..., None]
        logit, saved = self.forward((x, mask), keep=True)
        grads, dx = self.backward(saved, slope(logit))
        dx = dx * mask[..., None]
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], (words.bucket[at] & ((1 << EMBED_BITS) - 1)).ravel(), dx[..., 3 : 3 + EMBED].reshape(-1, EMBED))
        d = np.zeros((len(used), 2 * CHAR_HIDDEN), dx.dtype)
        np.add.at(d, inverse.ravel(), dx[..., 3 + EMBED :].reshape(-1, 2 * CHAR_HIDDEN))
        return logit, grads | self.spell_back(saved_letters, d)

    # ---- windows
    @staticmethod
    def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word index (windows, WINDOW) of all overlapping windows, -1 past a row's end; first window of each row (plus the total)."""
        count = np.diff(first)
        per = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
        starts = np.concatenate([[0], np.cumsum(per)])
        row = np.repeat(np.arange(len(count)), per)
        begin = first[row] + (np.arange(starts[-1]) - starts[row]) * STRIDE
        at = begin[:, None] + np.arange(WINDOW)
        return np.where(at < first[row + 1][:, None], at, -1).astype(np.int32), row, starts

    def logits(self, words: Words | Sample, odds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logit of each window (windows, WINDOW) of word places, -1 for none."""
        out = np.zeros(len(at), np.float32)
        if not len(at):
            return out
        spelt = self.spell(words.letters, words.size)
        for k in range(0, len(at), LANES):
            part = np.ascontiguousarray(at[k : k + LANES].T)
            mask = (part >= 0).astype(np.float32)
            x = self.inputs_of(odds[part], words.bucket[part], spelt[words.spelling[part]]) * mask[..., None]
            out[k : k + LANES] = self.forward((x, mask))
        return out

    def score(self, rows: list[str]) -> np.ndarray:
        """Score of each text: of its highest window; a text without words has the lowest one, 0."""
        words = Words(rows)
        at, row, starts = self.windows(words.first)
        best = np.full(len(rows), -np.inf, np.float32)
        np.maximum.at(best, row, self.logits(words, self.odds(words), at))
        return _sigmoid(best.astype(np.float64))

    def fit(self, rows: list[str], y: list[int], epochs: int = EPOCHS, seed: int = 11) -> Model:
        y = np.array(y, np.int64)
        if not len(y) or y.min() == y.max():  # nothing to learn from: one class only
            self.p["v"][:] = 0
            self.p["c"][0] = 4.0 if len(y) and y[0] else -4.0
            return self
        rng = np.random.default_rng(seed)
        # each half is described with the odds of the other, or a rare word would seem to tell its own document's label
        halves = np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)
        parts = []
        for own, other in (halves, halves[::-1]):
            self.fit_odds([rows[i] for i in other], y[other])
            for _, part in pieces([rows[i] for i in own]):
                w = Words(part)
                parts.append((w, self.odds(w)))
                del w.grams, w.begin, w.end
        words = Sample(parts)
        odds = words.odds
        del parts
        self.fit_odds(rows, y)
        y = y[np.concatenate(halves)]
        at, row, starts = self.windows(words.first)
        value = np.append(odds[:, 0] + odds[:, 1], np.float32(0))[at].max(axis=1)  # before the first epoch: the window with the strongest word
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            if epoch:
                value = self.logits(words, odds, at)
            order = np.lexsort((value, row))
            top = order[np.searchsorted(row[order], np.arange(len(rows)), "right") - 1]
            top = top[np.diff(starts) > 0]
            pos = top[y[row[top]] == 1]
            neg_all = np.flatnonzero(y[row] == 0)
            hard = top[y[row[top]] == 0]
            neg = np.concatenate([hard, rng.choice(neg_all, min(len(neg_all), len(hard)), replace=False)]) if len(neg_all) else neg_all
            reps = max(1, 1200 // max(1, len(pos) + len(neg)))
            use = np.concatenate([np.concatenate([pos, neg])] * reps)
            weight = np.where(y[row[use]] == 1, 0.35 / max(1, len(pos)), 0.65 / max(1, len(neg))).astype(np.float32)
            weight *= len(pos) + len(neg)
            perm = rng.permutation(len(use))
            for k in range(0, len(use), 64):
                sel = perm[k : k + 64]
                slope = lambda logit: ((_sigmoid(logit) - y[row[use[sel]]]) * weight[sel] / len(sel)).astype(np.float32)  # noqa: B023, E731
                _, grads = self.loss_step(words, odds, np.ascontiguousarray(at[use[sel]].T), slope)
                step += 1
                for name, grad in grads.items():
                    grad = grad + 1e-4 * self.p[name]
                    mean[name] += 0.1 * (grad - mean[name])
                    square[name] += 0.001 * (grad**2 - square[name])
                    rate = EMBED_RATE if name == "E" else RATE
                    self.p[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> Model:
    """A model from at most ``rows_a_class`` labelled documents of either class, none held out."""
    rows = labelled(docs, labels, "toxic", MODULUS, HELD_OUT, rows_a_class)
    return Model().fit([t for t, _ in rows], [y for _, y in rows])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): all windows of whole texts.

    Null and empty texts, and texts without letters or digits, score 0; a null
    doc_id stays null; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, size=1 << 19):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(held.value.score(texts(batch)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(out, MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns are kept, in one scan.

    Each row is judged by its own text: null and empty texts and texts without
    words score 0 and stay, repeated rows go or stay together, ids (null ones too) play no part; an
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, size=1 << 19):
            yield batch.filter(pa.array(held.value.score(texts(batch)) < threshold))

    return docs.mapInArrow(run, docs.schema)
