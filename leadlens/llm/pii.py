"""Personal data by weak supervision.

Base patterns give spans that always stay. Wider patterns give further
candidates (a card number or phone number inside a longer run that failed as a
whole, written-out addresses). Labelers vote on every candidate: its form by
regular expression, its checksum or ranges, gazetteers, and its context.
Expectation-maximisation over all documents' vote patterns estimates how
reliable each labeler is, per kind, and a logistic span classifier is trained
on the posteriors: it sees votes and, by kind, the span's shape (digits,
separators, what stands on either side), which no labeler votes on. Candidates
that it accepts are added to the base spans.

What reaches the driver is a count for each pattern of votes and shape, of which
there is a fixed number at most, whatever the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import blocks, column, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
#: Wider forms, by kind.
WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: Gazetteers: endings of domain names, first digits of card numbers by length, words that go before.
ENDINGS = frozenset("com org net edu gov io co de fr es uk us eu info biz dev app me ch at it nl be pl se no dk fi pt jp cn in br ca au".split())
CONTEXT = {
    "email": frozenset("email mail e-mail contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host server address adresse from client".split()),
    "card": frozenset("card visa mastercard amex credit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon tél teléfono".split()),
}
AGAINST = frozenset("version v license licence section isbn order invoice id no number page chapter password token key secret".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by the base patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # around each @, so that a long run of address characters is read once
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            out.append(("email", start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    if ANY.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the wider patterns that overlap no base span of their kind."""
    if not ANY.search(text):
        return []
    out = []
    for kind, pattern in WIDE.items():
        held = [s for s in base if s[0] == kind]  # in order of start, disjoint
        k = 0
        for m in pattern.finditer(text):
            while k < len(held) and held[k][2] <= m.start():
                k += 1
            if k == len(held) or held[k][1] >= m.end():
                out.append((kind, *m.span()))
    return out


def votes(text: str, span: tuple[str, int, int]) -> tuple[int, ...]:
    """Votes (1 for, -1 against, 0 none) of the labelers: form, check, gazetteer, context, border."""
    kind, start, end = span
    own = text[start:end]
    digits = _digits(own)
    before = re.findall(r"[^\W_]+", text[max(0, start - 40) : start].lower())[-4:]
    if kind == "email":
        form = 1 if "@" in own else -1
        check = 1 if not re.search(r"\.\.|^\.|-\.", own) else -1
        gazetteer = 1 if re.split(r"[^a-z]+", own.lower())[-1] in ENDINGS else -1
    elif kind == "ip":
        parts = own.split(".")
        form = 1 if len(parts) == 4 and all(p == "0" or p[0] != "0" for p in parts) else -1
        check = 1 if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "1", "2", "3") and all(len(p) == 1 for p in parts) else 0
    elif kind == "card":
        form = 1 if len(digits) in (14, 15, 16, 19) else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if (len(digits), digits[0]) in ((16, "4"), (16, "5"), (16, "2"), (16, "6"), (15, "3"), (14, "3"), (19, "6")) else -1
    else:
        form = 1 if own[0] == "+" else 0
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if re.search(r"\(?[2-9][0-9]{2}\)?[ .-]", own) else -1
    context = 1 if CONTEXT[kind] & set(before) else -1 if AGAINST & set(before) else 0
    inside = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "=_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))
    return form, check, gazetteer, context, -1 if inside else 1


#: Values of each part of a shape.
SHAPE = (5, 4, 3, 3)


def shape(text: str, span: tuple[str, int, int]) -> tuple[int, ...]:
    """Digits (none, up to 9, 12, 15, more), separators (none, of one kind, two, more), and what stands before and behind (space, mark, letter or digit)."""
    _, start, end = span
    own = text[start:end]
    side = lambda c: 0 if not c or c.isspace() else 2 if c.isalnum() else 1
    return bisect.bisect_left((0, 9, 12, 15), len(_digits(own))), min(3, len({c for c in own if not c.isalnum()})), side(text[start - 1 : start]), side(text[end : end + 1])


@dataclass
class Model:
    """reliability: per kind, P(vote v | class) of each labeler; weights of the span classifier."""

    reliability: dict[str, np.ndarray]
    prior: dict[str, float]
    weights: np.ndarray

    @staticmethod
    def features(kind: str, v: tuple[int, ...], form: tuple[int, ...]) -> np.ndarray:
        own = KINDS.index(kind)
        out = np.zeros(len(KINDS) + 3 * 5 + len(KINDS) * sum(SHAPE), np.float64)
        out[own] = 1
        for k, x in enumerate(v):
            out[len(KINDS) + 3 * k + x + 1] = 1
        at = len(KINDS) + 3 * 5 + own * sum(SHAPE)
        for x, n in zip(form, SHAPE):
            out[at + x] = 1
            at += n
        return out

    def probability(self, kind: str, v: tuple[int, ...], form: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-self.features(kind, v, form) @ self.weights)))


def fit(counts: dict[tuple[str, tuple[int, ...], tuple[int, ...]], int], rounds: int = 50) -> Model:
    """EM per kind over vote patterns with counts, then a logistic classifier of votes and shapes on the posteriors."""
    reliability, prior, rows = {}, {}, []
    for kind in KINDS:
        voted: dict[tuple[int, ...], int] = {}
        for (k, v, _), c in counts.items():
            if k == kind:
                voted[v] = voted.get(v, 0) + c
        patterns = sorted(voted)
        if not patterns:
            continue
        n = np.array([voted[v] for v in patterns], np.float64)
        votes_ = np.array(patterns) + 1
        post = 1 / (1 + np.exp(-np.array(patterns).sum(axis=1, dtype=np.float64)))  # begin with the majority
        for _ in range(rounds):
            p = (n @ post + 1) / (n.sum() + 2)
            table = np.zeros((2, votes_.shape[1], 3))
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                for k in range(votes_.shape[1]):
                    # a labeler is taken to be right rather than wrong, with the weight of a few spans
                    table[c, k] = np.bincount(votes_[:, k], w, minlength=3) + ((2, 1, 0.5) if c == 0 else (0.5, 1, 2))
            table /= table.sum(axis=2, keepdims=True)
            log = np.log(table[:, np.arange(votes_.shape[1]), votes_]).sum(axis=2)
            post = 1 / (1 + np.exp(np.clip(np.log(1 - p) - np.log(p) + log[0] - log[1], -60, 60)))
        reliability[kind], prior[kind] = table, float(p)
        belief = dict(zip(patterns, post))
        rows += [(Model.features(kind, v, f), belief[v], c) for (k, v, f), c in sorted(counts.items()) if k == kind]
    weights = np.zeros(len(Model.features("email", (), ())))
    if rows:
        x, y, w = (np.array(c) for c in zip(*rows))
        w = np.sqrt(w) / np.sqrt(w).sum()  # rare patterns count too
        for _ in range(400):
            grad = x.T @ (w * (1 / (1 + np.exp(-x @ weights)) - y)) + 1e-4 * weights
            weights -= 4 * grad
    return Model(reliability, prior, weights)


def _pattern_counts(docs: DataFrame) -> dict[tuple[str, tuple[int, ...], tuple[int, ...]], int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in blocks(batches):
            for text in texts(batch):
                if ANY.search(text):
                    base = base_spans(text)
                    for span in base + candidates(text, base):
                        key = f"{span[0]}:" + ":".join(",".join(map(str, x)) for x in (votes(text, span), shape(text, span)))
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 4 * 3**5 * 180 short patterns at most
    out = {}
    for r in rows:
        kind, *parts = r["pattern"].split(":")
        v, form = (tuple(map(int, x.split(","))) for x in parts)
        out[kind, v, form] = r["n"]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``.

    Whole texts; null counts as empty (no spans); positions are code points. A
    null doc_id stays null; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result. A candidate is added if the
    classifier gives it ``threshold`` or more.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(_pattern_counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance: dict[tuple, float] = {}
        empty = hashlib.sha256(b"").hexdigest()
        for batch in blocks(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in texts(batch):
                if not ANY.search(text):
                    for held, x in zip(out, (0, 0, 0, 0, empty, "", 0)):
                        held.append(x)
                    continue
                base, added = base_spans(text), []
                for span in candidates(text, base):
                    key = (span[0], votes(text, span), shape(text, span))
                    if key not in chance:
                        chance[key] = model.value.probability(*key)
                    if chance[key] >= threshold:
                        added.append(span)
                for held, x in zip(out, (*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added))):
                    held.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
