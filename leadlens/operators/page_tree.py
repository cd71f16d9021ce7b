"""Pages as columnar trees: one row a page, its elements and strings as arrays that column expressions walk.

Parsing is the only Python step. Elements stand in document order, so a subtree
is a range of elements and of strings, and everything that extraction asks (a
card's strings, the next sibling, the headings before an address) is a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template".split())
BOXES = ("li", "article", "div", "figure", "section")
BLOCKS = ("section", "div", "article")
PEERS = ("div", "li", "article")
#: Tags and words in class names of what frames a page.
FRAME_TAGS = ("nav", "footer", "header", "aside")
FRAME_WORDS = ("footer", "nav", "menu", "sidebar")
FRAME_CLASSES = ("header", "site-header", "quick-links", "useful-links")

#: Of an element: range of its strings, last element within, parent, next sibling (-1: none), nearest ancestors of BOXES and BLOCKS,
#: element children, PEERS among them and their strings, range of strings of the sibling before it (text or element), headings before it, whether it lies in a frame.
NUMBERS = ("at", "low", "high", "last", "parent", "next", "box", "block", "kids", "peers", "peer_strings", "before_low", "before_high", "heads")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Characters of pages, and pages, that are parsed before their trees are handed on: an element takes over a kilobyte as an object.
BUNCH, BUNCH_PAGES = 1_000_000, 200
WORDS = ("tag", "id", "class", "href", "alt")
ELEMENT = "struct<" + ",".join([f"{n}:int" for n in NUMBERS] + ["framed:boolean"] + [f"{n}:string" for n in WORDS]) + ">"
TREE = f"page_id long, strings array<string>, owners array<int>, elements array<{ELEMENT}>, attributes array<struct<owner:int,link:boolean,value:string>>, data array<string>"


class _Tree(HTMLParser):
    """The elements and strings of one page; end tags without a start are ignored, missing ones end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.owners: list[int] = []
        self.elements: list[dict] = []
        self.attributes: list[tuple[int, bool, str]] = []
        self.data: list[str] = []
        self.held: list[str] | None = None  # the text of a script of linked data
        self.open: list[int] = []
        self.ends: dict[int, tuple[int, int, int]] = {}  # of a parent: last child element and the strings of the last child
        self.framing: list[bool] = []
        self.heads = 0

    def _inner(self, names: tuple[str, ...]) -> int:
        return next((k for k in reversed(self.open) if self.elements[k]["tag"] in names), -1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = {k: v or "" for k, v in reversed(attrs)}
        at, parent = len(self.elements), self.open[-1] if self.open else -1
        child, low, high = self.ends.get(parent, (-1, -1, -1))
        if child >= 0:
            self.elements[child]["next"] = at
        classes = held.get("class", "").lower()
        element = {n: -1 for n in NUMBERS} | {"at": at, "low": len(self.strings), "parent": parent, "box": self._inner(BOXES), "block": self._inner(BLOCKS), "kids": 0, "peers": 0, "peer_strings": 0, "before_low": low, "before_high": high, "heads": self.heads}
        self.heads += tag in HEADINGS
        element |= {"tag": tag, "id": held.get("id", "").strip().lower(), "class": classes, "href": held.get("href", ""), "alt": held.get("alt", ""), "framed": bool(self.framing) and self.framing[-1]}
        self.elements.append(element)
        self.attributes += [(at, name == "href" and tag == "a", value) for name, value in held.items() if "@" in value or "%40" in value or " at " in value.lower() or "[at]" in value.lower() or "(at)" in value.lower()]
        if tag == "script" and held.get("type", "").strip().lower() == "application/ld+json":
            self.held = []
        if parent >= 0:
            self.elements[parent]["kids"] += 1
        frame = tag in FRAME_TAGS or any(w in c for c in classes.split() for w in FRAME_WORDS) or any(c in FRAME_CLASSES for c in classes.split())
        self.open.append(at)
        self.framing.append(element["framed"] or frame)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> None:
        at = self.open.pop()
        self.framing.pop()
        element = self.elements[at]
        element["high"], element["last"] = len(self.strings), len(self.elements) - 1
        parent = element["parent"]
        self.ends[parent] = (at, element["low"], element["high"])
        if parent >= 0 and element["tag"] in PEERS:
            self.elements[parent]["peers"] += 1
            self.elements[parent]["peer_strings"] += element["high"] - element["low"]

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.held is not None:
            self.data.append("".join(self.held).strip())
            self.held = None
        if any(self.elements[k]["tag"] == tag for k in self.open):
            while self.elements[self.open[-1]]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.held is not None:
            self.held.append(data)
        text = data.strip()
        parent = self.open[-1] if self.open else -1
        if not text or (parent >= 0 and self.elements[parent]["tag"] in UNSEEN):
            return
        self.strings.append(text)
        self.owners.append(parent)
        child = self.ends.get(parent, (-1, -1, -1))[0]
        self.ends[parent] = (child, len(self.strings) - 1, len(self.strings))

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)


def _bunches(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``BUNCH_PAGES`` pages and, unless a page alone is longer, ``BUNCH`` characters."""
    sizes = [n or 0 for n in pc.utf8_length(whole.column(1)).to_pylist()]
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (held + n > BUNCH or k - start == BUNCH_PAGES):
            yield whole.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield whole.slice(start)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _bunches(whole):
            trees = []
            for html in batch.column(1).to_pylist():
                tree = _Tree()
                tree.feed(html or "")
                tree.close()
                trees.append(tree)
            elements = [e for t in trees for e in t.elements]
            names = [*NUMBERS, "framed", *WORDS]
            kinds = [pa.int32()] * len(NUMBERS) + [pa.bool_()] + [pa.string()] * len(WORDS)
            rows = pa.StructArray.from_arrays([pa.array([e[n] for e in elements], k) for n, k in zip(names, kinds)], names)
            attributes = [a for t in trees for a in t.attributes]
            held = pa.StructArray.from_arrays([pa.array([a[k] for a in attributes], kind) for k, kind in enumerate((pa.int32(), pa.bool_(), pa.string()))], ["owner", "link", "value"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _lists([s for t in trees for s in t.strings], [len(t.strings) for t in trees], pa.string()),
                    _lists([o for t in trees for o in t.owners], [len(t.owners) for t in trees], pa.int32()),
                    _lists(rows, [len(t.elements) for t in trees], rows.type),
                    _lists(held, [len(t.attributes) for t in trees], held.type),
                    _lists([x for t in trees for x in t.data], [len(t.data) for t in trees], pa.string()),
                ],
                ["page_id", "strings", "owners", "elements", "attributes", "data"],
            )


def trees(pages: DataFrame) -> DataFrame:
    """``TREE`` of each page (page_id, html); a null page has no elements."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_parse, TREE)


def part(array: Column, low: Column, high: Column, most: int = 40) -> Column:
    """``array`` from ``low`` up to ``high``, at most ``most`` of it; empty if nothing is there."""
    return F.slice(array, F.greatest(low, F.lit(0)) + 1, F.greatest(F.least(high - low, F.lit(most)), F.lit(0)))


def element(elements: Column, at: Column) -> Column:
    """The element at a place; null at -1."""
    return F.when(at >= 0, F.element_at(elements, F.greatest(at, F.lit(0)) + 1))
