"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with k = m * budget edits anywhere in a document.  Cut into
k + 1 pieces, at least one piece is then found unchanged.  An Aho-Corasick automaton of all pieces
reads each whole document once; around each hit, Myers' bit-parallel distance measures the least
edits between the item and any substring.

Texts are compared lower-cased with runs of white space as one blank.  Items are a query set that is
read in blocks of bounded size; each block is broadcast and meets all documents.

Defined results: null and empty texts match nothing; items that are null, or empty when normalised,
are not looked for; an item too short for one edit is found as it is, wherever it occurs; equal items each give their rows, as do repeated
documents; extra columns are ignored; without documents or items there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

BUDGET = 0.05  # edits for each character of an item
BLOCK_CHARS = 2_000_000  # of items in one automaton


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in edits + 1 pieces of nearly equal length, with their places."""
    n = edits + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def nearest(item: str, text: str, limit: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(edits, end) of the substring of text nearest to item, the first of equal ones; None beyond
    limit.  Myers' recurrence, with a column of differences in one integer's bits."""
    m = len(item)
    if masks is None:
        masks = char_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits, best = full, 0, m, None
    if m <= limit:
        best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(diag | up) & full), up & diag
        if plus & top:
            edits += 1
        elif minus & top:
            edits -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(diag | plus) & full), plus & diag
        if edits <= limit and (best is None or edits < best[0]):
            best = (edits, j + 1)
    return best


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET) -> None:
        import ahocorasick

        self.items = [(i, t, int(len(t) * budget), char_masks(t)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for a, p in pieces(t, k):
                found.setdefault(p, []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in found.items():
            self.automaton.add_word(p, (len(p), where))
        if found:
            self.automaton.make_automaton()
        self.ready = bool(found)

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, least edits, end of the match) for each item found in the text."""
        if not text or not self.ready:
            return []
        text = normal(text)
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, a in where:
                starts.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, places in starts.items():
            i, t, k, masks = self.items[n]
            best, reach = None, -1
            places.sort()
            x = 0
            while x < len(places) and (best is None or best[0]):
                lo = places[x]
                while x < len(places) and places[x] - lo <= 2 * k + len(t):  # hits that windows share
                    reach = places[x]
                    x += 1
                lo, hi = max(0, lo - k), min(len(text), reach + len(t) + 2 * k)
                if (got := nearest(t, text[lo:hi], k, masks)) and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
            if best is not None:
                out.append((i, *best))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most block_chars characters (or of one item that is longer)."""
    block, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        t = normal(r.t)
        if not t:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += len(t)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, match_end): the items found in each document, with the least edits and
    the first place, in normalised characters, where such a match ends."""
    kind, ikind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, item_id, text, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def work(batches, sent=sent):
            import pyarrow as pa

            match = Matcher(sent.value, budget)
            for batch in batches:
                rows, at = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    for found in match.find(t):
                        rows.append(found)
                        at.append(k)
                cols = zip(*rows, strict=True) if rows else ((), (), ())
                kinds = (pa.int64() if ikind == "bigint" else None, pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "item_id", "edits", "match_end"])

        part = texts.mapInArrow(tidied(work), f"doc_id {kind}, item_id {ikind}, edits int, match_end long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, item_id {ikind}, edits int, match_end long")


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, as they are, in which no item is found."""
    at = docs.columns.index(text)
    for block in item_blocks(items, item_id, text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches, sent=sent):
            import pyarrow as pa

            match = Matcher(sent.value, budget)
            for batch in batches:
                yield batch.filter(pa.array([not match.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidied(work), docs.schema)
    return docs
