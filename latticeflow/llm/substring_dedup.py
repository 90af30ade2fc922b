"""Substring dedup by level-wise doubling of repeated windows.

A window is ``width`` consecutive words of one document.  Level one looks at windows of half that
length, and only at those a window rule picks: each full window names the half-length window with
the least hash inside it.  Equal full windows name equal halves at equal places, so two documents
that share a full window share a picked half; about one half in ``width / 4`` is picked.

Halves that occur in one document alone are dropped.  The others are extended on both sides to all
words that a full window over them can reach: the context.  Occurrences with equal contexts have
equal full windows, so all but the first document's are repeats as a whole.  Where a half has
several contexts, the first document of each context lists its full windows over the half, and
those are compared one by one.  What a repeated window of an earlier document covers is removed.

The levels go on: windows repeated at one length alone are the picked halves of the next, twice as
long, until no candidates survive; only documents with a run of repeated windows that long are read.
The longest level that a document reaches is its ``longest``.

Hashes of halves and of contexts have 64 bits each and are used together; full windows use 128.

Defined results: null and empty texts have no words, nothing removed and the digest of an empty
text; repeats inside one document are kept, as are rows without an id; equal rows with one id are
one document and get the same result each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WindowHash, as_bytes, cut, passing, tidied, word_hashes

WIDTH = 50


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) over every w neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= w:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


def picked(halves: np.ndarray, per_window: int) -> np.ndarray:
    """Places whose hash is the least of some ``per_window`` neighbours."""
    least = _slide(halves, per_window, np.minimum)
    edge = np.zeros(per_window - 1, dtype=U64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), per_window, np.maximum) == halves)


def occurrences(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picked halves of one text: places, hashes, and hashes of their contexts."""
    half = width // 2
    if len(words) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
    wh = WindowHash(words)
    halves = wh.windows(half)
    at = picked(halves, width - half + 1)
    lo, hi = np.maximum(0, at - (width - half)), np.minimum(len(words), at + width)
    # The left part's length tells contexts apart that the text's ends cut differently.
    return at, halves[at], wh.ranges(lo, hi) ^ (at - lo).astype(U64) * U64(0xC2B2AE3D27D4EB4F)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def picked_halves(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, at, half, context) for the picked halves of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                n, cols = [], ([], [], [])
                for t in as_bytes(part.column(1)):
                    found = occurrences(word_hashes(t) if t else np.zeros(0, dtype=U64), width)
                    n.append(len(found[0]))
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                at, half, context = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in cols)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(_signed(half)), pa.array(_signed(context))], names=["doc_id", "at", "half", "context"])

    return docs.mapInArrow(tidied(work), f"doc_id {kind}, at int, half long, context long")


def list_windows(docs: DataFrame, open_halves: DataFrame, width: int) -> DataFrame:
    """(doc_id, at, w1, w2): the full windows over the halves that need it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    half = width // 2
    marks = open_halves.groupBy("doc_id").agg(F.collect_set("at").alias("ats"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n, starts, w1, w2 = [], [], [], []
                for t, ats in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = word_hashes(t)
                    reach = (np.array(sorted(ats))[:, None] - np.arange(width - half + 1)[None, :]).ravel()
                    s = np.unique(reach[(reach >= 0) & (reach <= len(words) - width)])
                    n.append(len(s))
                    starts.append(s)
                    w1.append(WindowHash(words).ranges(s, s + width))
                    w2.append(WindowHash(words, salt=1).ranges(s, s + width))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(starts).astype(np.int32)), pa.array(_signed(np.concatenate(w1))), pa.array(_signed(np.concatenate(w2)))], names=["doc_id", "at", "w1", "w2"])

    return docs.join(marks, "doc_id").select("doc_id", "text", "ats").mapInArrow(tidied(work), f"doc_id {kind}, at int, w1 long, w2 long")


def longest_run(spans):
    """The most words in a row that sorted spans cover."""
    state = F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("best"))

    def join(run, x):
        lo = F.when(x["lo"] <= run["hi"], run["lo"]).otherwise(x["lo"])
        hi = F.when(x["lo"] <= run["hi"], F.greatest(run["hi"], x["hi"])).otherwise(x["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.greatest(run["best"], hi - lo).alias("best"))

    return F.aggregate(spans, state, join)["best"]


def repeated(docs: DataFrame, width: int = WIDTH, runs: bool = False) -> DataFrame:
    """(doc_id, spans): the word ranges that windows of earlier documents cover, where there are any.

    With runs also documents whose windows come later only, with no spans, and a column run: the most
    words in a row that lie in windows of several documents.
    """
    half = width // 2
    seen = picked_halves(docs.filter("doc_id is not null and text is not null"), width)
    if width > WIDTH:
        seen = cut(seen, "seen")  # few enough to keep
    # Level one.  Per half: the documents it lies in, and whether its contexts differ.
    many = seen.groupBy("half").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("context").alias("c0"), F.max("context").alias("c1")).filter("first < last")
    many = cut(many.select("half", (F.col("c0") != F.col("c1")).alias("several")), "many")  # a join of two plain sides can be split
    again = cut(seen.join(many, "half"), "halves")
    # Level two.  A context's first document is open, all others repeat it.
    first = again.groupBy("half", "context").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    again = again.join(cut(first, "contexts"), ["half", "context"])
    whole = again.filter("first < last").select("doc_id", F.greatest(F.lit(0), F.col("at") - (width - half)).alias("lo"), (F.col("at") + width).alias("hi"), (F.col("doc_id") > F.col("first")).alias("later"))
    windows = cut(list_windows(docs, again.filter("doc_id = first and several").select("doc_id", "at"), width), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    single = windows.join(cut(least.select("w1", "w2", "first"), "least"), ["w1", "w2"])
    single = single.select("doc_id", F.col("at").alias("lo"), (F.col("at") + width).alias("hi"), (F.col("doc_id") > F.col("first")).alias("later"))
    parts = whole.unionByName(single)
    if not runs:
        return parts.filter("later").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    each = parts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("all"), F.array_sort(F.collect_set(F.when(F.col("later"), F.struct("lo", "hi")))).alias("spans"))
    return each.select("doc_id", "spans", longest_run(F.col("all")).alias("run"))


def _left(n: int, spans: list) -> np.ndarray:
    """Places of the words that no span covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, [min(s["lo"], n) for s in spans], 1)
    np.add.at(edge, [min(s["hi"], n) for s in spans], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def _kept(words: list[bytes], spans: list) -> bytes:
    return b" ".join([words[k] for k in _left(len(words), spans)])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, keep_text: bool = True, levels: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text][, longest]) for every document.

    With levels, longest is what ``repeat_lengths`` gives, 0 for documents without a repeat.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text + ["longest"] * levels
    with passing(docs.sparkSession):
        spans = cut(repeated(docs, width, levels), "spans", stays=True)
        more = _longer(docs, spans, 2 * width) if levels else None
        more = None if more is None else cut(more, "longest", stays=True)
    if levels:
        spans = spans.filter(F.size("spans") > 0).drop("run").withColumn("longest", F.lit(width))
        if more is not None:
            spans = spans.drop("longest").join(more, "doc_id", "left").withColumn("longest", F.coalesce("longest", F.lit(width)))
    else:
        spans = spans.withColumn("longest", F.lit(width))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                total, gone, digest, kept_texts = [], [], [], []
                for t, spans in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = t.split() if t else []
                    left = _left(len(words), spans) if spans else words
                    kept = _kept(words, spans) if spans else b" ".join(words)
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept)
                cols = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                if keep_text:
                    cols.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                if levels:
                    cols.append(part.column(3))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text + ", longest int" * levels
    found = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans", F.coalesce("longest", F.lit(0)).alias("longest"))
    return found.mapInArrow(tidied(work), schema)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", width: int = WIDTH) -> DataFrame:
    """The rows with repeated windows cut from their texts, and lengths to match.

    A text without repeats stays as it is; of another, the kept words are joined by single spaces.
    """
    names, schema = docs.columns, docs.schema
    with passing(docs.sparkSession):
        spans = cut(repeated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width), "spans", stays=True)
    at, size = names.index(text), names.index(n_chars) if n_chars in names else None

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                texts, sizes = as_bytes(part.column(at)), part.column(size).to_pylist() if size is not None else None
                for k, found in enumerate(part.column(len(names)).to_pylist()):
                    if found:
                        texts[k] = _kept(texts[k].split(), found)
                        if sizes is not None:
                            sizes[k] = len(texts[k].decode())
                cols = part.columns[: len(names)]
                cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
                if sizes is not None:
                    cols[size] = pa.array(sizes, cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    mark = max([*names, ""], key=len) + "_"  # a name that no column has
    spans = spans.select(F.col("doc_id").alias(mark), F.col("spans").alias(mark + "_"))
    return docs.join(spans, docs[doc_id] == spans[mark], "left").select(*(docs[c] for c in names), spans[mark + "_"]).mapInArrow(tidied(work), schema)


def _longer(docs: DataFrame, level: DataFrame, width: int) -> DataFrame | None:
    """(doc_id, longest) for repeats of width words or more, from the level of half that width.

    A window of that width lies in windows of half of it, so only documents with a run so long count.
    """
    found = None
    while (taking := cut(level.filter(F.col("run") >= width).select("doc_id"), "taking")).limit(1).count():
        level = cut(repeated(docs.join(taking, "doc_id", "left_semi"), width, True), "spans")
        more = level.filter(F.size("spans") > 0).select("doc_id", F.lit(width).alias("longest"))
        found = cut(more if found is None else found.unionByName(more).groupBy("doc_id").agg(F.max("longest").alias("longest")), "longest")
        width *= 2
    return found


def repeat_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", start: int = WIDTH) -> DataFrame:
    """(doc_id, longest): the greatest length start * 2**k of which a document repeats a window of an
    earlier one.  Each level looks only at documents that take part in a repeat of the level before.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    with passing(docs.sparkSession):
        found = _longer(docs, docs.select("doc_id", F.lit(start).alias("run")).distinct(), start)
        found = None if found is None else cut(found, "longest", stays=True)
    return found if found is not None else docs.select("doc_id", F.lit(start).alias("longest")).limit(0)
