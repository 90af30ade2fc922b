"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's set holds the hashes of its distinct word shingles; its sketch is the k least.
   Documents with equal sets (by a 128-bit digest) form a class with one representative.
2. Inverted lists: of two sets with Jaccard similarity J, the k least values of the union are a
   random sample, each in both sets with probability J.  Linked sets share at least ``overlap`` of
   their sketches but for a chance below 1e-10.  Values are ordered by how many sketches hold them;
   two sketches with that overlap share one of their rarest k - overlap + 1 values, so only those
   generate candidates, and values that very many documents hold hardly ever do.
   Where lists are crowded, with copies of one text that are edited too much to be linked, their
   members get longer sketches, and those sketches' lists take the crowded ones' place.  The needed
   overlap is then close to a link's own (exact for sets that fit the sketch), and lists are split by
   set size, so a document that differs from all others in too many shingles drops out.
3. A list is never turned into all its pairs.  In each round a few pivots of a list meet the
   list's members outside their own component; a pivot that has met all is done.  A list whose
   members lie in one component is finished.  The rounds end when all lists are finished, so no
   link between two components is lost.  A pair of a crowd meets in its first common list alone.
4. Candidates pass a size bound, in crowds a bound on the difference (parities of the values by hash,
   which differ in no more bits than the sets in values), and the union sketch's estimate; exact Jaccard on full sets decides:
   on sketches that hold whole sets, else on whole texts.  A document is sent once to each cell of
   pairs that it has part in.

The chance of a miss is MISS for a link that a sketch samples, and none for sets within a sketch.

Defined results: null and empty texts, and texts without words, have an empty set and no links;
with fewer words than a shingle the whole sequence is the one shingle; a row without an id has no
component and is kept; repeated rows get the same result each; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WindowHash, as_bytes, cut, mix, passing, tidied, word_hashes
from .components import components

SHINGLE, K, MISS = 5, 48, 1e-10
LONG, STEP = 384, 1.04  # values in the sketches of crowded lists' members; ratio of size classes
PARITY = 8  # words of 64 bits that tell sets apart without a comparison
SIG = "struct<" + ", ".join(f"w{i}: long" for i in range(PARITY)) + ">"
BLOCK = 512  # sketches that one is compared with at a time
CELL = 4_000_000  # shingles, over all pairs, that are compared in one place
SMALL, PIVOTS = 32, 64  # lists up to SMALL close in the second round; larger ones take PIVOTS, then four times as many a round


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z are lower-cased."""
    words = word_hashes(text.lower()) if text else np.zeros(0, dtype=U64)
    if not len(words):
        return words
    return np.unique(WindowHash(words).windows(min(size, len(words))))


def least_overlap(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest overlap that linked sketches fall short of with a chance below ``miss``."""
    for t in range(k, 0, -1):
        p = (t - 1) / k
        if p < similarity:
            bound = (p * math.log(p / similarity) if p else 0.0) + (1 - p) * math.log((1 - p) / (1 - similarity))
            if math.exp(-k * bound) <= miss:
                return t
    return 1


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): set size, digest of the set and its k least values."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            n, d1, d2, low = [], [], [], []
            for t in as_bytes(batch.column(1)):
                s = shingle_set(t, size)
                n.append(len(s))
                d1.append(int(mix(s).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                d2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                low.append((s[:k] >> U64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(work), f"doc_id {kind}, n long, d1 long, d2 long, sketch array<long>")


def _needed(size, overlap: int, num: int):
    """The overlap that a sketch of this size needs; short sketches are the whole sets."""
    return F.least(F.lit(overlap), F.ceil(size * num / 100).cast("int"))


def _rarest(each: DataFrame, carried: list[str]) -> DataFrame:
    """(doc, *carried, vs): per document its values that others hold too, the rarest first.

    Values of one document alone would come first of all and meet nothing.
    """
    often = cut(each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "often")  # a join of two plain sides can be split
    shared = each.join(often, "v").groupBy("doc").agg(*(F.first(c).alias(c) for c in carried), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    return shared.withColumn("vs", F.transform("vs", lambda x: x["v"]))


def rare_lists(reps: DataFrame, overlap: int, num: int) -> DataFrame:
    """(v, doc, n, m): the inverted lists of each sketch's rarest values, those with two members or
    more; m is a list's length."""
    shared = _rarest(reps.select("doc", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v")), ["n", "s"])
    slots = F.size("vs") - _needed(F.col("s"), overlap, num) + 1
    rare = cut(shared.filter(slots > 0).select("doc", "n", F.explode(F.slice("vs", F.lit(1), slots)).alias("v")), "lists")
    return rare.join(cut(rare.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1"), "often"), "v").select("v", "doc", "n", "m")


def parity(values: np.ndarray) -> np.ndarray:
    """PARITY words of bits, each the parity of the values that fall on it.  Two sets' words differ in
    no more bits than the sets differ in values."""
    bits = np.bincount((values % U64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def long_sketches(texts: DataFrame, k: int, size: int) -> DataFrame:
    """(doc, n, vs, sig): sketches of k values (a set of no more values is there as a whole), and the
    parity words of whole sets."""
    kind = texts.schema["doc"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sets = [shingle_set(t, size) for t in as_bytes(part.column(1))]
                words = np.array([parity(s) for s in sets]).reshape(-1, PARITY).T
                sig = pa.StructArray.from_arrays([pa.array(w) for w in words], names=[f"w{i}" for i in range(PARITY)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([(s[:k] >> U64(1)).astype(np.int64) for s in sets], pa.list_(pa.int64())), sig], names=["doc", "n", "vs", "sig"])

    return texts.select("doc", "text").mapInArrow(tidied(work), f"doc {kind}, n long, vs array<long>, sig {SIG}")


def size_class(n):
    """Sizes in steps of 4 %."""
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def crowd_lists(sketched: DataFrame, overlap: int, num: int, k: int) -> DataFrame:
    """(v, c, doc, n, idx, before, sig): lists of long sketches' rarest values by size class.

    A pair meets in the class c of its smaller set.  There the smaller one (idx) needs an overlap
    with a set at least as large, the larger one an overlap with a set of that class; both are more
    than a link to just any size takes, so fewer of the rarest values stand for a set.  ``before``
    has the values that precede v, which tell whether a pair meets in an earlier list.
    """
    exact = lambda a, b: F.expr(f"({num} * ({a} + {b}) + {num + 99}) div {num + 100}")  # noqa: E731  the least o with 100 o >= num (a + b - o)
    shared = _rarest(sketched.select("doc", "n", F.explode("vs").alias("v")), ["n"])
    # A set whose partners all fit a sketch needs the exact overlap, others that of two samples.
    as_small = F.when(F.col("n") * 100 <= k * num, exact("n", "n")).otherwise(F.least(exact("n", "n"), F.lit(overlap)))
    least = F.expr(f"({num} * n + 99) div 100")
    shared = shared.withColumn("mine", F.size("vs") - as_small + 1)
    shared = shared.withColumn("own", size_class(F.col("n"))).withColumn("c", F.explode(F.sequence(size_class(least), size_class(F.col("n")))))
    shared = shared.withColumn("low", F.greatest(least, F.floor(F.pow(F.lit(STEP), F.col("c")))).cast("long"))
    as_large = F.when(F.col("n") > k, F.lit(overlap)).otherwise(exact("low", "n"))
    slots = F.greatest(F.size("vs") - as_large + 1, F.when(F.col("c") == F.col("own"), F.col("mine")).otherwise(F.lit(0))).cast("int")
    each = shared.withColumn("vs", F.slice("vs", F.lit(1), F.greatest(slots, F.lit(0)))).select("c", "doc", "n", "own", "mine", "vs", F.posexplode("vs").alias("at", "v"))
    idx = (F.col("c") == F.col("own")) & (F.col("at") < F.col("mine"))
    rare = cut(each.select("v", "c", "doc", "n", idx.alias("idx"), F.slice("vs", F.lit(1), F.col("at")).alias("before")), "lists")
    live = rare.groupBy("v", "c").agg(F.count("*").alias("m"), F.max("idx").alias("any")).filter("m > 1 and any")
    return rare.join(cut(live.select("v", "c"), "often"), ["v", "c"]).join(sketched.select("doc", "sig"), "doc").select("v", "c", "doc", "n", "idx", "before", "sig")


def compare(pairs: DataFrame, data: DataFrame, num: int, limits: dict[bool, tuple[int, int]] | None, size: int) -> DataFrame:
    """(p, x, family, pn, n, crowd, sure): the pairs that may be links (sure: that are).

    With limits, data has sketches: (doc, crowd, n, vs), and limits their length and least overlap
    by crowd; two whole sets decide, else the union's sketch estimates.  Without, data has (doc,
    text), and full sets decide.  Pairs of one family (the largest component of a list that they
    share) are dealt out by partner to cells of bounded weight; a cell gets each of its documents
    once, before the pairs.
    """
    by = ["family", "crowd"]
    many = pairs.groupBy(by).agg(F.ceil(F.sum(F.col("pn") + F.col("n")) / CELL).cast("int").alias("cells"))
    pairs = pairs.join(cut(many, "many"), by).withColumn("cell", F.pmod(F.xxhash64("x"), F.col("cells")).cast("int"))
    ends = pairs.select(*by, "cell", F.col("p").alias("doc")).unionByName(pairs.select(*by, "cell", F.col("x").alias("doc"))).distinct()
    kind = pairs.schema["p"].dataType
    item = "vs" if limits else "text"
    rows = ends.join(data, ["doc", "crowd"] if limits else ["doc"]).select(*by, "cell", F.col("doc").alias("p"), F.lit(None).cast(kind).alias("x"), F.lit(0).cast("long").alias("pn"), (F.col("n") if limits else F.lit(0).cast("long")).alias("n"), item)
    rows = rows.unionByName(pairs.select(*by, "cell", "p", "x", "pn", "n", F.lit(None).cast(data.schema[item].dataType).alias(item)))
    rows = rows.repartition(*by, "cell").sortWithinPartitions(*by, "cell", F.col("x").isNotNull(), "p", "x")

    def work(batches):
        import pyarrow as pa

        here, sets = None, {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            offsets = flat = texts = None
            if limits:
                offsets, flat = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy(zero_copy_only=False)
            else:
                texts = as_bytes(batch.column(7))
            taken, sure = [], []
            k, n = 0, len(batch)
            while k < n:
                family, crowd, cell, p, x, _, size_of = (c[k] for c in columns)
                if (family, crowd, cell) != here:
                    here, sets = (family, crowd, cell), {}
                if x is None:
                    sets[p] = (size_of, flat[offsets[k] : offsets[k + 1]].copy()) if limits else shingle_set(texts[k], size)
                    k += 1
                    continue
                end = k + 1
                while end < n and columns[3][end] == p and columns[4][end] is not None and (columns[0][end], columns[1][end], columns[2][end]) == here:
                    end += 1
                if limits:
                    found = [f for lo in range(k, end, BLOCK) for f in _estimate(sets[p], [sets[y] for y in columns[4][lo : min(end, lo + BLOCK)]], num, *limits[crowd])]
                else:
                    mine = sets[p]
                    found = [1 if 100 * both >= num * (len(mine) + len(s) - both) and both else 0 for s in (sets[y] for y in columns[4][k:end]) for both in (len(np.intersect1d(mine, s, assume_unique=True)),)]
                for at, f in enumerate(found, k):
                    if f:
                        taken.append(at)
                        sure.append(f == 1)
                k = end
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (3, 4, 0, 5, 6, 1)), pa.array(sure, pa.bool_())], names=["p", "x", "family", "pn", "n", "crowd", "sure"])

    name = kind.simpleString()
    return rows.mapInArrow(tidied(work), f"p {name}, x {name}, family {name}, pn long, n long, crowd boolean, sure boolean")


def _estimate(mine: tuple[int, np.ndarray], others: list[tuple[int, np.ndarray]], num: int, k: int, overlap: int) -> list[int]:
    """For each of the others 0 (no link), 1 (a link) or 2 (open)."""
    n, a = mine
    sizes = np.array([len(b) for _, b in others])
    full = np.array([m for m, _ in others])
    flat = np.concatenate([b for _, b in others])
    hit = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    out = np.where(100 * both >= num * (n + full - both), 1, 0)
    edge = np.cumsum(sizes)
    for j in np.flatnonzero((full > k) | (n > k)):
        if both[j] < overlap:
            out[j] = 0
            continue
        b = others[j][1]
        last = np.union1d(a, b)[:k][-1]
        shared = int(np.count_nonzero(b[hit[edge[j] - len(b) : edge[j]]] <= last))
        out[j] = 2 if shared >= overlap else 0
    return out.tolist()


def joined(docs: DataFrame, reps: DataFrame, num: int, size: int, k: int, long_k: int) -> DataFrame | None:
    """(node, label): components of the representatives under verified links; None without links."""
    overlap, long_overlap = least_overlap(num / 100, k), least_overlap(num / 100, long_k)
    lists = cut(rare_lists(reps, overlap, num), "lists")
    members = lists.groupBy("doc").agg(F.max(F.col("m") > SMALL).alias("crowd"))
    texts = cut(docs.join(members, docs["doc_id"] == members["doc"]).select("doc", "crowd", "text"), "texts")
    known = reps.join(texts.select("doc"), "doc", "left_semi").select("doc", F.lit(False).alias("crowd"), "n", F.col("sketch").alias("vs"))
    crowds = cut(long_sketches(texts.filter("crowd"), long_k, size), "sketches")
    known = cut(known.unionByName(crowds.select("doc", F.lit(True).alias("crowd"), "n", "vs")), "sketches")
    # A pair that meets in a crowded list has two long sketches, whose lists take that list's place.
    plain = lists.filter(F.col("m") <= SMALL).select("v", F.lit(-1).alias("c"), "doc", "n", F.lit(True).alias("idx"), F.lit(None).cast("array<long>").alias("before"), F.lit(None).cast(SIG).alias("sig"))
    lists = plain.unionByName(crowd_lists(crowds, long_overlap, num, long_k))
    state = cut(lists.withColumn("comp", F.col("doc")).withColumn("met", F.lit(False)), "state")
    # What a link's sets differ in, n + pn less twice the least overlap, bounds what their words differ in.
    near = "coalesce(%s <= n + pn - 2 * ((%d * (n + pn) + %d) div %d), true)" % (" + ".join(f"bit_count(sig.w{i} ^ psig.w{i})" for i in range(PARITY)), num, num + 99, num + 100)
    limits = {False: (k, overlap), True: (long_k, long_overlap)}
    found = label = None
    turn = 0
    while True:
        # Lists in one component are finished.  Else the members outside the list's largest
        # component must meet the rest; those that have not, in turn.
        groups = state.groupBy("v", "c", "comp").agg(F.count("*").alias("w"))
        open_lists = groups.groupBy("v", "c").agg(F.count("*").alias("comps"), F.sum("w").alias("m"), F.max_by("comp", F.struct("w", "comp")).alias("main")).filter("comps > 1")
        here = state.join(cut(open_lists.select("v", "c", "main", "m"), "open"), ["v", "c"])
        waits = here.filter("not met" if turn == 0 else "not met and comp <> main")
        spread = F.lit(0) if turn == 0 else F.when(F.col("m") <= SMALL, F.xxhash64("doc")).otherwise(F.pmod(F.xxhash64("doc"), F.lit(PIVOTS << 2 * (turn - 1))))
        first = F.min_by(F.struct("doc", "comp", "n", "idx", "before", "sig"), "doc")
        pivots = waits.groupBy("v", "c", spread.alias("spread")).agg(first.alias("p"))
        pivots = cut(pivots.select("v", "c", F.col("p.doc").alias("p"), F.col("p.comp").alias("pc"), F.col("p.n").alias("pn"), F.col("p.idx").alias("pidx"), F.col("p.before").alias("pbefore"), F.col("p.sig").alias("psig")), "pivots")
        if not pivots.limit(1).count():
            return label
        # Two pivots of a list meet once.
        here = cut(here.join(pivots.select("v", "c", F.col("p").alias("doc"), F.lit(True).alias("now")), ["v", "c", "doc"], "left").fillna(False, "now"), "open")
        fits = "not (now and doc > p) and comp <> pc and p <> doc and (idx or pidx) and 100 * least(n, pn) >= %d * greatest(n, pn) and %s and not coalesce(arrays_overlap(before, pbefore), false)" % (num, near)
        pairs = here.join(pivots, ["v", "c"]).filter(fits)
        pairs = pairs.select("p", "pn", F.col("doc").alias("x"), "n", (F.col("c") >= 0).alias("crowd"), "main")
        pairs = cut(pairs.groupBy("p", "x").agg(F.first("pn").alias("pn"), F.first("n").alias("n"), F.max("crowd").alias("crowd"), F.min("main").alias("family")), "pairs")
        likely = cut(compare(pairs, known, num, limits, size), "likely")
        new = cut(likely.filter("sure").unionByName(compare(likely.filter("not sure").drop("sure"), texts.select("doc", "text"), num, None, size)).select(F.col("p").alias("a"), F.col("x").alias("b")), "found")
        if new.limit(1).count():
            found = new if found is None else found.unionByName(new)
            label = components(found)
        state = here.withColumn("label", F.col("comp")) if label is None else here.join(label.withColumnRenamed("node", "doc"), "doc", "left")
        state = cut(state.select("v", "c", "doc", "n", "idx", "before", "sig", F.coalesce("label", "comp").alias("comp"), F.expr("met or now").alias("met")), "state")
        turn += 1


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 80, size: int = SHINGLE, k: int = K, long_k: int = LONG) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents with 100 * |A & B| >= num * |A | B| are linked; component_id is the smallest id that
    links lead to, and that document alone is kept.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sk = cut(sketches(docs, k=k, size=size), "sketches")
    full = sk.filter("n > 0 and doc_id is not null")
    classes = cut(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc")), "classes")
    reps = full.withColumnRenamed("doc_id", "doc").join(classes.select("doc"), "doc", "left_semi")
    with passing(docs.sparkSession):
        label = joined(docs, reps, num, size, k, long_k)
        label = None if label is None else cut(label, "labels", stays=True)
    ids = classes
    if label is not None:
        ids = classes.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("doc", F.coalesce("label", "doc"))
    rows = full.select("doc_id", "d1", "d2", "n").join(ids.select("d1", "d2", "n", F.col("doc").alias("component_id")), ["d1", "d2", "n"])
    rows = rows.select("doc_id", "n", "component_id").unionByName(sk.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
