"""Katz backoff language model over words, counted and evaluated in packed chunks.

Tokens are the words of a text, A-Z lower-cased, and one end.  An n-gram seen r times in training has
probability d(r) r / c(its context); d(r) is Good-Turing's discount up to CAP counts, and half a
count beyond, where Katz takes none off, so that every context leaves something to unseen words.  They
share what their context leaves in proportion to the probabilities of the next lower order, by a weight
that makes each context sum to one exactly, and so on down to single words; words never seen are one
unknown word.  Where counts of counts give no discount between 0 and 1, it is (r - 0.5) / r.  A text's
first words have the shorter contexts that follow its start.

How it runs.  The corpus is read once: each task folds its documents into chunks of a bounded number
of tokens, which are stored.  A chunk sends its distinct n-grams of each order, sorted by hash and
packed, to the hash ranges they belong to; the stored count tables are those ranges' answers, for each
chunk in the order it asked.  So an n-gram costs one entry for each chunk and never one for each
occurrence, however frequent it is.  A chunk then evaluates its tokens from the lowest order up.  What
the backoff weights need is summed in the same way (each n-gram of the corpus is counted by the first
chunk that holds it) for those contexts alone that occur in a document outside training; elsewhere
every n-gram is seen and no weight is used.  All tables in between are written to the shared folder.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits.

Defined results: a null or empty text is the end alone; without training documents every word is
unknown and scores are logarithms of 1; a null id is a training document; equal rows each count
and each get a result; ids can have any type; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, cut, discard, hand_back, mix, tidy_session, word_hashes

CAP = 5
ORDER = 3
CHUNK_TOKENS = 1_600_000
RANGE_TOKENS = 1_600_000  # of the corpus for each hash range
KEPT_BITS = U64((1 << 64) - 256)
START, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def tokens(text: bytes | None) -> np.ndarray:
    words = word_hashes(text.lower()) if text else np.zeros(0, dtype=U64)
    return np.append(words, END)


def pack(x: np.ndarray) -> bytes:
    """An array by bytes of equal weight, compressed: the high ones are mostly zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def range_edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash ranges begin in sorted keys."""
    limits = np.array([min((i << 64) // parts, (1 << 64) - 1) for i in range(1, parts)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]]).astype(np.int64)


class Level:
    """A chunk's distinct n-grams of one order, sorted by hash."""

    def __init__(self, key: np.ndarray, at: np.ndarray, context: np.ndarray | None = None, lower: np.ndarray | None = None) -> None:
        self.key, self.at = key, at  # at: the n-gram that ends at each token, -1 where the text is too short
        self.context, self.lower = context, lower  # of each n-gram its context and itself without its first word


class Chunk:
    """Documents' tokens, with the chunk's own n-grams of each order."""

    def __init__(self, ids, train: np.ndarray, size: np.ndarray, vocab: np.ndarray, word: np.ndarray) -> None:
        self.ids, self.train, self.size, self.vocab, self.word = ids, train, size, vocab, word

    @classmethod
    def of(cls, ids, train: list, stream: list[np.ndarray]) -> Chunk:
        vocab, word = np.unique(np.concatenate(stream), return_inverse=True)
        return cls(ids, np.array(train, dtype=bool), np.array([len(x) for x in stream], dtype=np.int64), vocab, word.astype(np.int32).ravel())

    def packed(self) -> bytes:
        import pickle

        often = np.argsort(-np.bincount(self.word, minlength=len(self.vocab)), kind="stable")
        rank = np.empty(len(often), dtype=np.uint32)
        rank[often] = np.arange(len(often))
        return pickle.dumps((self.ids, np.packbits(self.train).tobytes(), pack(self.size), pack_sorted(self.vocab), pack(np.diff(often, prepend=0).astype(np.int32).view(np.uint32)), pack(rank[self.word])))

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        import pickle

        ids, train, size, vocab, often, word = pickle.loads(data)  # written by packed()
        size = unpack(size, np.int64)
        return cls(ids, np.unpackbits(np.frombuffer(train, dtype=np.uint8), count=len(size)).astype(bool), size, unpack_sorted(vocab), np.cumsum(unpack(often, np.int32), dtype=np.int32)[unpack(word, np.uint32)])

    def levels(self, order: int) -> list[Level]:
        n = len(self.vocab)
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        first = np.cumsum(self.size) - self.size
        place = np.arange(len(self.word)) - first[self.doc]
        out = [Level(self.vocab, self.word)]
        hashes = np.append(self.vocab, START)
        for k in range(2, order + 1):
            before = out[-1]
            here = np.flatnonzero(place >= k - 2)
            context = np.where(place[here] > 0, before.at[here - 1], n) if k == 2 else before.at[here - 1]
            gram, where, at = np.unique(context.astype(np.int64) * (n + 1) + self.word[here], return_index=True, return_inverse=True)
            context = gram // (n + 1)
            key = mix((hashes if k == 2 else before.key)[context] * _A ^ mix(self.vocab[gram % (n + 1)] + _B)) & KEPT_BITS
            order_of = np.argsort(key, kind="stable")
            rank = np.empty(len(order_of), dtype=np.int32)
            rank[order_of] = np.arange(len(order_of))
            whole = np.full(len(self.word), -1, dtype=np.int32)
            whole[here] = rank[at.ravel()]
            lower = before.at[here[where]]
            out.append(Level(key[order_of], whole, context[order_of].astype(np.int32), lower[order_of]))
        return out


def chunks_of(batches, chunk_tokens: int):
    """Chunks of the documents (doc_id, text, train) of one task, in their order."""
    import pyarrow as pa

    ids, train, stream, size = [], [], [], 0
    for batch in batches:
        lo = 0
        learns = batch.column(2).to_pylist()
        for k, t in enumerate(as_bytes(batch.column(1)), 1):
            x = tokens(t)
            train.append(learns[k - 1])
            stream.append(x)
            size += len(x)
            if size >= chunk_tokens:
                c = Chunk.of(pa.concat_arrays([*ids, batch.column(0).slice(lo, k - lo)]), train, stream)
                ids, train, stream, size, lo = [], [], [], 0, k
                yield c
                c = None
        if lo < len(batch):
            ids.append(batch.column(0).slice(lo))
    if stream:
        yield Chunk.of(pa.concat_arrays(ids), train, stream)


def record_batch(rows: list[tuple], schema: str):
    """Rows as an Arrow batch; schema names columns of the kinds used here."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def bits(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(x).tobytes())


def unbits(data: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), count=n).astype(bool)


STREAM = "chunk long, tokens long, data binary"
ASKED = "kind int, part int, chunk long, keys binary, counts binary, held binary"
ANSWER = "chunk long, kind int, part int, n long, counts binary, owner binary, held binary, types long, total long, r array<long>"


def streams(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """(chunk, tokens, data): the corpus in packed chunks."""

    def work(batches):
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() << 24
        for k, c in enumerate(chunks_of(batches, chunk_tokens)):
            yield record_batch([(here + k, len(c.word), c.packed())], STREAM)
            c = None
            hand_back()

    return docs.mapInArrow(work, STREAM)


def ask(chunks: DataFrame, parts: int, order: int) -> DataFrame:
    """Each chunk's n-grams by order (kind) and hash range: training counts, and whether they occur
    outside training."""

    def work(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c = Chunk.unpacked(data)
                levels = c.levels(order)
                learns = c.train[c.doc]
                for kind, level in enumerate(levels, 1):
                    there = level.at >= 0
                    counts = np.bincount(level.at[learns & there], minlength=len(level.key)).astype(np.uint32)
                    held = np.bincount(level.at[~learns & there], minlength=len(level.key)) > 0
                    edge = range_edges(level.key, parts)
                    yield record_batch([(kind, p, chunk, pack_sorted(level.key[a:b]), pack(counts[a:b]), bits(held[a:b])) for p, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a], ASKED)
                c = levels = level = learns = there = counts = held = None  # before the next chunk comes
                hand_back()

    return chunks.mapInArrow(work, ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """The count tables: training counts for each chunk in its own order, who counts an n-gram, and
    whether it occurs outside training; and one row of counts of counts for each range."""

    def work(table):
        import pyarrow as pa

        hand_back()
        table = table.sort_by("chunk")
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        chunks = table["chunk"].to_pylist()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        size = [len(k) for k in keys]
        counts = np.concatenate([unpack(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        held = np.concatenate([unbits(x, n) for x, n in zip(table["held"].to_pylist(), size, strict=True)])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        group = np.empty(len(s), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(s))))
        total = np.add.reduceat(counts[order], begin)
        anywhere = np.logical_or.reduceat(held[order], begin)
        first = np.minimum.reduceat(np.where(counts[order] > 0, np.arange(len(s)), len(s)), begin)
        owner = np.zeros(len(s), dtype=bool)
        owner[order[first[first < len(s)]]] = True
        edge = np.cumsum([0, *size])
        rows = [(k, kind, part, b - a, pack(total[group[a:b]]), bits(owner[a:b]), bits(anywhere[group[a:b]]), None, None, None) for k, a, b in zip(chunks, edge, edge[1:], strict=False)]
        r = np.bincount(total[total <= CAP + 1], minlength=CAP + 2)
        rows.append((None, kind, part, 0, None, None, None, int((total > 0).sum()), int(total.sum()), r.tolist()))
        return pa.Table.from_batches([record_batch(rows, ANSWER)])

    return asked.groupBy("kind", "part").applyInArrow(work, ANSWER)


def discounts(r: list[int]) -> np.ndarray:
    """d(0..CAP) from counts of counts r[1..CAP + 1]; d(0) is unused."""
    out = np.ones(CAP + 1)
    common = (CAP + 1) * r[CAP + 1] / r[1] if r[1] else 1.0
    for n in range(1, CAP + 1):
        d = ((n + 1) * r[n + 1] / (n * r[n]) - common) / (1 - common) if r[n] and common != 1 else 0.0
        out[n] = d if 0 < d < 1 else (n - 0.5) / n
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What counts are worth."""
    return np.where(c > CAP, c - 0.5, d[np.minimum(c, CAP)] * c)


class Unigrams:
    """Discounted probabilities by count; what is left is the unknown word's."""

    def __init__(self, r: list[int], total: int, types: int) -> None:
        self.d, self.total = discounts(r), max(total, 1)
        lost = sum((1 - self.d[n]) * n * r[n] for n in range(1, CAP + 1)) + 0.5 * (types - sum(r[1 : CAP + 1]))
        self.unknown = lost / self.total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)


PIECE = "chunk long, kind int, part int, n long, counts binary, owner binary, held binary"
SUMS = "chunk long, kind int, part int, data binary"


def _answers(table, kind: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A kind's counts, owner and held bits over all ranges."""
    rows = sorted(((p, n, c, o, h) for k, p, n, c, o, h in zip(*(table[x].to_pylist() for x in ("kind", "part", "n", "counts", "owner", "held")), strict=True) if k == kind), key=lambda r: r[0])
    if sum(r[1] for r in rows) != size:
        raise RuntimeError("counts are missing")
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    return np.concatenate([unpack(r[2], np.int64) for r in rows]), np.concatenate([unbits(r[3], r[1]) for r in rows]), np.concatenate([unbits(r[4], r[1]) for r in rows])


def first_scores(pieces: DataFrame, stat: dict[int, dict], parts: int, order: int) -> DataFrame:
    """For each chunk its documents' scores but for backoff weights (kind 0), and by context range the
    sums that the weights need (kind: the order of their n-grams)."""
    uni, total, types = Unigrams(stat[1]["r"], stat[1]["total"], stat[1]["types"]), stat[1]["total"], stat[1]["types"]
    ds = {n: discounts(stat[n]["r"]) for n in range(2, order + 1)}

    def work(table):
        import pickle

        import pyarrow as pa

        hand_back()
        chunk = table["chunk"][0].as_py()
        c = Chunk.unpacked(next(x for k, x in zip(table["kind"].to_pylist(), table["counts"].to_pylist(), strict=True) if k == 0))
        levels = c.levels(order)
        docs = len(c.size)
        add = lambda x: np.bincount(c.doc, weights=x, minlength=docs)
        count, _, held = _answers(table, 1, len(c.vocab))
        p = uni.p(count)  # of each n-gram of the level below
        known, base = add((count > 0)[c.word]).astype(np.int64), add(np.log10((count + 0.1) / (total + 0.1 * (types + 1)))[c.word])
        score = np.log10(p)[c.word]
        # As many texts start as end, and some start is outside training.
        count, held = np.append(count, count[np.searchsorted(c.vocab, END)]), np.append(held, True)
        keys = np.append(c.vocab, START)
        rows, waits = [], []
        for n, level in enumerate(levels[1:], 2):
            mine, owner, anywhere = _answers(table, n, len(level.key))
            seen, context = mine > 0, count[level.context]
            value = np.where(seen, discounted(mine, ds[n]) / np.maximum(context, 1), 0.0)
            there = level.at >= 0
            gram = np.where(there, level.at, 0)
            if len(level.key):
                hit = there & seen[gram]
                score = np.where(hit, np.log10(np.where(seen, value, 1.0))[gram], score)
                at = np.flatnonzero(there & ~hit & (context[gram] > 0))
            else:
                at = np.zeros(0, dtype=np.int64)
            code, many = np.unique(c.doc[at].astype(np.int64) * len(keys) + level.context[gram[at]], return_counts=True)
            needed = np.zeros(len(keys), dtype=bool)
            needed[code % len(keys)] = True
            use = owner & seen & held[level.context]
            s = np.bincount(level.context[use], weights=p[level.lower[use]], minlength=len(keys))
            lost = np.bincount(level.context[use], weights=mine[use] - discounted(mine[use], ds[n]), minlength=len(keys))
            send = np.flatnonzero(needed | (lost > 0))
            send = send[np.argsort(keys[send], kind="stable")]
            edge = range_edges(keys[send], parts)
            rows += [(chunk, n, q, pickle.dumps((pack_sorted(keys[u]), pack(s[u]), pack(lost[u]), bits(needed[u])))) for q, u in ((q, send[a:b]) for q, (a, b) in enumerate(zip(edge, edge[1:], strict=False))) if len(u)]
            asked = np.flatnonzero(needed)
            asked = asked[np.argsort(keys[asked], kind="stable")]
            place = np.zeros(len(keys), dtype=np.int64)
            place[asked] = np.arange(len(asked))
            waits.append((n, pack((code // len(keys)).astype(np.uint32)), pack(place[code % len(keys)].astype(np.uint32)), pack(many.astype(np.uint32)), pack(count[asked])))
            p, count, held, keys = value, mine, anywhere, level.key
        rows.append((chunk, 0, 0, pickle.dumps((c.ids, np.packbits(c.train).tobytes(), pack(c.size), pack(known), pack(base), pack(add(score)), waits))))
        return pa.Table.from_batches([record_batch(rows, SUMS)])

    return pieces.groupBy("chunk").applyInArrow(work, SUMS)


def weight_sums(sums: DataFrame) -> DataFrame:
    """Adds up the sums of each context and answers the chunks that need them (kind: below 0)."""

    def work(table):
        import pickle

        import pyarrow as pa

        hand_back()
        table = table.sort_by("chunk")
        rows = [pickle.loads(x) for x in table["data"].to_pylist()]  # written by first_scores()
        keys = [unpack_sorted(r[0]) for r in rows]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times, out = np.diff(np.append(begin, len(s))), []
        for k in (1, 2):
            x = np.concatenate([unpack(r[k], np.float64) for r in rows])
            y = np.empty(len(s))
            y[order] = np.repeat(np.add.reduceat(x[order], begin), times)
            out.append(y)
        edge = np.cumsum([0, *map(len, keys)])
        answers = []
        for chunk, kind, part, r, a, b in zip(*(table[x].to_pylist() for x in ("chunk", "kind", "part")), rows, edge, edge[1:], strict=False):
            needed = unbits(r[3], b - a)
            if needed.any():
                answers.append((chunk, -kind, part, pickle.dumps((pack(out[0][a:b][needed]), pack(out[1][a:b][needed])))))
        return pa.Table.from_batches([record_batch(answers, SUMS)])

    return sums.filter("kind > 0").groupBy("kind", "part").applyInArrow(work, SUMS)


def finish(sums: DataFrame, weights: DataFrame, kind: str) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score) for every document."""
    schema = f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"

    def work(table):
        import pickle

        import pyarrow as pa

        hand_back()
        data, parts = None, {}
        for k, q, x in zip(*(table[x].to_pylist() for x in ("kind", "part", "data")), strict=True):
            if k == 0:
                data = x
            else:
                parts.setdefault(-k, []).append((q, x))
        ids, train, size, known, base, score, waits = pickle.loads(data)  # written by first_scores()
        size, known, base, score = unpack(size, np.int64), unpack(known, np.int64), unpack(base, np.float64), unpack(score, np.float64)
        for n, doc, at, many, context in waits:
            doc, at, many, context = (unpack(x, t) for x, t in zip((doc, at, many, context), (np.uint32, np.uint32, np.uint32, np.int64), strict=True))
            both = [pickle.loads(x) for _, x in sorted(parts.get(n, []))]
            s, lost = (np.concatenate([unpack(x[k], np.float64) for x in both]) if both else np.zeros(0) for k in (0, 1))
            if len(s) != len(context):
                raise RuntimeError("weights are missing")
            alpha = np.log10(lost / np.maximum(context, 1)) - np.log10(np.maximum(1.0 - s, 1e-300))
            score = score + np.bincount(doc, weights=alpha[at] * many, minlength=len(score))
        train = np.unpackbits(np.frombuffer(train, dtype=np.uint8), count=len(size)).astype(bool)
        return pa.table([ids, *map(pa.array, (train, size, known, base, score))], names=[x.split()[0] for x in schema.split(", ")])

    return sums.filter("kind = 0").unionByName(weights).groupBy("chunk").applyInArrow(work, schema)


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every document.

    train is a condition that says which documents to learn from; order is the model's, from 2.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    # What has been asked is large and not needed once it is answered.
    chunks = cut(streams(docs, chunk_tokens), "chunks", tidy_session(spark))
    size = chunks.agg(F.sum("tokens").alias("n")).first().n or 0
    parts = max(8, -(-size // range_tokens))
    answers = cut(answer(ask(chunks, parts, order)), "counts")
    found = {r.kind: r for r in answers.filter("chunk is null").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total"), *(F.sum(F.col("r")[i]).alias(f"r{i}") for i in range(CAP + 2))).collect()}
    stat = {n: {"types": found[n].types, "total": found[n].total, "r": [0] + [found[n][f"r{i}"] for i in range(1, CAP + 2)]} if n in found else {"types": 0, "total": 0, "r": [0] * (CAP + 2)} for n in range(1, order + 1)}
    none = F.lit(None).cast("binary")
    pieces = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.col("data").alias("counts"), none.alias("owner"), none.alias("held"))
    pieces = pieces.unionByName(answers.filter("chunk is not null").select(*(x.split()[0] for x in PIECE.split(", "))))
    sums = cut(first_scores(pieces, stat, parts, order), "scores", spark)
    discard(chunks, answers)
    out = finish(sums, weight_sums(sums), kind)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(stat[1]["total"]).cast("long").alias("train_tokens"), "base_score", "score")
