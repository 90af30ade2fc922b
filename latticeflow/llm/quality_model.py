"""Quality classification by co-training on two views of a document.

One view is the text's content: hashed words, hashed word shapes (runs of letter case, digits and
signs) and a few rates.  The other is the page's metadata: source, language and stated length.  Each
view has a logistic classifier.  In each round both look at all unlabelled documents; of those that
it has not taught before, each hands its surest ones (PICKS, in proportion to the classes) to the
other, which learns from them at half weight.  At the end a logistic combination of both views'
log-odds is calibrated on labelled rows that neither classifier has seen, and it scores all documents.

Learning starts from about FIT_ROWS labelled documents, whose hashes are low enough.  A round is one
pass over the unlabelled documents in which every task keeps its own surest ones; the surest of all
come from a table of these, so the driver gets no more than PICKS rows a round and view.  Scoring is
one pass without a shuffle.

Defined results: null texts have the features of empty ones; null metadata is a value of its own;
null labels teach nothing; without labels of both classes every score is the known share (1 without
any label); rows of one id teach once, those without an id never; repeated rows get the same result
each; of equally sure documents those with the least hash of their id teach; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, cut, discard, mix, word_hashes

FIT_ROWS = 5_000  # labelled documents to learn from
ROUNDS, PICKS, SURE = 3, 200, 0.9  # documents that each view labels in a round, when it is as sure as that
WORDS, SHAPES, RATES, META = 1 << 12, 1 << 9, 8, 1 << 8
TEXT_SIZE = WORDS + SHAPES + RATES

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def text_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the content view."""
    text = text or b""
    words = word_hashes(text)
    n = max(1, len(words))
    raw = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    shapes = word_hashes(raw[np.append(True, raw[1:] != raw[:-1])].tobytes()) if len(raw) else words
    out_i, out_v = [], []
    for h, size, base in ((words, WORDS, 0), (shapes, SHAPES, WORDS)):
        if len(h):
            i, c = np.unique((h % U64(size)).astype(np.int64), return_counts=True)
            v = np.sqrt(c)
            out_i.append(i + base)
            out_v.append(v / np.linalg.norm(v))
    lines = [x for x in text.split(b"\n") if x.strip()]
    rates = [
        len(np.unique(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n) / 10,
        len(text) / n / 20,
        np.log1p(len(lines)) / 5,
        float((raw == ord("A")).sum()) / max(1, len(text)),
        float((raw == ord("0")).sum()) / max(1, len(text)),
        1.0,
    ]
    out_i.append(np.arange(WORDS + SHAPES, TEXT_SIZE))
    out_v.append(np.array(rates))
    return np.concatenate(out_i).astype(np.int32), np.concatenate(out_v).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the metadata view."""
    keys = [f"s{source}", f"l{lang}", f"n{None if n_chars is None else int(max(0, n_chars)).bit_length()}"]
    h = [int(mix(word_hashes(("x" + k.replace(" ", "_")).encode())[:1])[0]) % (META - 2) for k in keys]
    return np.array([*h, META - 2, META - 1], dtype=np.int32), np.array([1, 1, 1, np.log1p(max(0, n_chars or 0)) / 10, 1], dtype=np.float32)


class Rows:
    """A sparse matrix by coordinates."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> None:
        self.n, self.size = len(rows), size
        self.row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        self.col = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, dtype=np.int32)
        self.val = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 80, ridge: float = 1e-4) -> np.ndarray:
    """Weights by gradient steps of a size that each coordinate's history sets."""
    w, seen, rate = np.zeros(x.size), np.full(x.size, 1e-8), 0.5
    for _ in range(steps):
        g = (sigmoid(x.dot(w)) - y) * weight
        g = np.bincount(x.col, weights=x.val * g[x.row], minlength=x.size) / weight.sum() + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


class Views:
    """Two classifiers that teach each other.  Every fifth labelled row calibrates."""

    def __init__(self, text: list, meta: list, y: np.ndarray) -> None:
        self.held = np.arange(len(y)) % 5 == 4
        self.y, self.base = y, float(y.mean())
        self.labelled = {"text": text, "meta": meta}
        self.size = {"text": TEXT_SIZE, "meta": META}
        self.rows = {v: [r for r, h in zip(x, self.held, strict=True) if not h] for v, x in self.labelled.items()}
        self.target = {v: y[~self.held].astype(float) for v in self.labelled}
        self.weight = {v: np.ones(int((~self.held).sum())) for v in self.labelled}
        self.taught: dict[str, set[int]] = {"text": set(), "meta": set()}  # keys that a view has labelled
        self.train()

    def train(self) -> None:
        self.model = {v: logistic(Rows(self.rows[v], self.size[v]), self.target[v], self.weight[v]).astype(np.float32) for v in self.rows}

    def teach(self, view: str, picks: list[tuple[int, float, tuple[np.ndarray, np.ndarray]]]) -> None:
        """view's picks, as (key, label, features in the other view), go to the other view."""
        other = "meta" if view == "text" else "text"
        self.taught[view] |= {k for k, _, _ in picks}
        self.rows[other] = self.rows[other] + [r for _, _, r in picks]
        self.target[other] = np.append(self.target[other], [y for _, y, _ in picks])
        self.weight[other] = np.append(self.weight[other], np.full(len(picks), 0.5))

    def wanted(self, picks: int) -> dict[int, int]:
        """How many documents of each class a view hands over in a round."""
        return {0: max(1, round(picks * (1 - self.base))), 1: max(1, round(picks * self.base))}

    def combined(self) -> dict:
        odds = [Rows([r for r, h in zip(self.labelled[v], self.held, strict=True) if h], self.size[v]).dot(self.model[v]) for v in ("text", "meta")]
        part = [(np.arange(3, dtype=np.int32), np.array([a / 4, b / 4, 1.0])) for a, b in zip(*odds, strict=True)]
        final = logistic(Rows(part, 3), self.y[self.held].astype(float), np.ones(len(part)), steps=400, ridge=1e-3)
        return {**self.model, "final": final, "base": self.base}


def surest(p: np.ndarray, keys: np.ndarray, taught: np.ndarray, side: int, most: int, sure: float = SURE) -> np.ndarray:
    """Places of the documents that are most surely of a class, and sure enough, not taught before."""
    score = p if side else 1 - p
    at = np.flatnonzero((score > sure) & ~np.isin(keys, taught))
    at = at[np.lexsort((keys[at], -score[at]))]
    _, once = np.unique(keys[at], return_index=True)
    return at[np.sort(once)][:most]


CANDIDATE = "view string, side int, score double, key long, i binary, v binary"


def candidates(free: DataFrame, views: Views, picks: int) -> DataFrame:
    """Each task's surest documents by view and class, with their features in the other view."""
    model, wanted = views.model, views.wanted(picks)
    taught = {v: np.array(sorted(k), dtype=np.int64) for v, k in views.taught.items()}

    def work(batches):
        import pyarrow as pa

        best: dict = {(v, side): [] for v in model for side in wanted}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            if not len(keys):
                continue
            found = {
                "text": [text_features(t) for t in as_bytes(batch.column(1))],
                "meta": [meta_features(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)],
            }
            for v, rows in found.items():
                p = sigmoid(np.array([float(model[v][i] @ x) for i, x in rows]))
                other = found["meta" if v == "text" else "text"]
                for side, most in wanted.items():
                    new = [(-(p[k] if side else 1 - p[k]), int(keys[k]), other[k]) for k in surest(p, keys, taught[v], side, most)]
                    merged = {x[1]: x for x in best[v, side] + new}
                    best[v, side] = sorted(merged.values(), key=lambda x: x[:2])[:most]
        out = [(v, side, -s, k, i.tobytes(), x.tobytes()) for (v, side), rows in best.items() for s, k, (i, x) in rows]
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CANDIDATE.split(", ")])

    return free.mapInArrow(work, CANDIDATE)


def _featured(docs: DataFrame, extra: str) -> DataFrame:
    """Packed features of (key, text, source, lang, n_chars, y)."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ti, tv, mi, mv = [], [], [], []
            for t, s, g, n in zip(as_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                for (i, v), a, b in ((text_features(t), ti, tv), (meta_features(s, g, n), mi, mv)):
                    a.append(i.tobytes())
                    b.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), *(pa.array(x, pa.binary()) for x in (ti, tv, mi, mv))], names=["key", "y", "ti", "tv", "mi", "mv"])

    return docs.mapInArrow(work, "key long, y int, ti binary, tv binary, mi binary, mv binary")


def _columns(docs: DataFrame) -> list:
    return ["text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, rounds: int = ROUNDS, picks: int = PICKS) -> dict:
    """Learns from a bounded sample of the labelled documents and from all others; the result's
    ``taught`` has how many labels each round gave to each view."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    least = int((1 << 20) * min(1.0, rows / max(1, known.count()))) + 1
    part = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < least).groupBy("doc_id").agg(F.max("y").alias("y"))
    has = docs.select("doc_id", *_columns(docs))
    key = F.xxhash64("doc_id", F.lit(3)).alias("key")
    got = _featured(has.join(F.broadcast(part), "doc_id").select(key, "text", "source", "lang", "n_chars", "y"), "y").collect()
    got = list({r.key: r for r in sorted(got, key=lambda r: (r.key, r.ti, r.tv, r.mi, r.mv))}.values())
    unpack = lambda i, v: (np.frombuffer(i, dtype=np.int32), np.frombuffer(v, dtype=np.float32))
    y = np.array([1 if r.y else 0 for r in got])
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return {"constant": float(y.mean()) if len(y) else 1.0}
    views = Views([unpack(r.ti, r.tv) for r in got], [unpack(r.mi, r.mv) for r in got], y)
    free = has.filter("doc_id is not null").join(F.broadcast(part.select("doc_id")), "doc_id", "left_anti").select(key, "text", "source", "lang", "n_chars")
    taught = []
    for _ in range(rounds):
        table = cut(candidates(free, views, picks), "candidates")
        new = {}
        for view in views.model:
            found = []
            for side, most in views.wanted(picks).items():
                # Two tasks can hold rows of one id.
                top = table.filter((F.col("view") == view) & (F.col("side") == side)).groupBy("key").agg(F.max_by(F.struct("score", "i", "v"), "score").alias("x"))
                found += [(r.key, float(side), unpack(r.x.i, r.x.v)) for r in top.orderBy(F.col("x.score").desc(), "key").limit(most).collect()]
            new[view] = found
        discard(table)
        for view, found in new.items():
            views.teach(view, found)
        taught.append({"meta" if view == "text" else "text": len(found) for view, found in new.items()})
        views.train()
    return {**views.combined(), "taught": taught}


def classify(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for every document; scores are from 0 to 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            a, b = [], []
            for t, s, g, n in zip(as_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if "constant" in model:
                    a.append(0.0)
                    b.append(0.0)
                    continue
                i, v = text_features(t)
                a.append(float(model["text"][i] @ v))
                where = (s, g, None if n is None else int(max(0, n)).bit_length())
                if where not in known:
                    if len(known) > 100_000:
                        known.clear()
                    i, v = meta_features(s, g, n)
                    known[where] = (float(model["meta"][i] @ v) - float(model["meta"][META - 2]) * float(v[3]))
                b.append(known[where] + float(model["meta"][META - 2]) * float(np.log1p(max(0, n or 0)) / 10))
            a, b = np.array(a), np.array(b)
            if "constant" in model:
                score = np.full(len(a), model["constant"])
            else:
                f = model["final"]
                score = sigmoid(f[0] * a / 4 + f[1] * b / 4 + f[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in (sigmoid(a), sigmoid(b), score)), pa.array(score >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select("doc_id", *_columns(docs)).mapInArrow(work, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")
