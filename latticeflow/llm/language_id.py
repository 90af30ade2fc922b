"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 drawn from a seed and its code point.  An n-gram is
the elementwise product of its letters' vectors, each rotated by its place in the n-gram; a text is
the sum of its n-grams' vectors; a language is the sum of its documents' vectors.  A document gets
the language whose prototype has the largest cosine with it.

Characters are lower-cased; a run of anything but letters is one gap, which is a symbol of its own.
Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the
language that sorts first; without any learned language every document is ``und``.  Extra columns
are ignored and every input row gives one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

SIZE, ORDER, SEED = 1024, 3, 20240229
FIT_ROWS = 20_000  # labelled rows to fit on, in expectation
KNOWN = 40_000  # n-gram vectors kept at a time


class Profiles:
    """Bundles texts into vectors; keeps a bounded table of n-gram vectors."""

    def __init__(self, size: int = SIZE, order: int = ORDER, seed: int = SEED) -> None:
        self.size, self.order, self.seed = size, order, seed
        self.letter_is = np.array([chr(c).isalpha() for c in range(0x10000)])
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, size), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 50_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.size, dtype=np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def gram(self, key: int) -> np.ndarray:
        codes = [(key >> (21 * k)) & 0x1FFFFF for k in range(self.order)][::-1]
        out = np.roll(self.letter(codes[0]), self.order - 1)
        for k, c in enumerate(codes[1:], 2):
            out = out * np.roll(self.letter(c), self.order - k)
        return out

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams and how often each occurs; None without letters."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        high = codes > 0xFFFF
        is_letter = self.letter_is[np.where(high, 0, codes)]
        if high.any():
            is_letter[high] = [chr(c).isalpha() for c in codes[high]]
        if not is_letter.any():
            return None
        codes = np.where(is_letter, codes, 0)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = np.concatenate([[0], codes[keep], [0]])
        if codes[1] == 0:
            codes = codes[1:]
        if len(codes) > 1 and codes[-2] == 0:
            codes = codes[:-1]
        n = len(codes) - self.order + 1
        if n < 1:
            codes = np.concatenate([codes, np.zeros(1 - n, dtype=codes.dtype)])
            n = 1
        key = np.zeros(n, dtype=np.int64)
        for k in range(self.order):
            key = (key << 21) | codes[k : k + n]
        return np.unique(key, return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        found = self.grams(text)
        if found is None:
            return None
        keys, counts = found
        if len(self.rows) + len(keys) > KNOWN:
            self.rows.clear()
        at = np.empty(len(keys), dtype=np.int64)
        for i, k in enumerate(keys.tolist()):
            r = self.rows.get(k)
            if r is None:
                r = self.rows[k] = len(self.rows)
                if r >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[r] = self.gram(k)
            at[i] = r
        out = np.zeros(self.size, dtype=np.float32)
        for lo in range(0, len(at), 4096):  # a bounded block of rows at a time
            out += counts[lo : lo + 4096].astype(np.float32) @ self.vectors[at[lo : lo + 4096]].astype(np.float32)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = FIT_ROWS, size: int = SIZE) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, from about ``rows`` labelled documents.

    The sample is every labelled document whose hash lies under rows / all: bounded, the same at
    every run, and without a shuffle of texts.  Each task sends one vector per language.
    """
    ready = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    n = ready.count()
    if n > rows:
        ready = ready.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int((1 << 20) * rows / n) + 1)

    def fold(batches):
        import pyarrow as pa

        hd, total = Profiles(size), {}
        for batch in batches:
            for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (v := hd.bundle(t)) is not None:
                    total[x] = total.get(x, 0) + v / max(1e-9, float(np.linalg.norm(v)))
        yield pa.RecordBatch.from_pydict({"l": pa.array(list(total), pa.string()), "v": pa.array([x.astype("f8") for x in total.values()], pa.list_(pa.float64()))})

    parts = ready.mapInArrow(tidied(fold), "l string, v array<double>").select("l", F.posexplode("v").alias("k", "x"))
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("l", "k").agg(F.sum("x").alias("x")).toLocalIterator():  # languages x size numbers
        sums.setdefault(r.l, np.zeros(size))[r.k] = r.x
    return {k: v / max(1e-9, np.linalg.norm(v)) for k, v in sorted(sums.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every document; score is the cosine, from 0 to 1."""
    names = sorted(prototypes)
    known = np.array([prototypes[k] for k in names], dtype=np.float32) if names else None
    size = known.shape[1] if names else SIZE
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches):
        import pyarrow as pa

        hd = Profiles(size)
        for batch in batches:
            pred, score = [], []
            for t in batch.column(1).to_pylist():
                v = hd.bundle(t) if known is not None else None
                if v is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cos = (known * v).sum(axis=1) / max(1e-9, float(np.linalg.norm(v)))  # equal prototypes get equal sums
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(predict), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = 0.1, text: str = "text") -> DataFrame:
    """The rows, as they are, whose text has a language with at least this score."""
    names, at = sorted(prototypes), docs.columns.index(text)
    known = np.array([prototypes[k] for k in names], dtype=np.float32) if names else None

    def work(batches):
        import pyarrow as pa

        hd = Profiles(known.shape[1] if names else SIZE)
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                v = hd.bundle(t) if known is not None else None
                keep.append(v is not None and float((known @ v).max()) >= min_score * max(1e-9, float(np.linalg.norm(v))))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(work), docs.schema)
