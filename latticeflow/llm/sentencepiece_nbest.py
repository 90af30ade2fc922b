"""N-best segmentation over a SentencePiece model's pieces, and exact decoding.

The lattice of a text has an edge for every piece that matches, with the model's own score, and one
for each character without a piece of its own, spelt in byte pieces; that one scores UNKNOWN_PENALTY
below the model's least score (runs of word marks, which the model gives a placeholder score, left
out).  Scores are whole numbers in the model, so sums and comparisons are exact.  A forward Viterbi pass
gives each node the best score from the start.  A backward A* search then runs from the end with
those scores as its heuristic; the heuristic is exact, so paths leave the queue best first.

No piece has a word mark after another character (checked when the model is read), nor some signs
after a letter, so every path passes there and the lattice of a text is a chain of small lattices,
here called words.  The search runs in each word that can matter, and over the chain: of n best
segmentations none leaves the best path in a word outside the n - 1 whose runner-up costs least.  Words'
best paths are kept in a table of bounded bytes, which is emptied at the end of each task.

Defined results: null and empty texts have no pieces, score 0 and one (empty) segmentation; a text
holding the word mark itself is read as a space there, as the model's own encoder does; equal
scores of a word are ordered by fewer pieces, then by ids, except that the best path is the one whose
last pieces are longest; equal scores of a text come in the order in which the search meets them.
Every input row gives one row, extra columns are ignored.  The best path is the one of the highest
score; a model of kind BPE orders merges by score and can encode otherwise.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10  # what a character without a piece scores below the least score
TABLE_BYTES = 30_000_000  # of solved words; the words used before that are kept as long again
WORD_BYTES = 270  # what a solved word takes besides its text
LONG_WORD = 256  # longer words are not kept
TOGETHER = 1024  # documents whose new words are solved together
MANY = 40  # words up to this length are solved together
HASH = 0x9E3779B97F4A7C15
SLOTS = 1 << 20


class Segmenter:
    """Encodes to ids and decodes back; holds the pieces and a bounded table of words."""

    def __init__(self, model: str = MODEL, n_best: int = 4) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n_best = n_best
        self.text_of: dict[int, bytes] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        score: dict[int, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a word mark inside")
                self.id_of[piece], score[i] = i, sp.get_score(i)
                self.text_of[i] = piece.replace(MARK, " ").encode()
        if len(self.byte_id) != 256:
            raise ValueError("the model has no full set of byte pieces")
        if any(s > 0 or s != int(s) for s in score.values()):
            raise ValueError("the model's scores are not whole numbers up to 0")
        self.cost = {i: -int(s) for i, s in score.items()}
        self.unknown_cost = UNKNOWN_PENALTY + max(self.cost[i] for p, i in self.id_of.items() if p.strip(MARK))
        # Each piece's cost, and -1 for each beginning of one: a walk ends as soon as no piece can match.
        self.walk: dict[str, int] = {p[:k]: -1 for p in self.id_of for k in range(1, len(p))}
        self.walk |= {p: self.cost[i] for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.line_is_alone = not any("\n" in p for p in self.id_of)
        self.split = self.safe_split()
        self.forget()
        # The same for many words at once: an open hash table over the beginnings' hashes.
        hashes = {}
        for piece, c in self.walk.items():
            h = 0
            for ch in piece:
                h = (h * HASH + ord(ch) + 1) & ((1 << 64) - 1)
            hashes[h] = (c, self.id_of.get(piece, -1))
        if len(hashes) < len(self.walk) or 0 in hashes:
            raise ValueError("two beginnings of pieces share a hash")
        self.keys, self.key_cost, self.key_id = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int64), np.full(SLOTS, -1, dtype=np.int64)
        left = np.array(list(hashes), dtype=np.uint64)
        slot = self.slot_of(left)
        while len(left):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] == 0]
            self.keys[slot[first]] = left[first]
            self.key_cost[slot[first]] = [hashes[int(h)][0] for h in left[first]]
            self.key_id[slot[first]] = [hashes[int(h)][1] for h in left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) % SLOTS

    def forget(self) -> None:
        """Empties the tables of words."""
        self.known: dict[str, tuple[int, int, bytes]] = {}
        self.before: dict[str, tuple[int, int, bytes]] = {}
        self.paths: dict[str, list[tuple[int, bytes]]] = {}
        self.held = 0

    @staticmethod
    def slot_of(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(HASH) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no piece begins so."""
        slot = self.slot_of(h)
        key = self.keys[slot]
        out = np.where(key == h, slot, -1)
        open_at = np.flatnonzero((key != h) & (key != 0))
        while len(open_at):
            slot[open_at] = (slot[open_at] + 1) % SLOTS
            key = self.keys[slot[open_at]]
            hit = key == h[open_at]
            out[open_at[hit]] = slot[open_at[hit]]
            open_at = open_at[~hit & (key != 0)]
        return out

    def safe_split(self) -> re.Pattern:
        """Where every path must pass: before word marks, and between a letter and such a sign as
        follows no letter in any piece."""
        after_letter = {b for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        signs = "".join(c for c in "\n\t\r.,;:!?|#$%&*()[]{}<>\"'/-" if c not in after_letter)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id_of))  # spelt in bytes
        return re.compile(f"(?<=[^{MARK}])(?={MARK})" + (f"|(?<=[{alone}])" if alone else "") + (f"|(?<=[^\\W\\d_])(?=[{re.escape(signs)}])" if signs else ""))

    def keep(self, word: str, found: tuple[int, int, bytes]) -> None:
        self.known[word] = found
        self.held += WORD_BYTES + 2 * len(word) + len(found[2])

    def learn(self, words: set[str]) -> None:
        """Sees to it that the words (but long ones) are known, and solves new ones many at a time:
        those of one length advance together through Viterbi."""
        if self.held > TABLE_BYTES:
            self.before, self.known, self.held = self.known, {}, 0
        known, before = self.known, self.before
        new = words.difference(known)
        again = new.intersection(before)
        new -= again
        compound, single = [], set()
        for w in new:
            if w[1:].isalpha() and len(w) <= LONG_WORD:
                single.add(w)
            elif len(w) <= LONG_WORD:
                parts = self.split.split(w)
                single.update(parts)
                if len(parts) > 1:
                    compound.append((w, parts))
        single.difference_update(known, again)
        more = single.intersection(before)
        for w in itertools.chain(again, more):
            known[w] = before[w]
            self.held += WORD_BYTES + 2 * len(w)
        single -= more
        by_length: dict[int, list[str]] = {}
        for w in single:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            if n > MANY or len(same) < 8:
                for w in same:
                    self.word(w)
            else:
                for lo in range(0, len(same), 8192):
                    self.solve(same[lo : lo + 8192], n)
        for w, parts in compound:
            cost, gap, ids = zip(*map(known.__getitem__, parts), strict=True)
            self.keep(w, (sum(cost), min(gap), b"".join(ids)))

    def solve(self, words: list[str], n: int) -> None:
        count, none = len(words), 1 << 60
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(count, n).T.astype(np.int64)
        first, second = np.full((n + 1, count), none), np.full((n + 1, count), none)
        back, by = np.zeros((n + 1, count), dtype=np.int64), np.zeros((n + 1, count), dtype=np.int64)
        first[0] = 0

        def arrive(a: int, b: int, at: np.ndarray, cost: np.ndarray | int, ids: np.ndarray) -> None:
            v, f = first[a, at] + cost, first[b, at]
            better = v < f
            second[b, at] = np.minimum(np.minimum(np.maximum(v, f), second[b, at]), second[a, at] + cost)
            first[b, at] = np.where(better, v, f)
            at, ids = at[better], ids[better]
            back[b, at], by[b, at] = a, ids

        for a in range(n):
            at, h = np.arange(count), np.zeros(count, dtype=np.uint64)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                c = codes[b - 1, at]
                h = h * np.uint64(HASH) + (c + 1).astype(np.uint64)
                k = self.find(h)
                hit = k >= 0
                if b == a + 1:
                    ids = np.where(hit, self.key_id[k], -1)
                    arrive(a, b, at, np.where(ids >= 0, self.key_cost[k], self.unknown_cost), np.where(ids >= 0, ids, -1 - c))
                    at, h = at[hit], h[hit]
                else:
                    at, h, k = at[hit], h[hit], k[hit]
                    piece = self.key_id[k] >= 0
                    if piece.any():
                        arrive(a, b, at[piece], self.key_cost[k[piece]], self.key_id[k[piece]])
                if not len(at):
                    break
        taken = np.full((n, count), -(1 << 30), dtype=np.int32)
        node, each = np.full(count, n), np.arange(count)
        for step in range(1, n + 1):  # from the last piece, filled from the right
            on = each[node > 0]
            if not len(on):
                break
            taken[n - step, on] = by[node[on], on]
            node[on] = back[node[on], on]
        spelt = (taken < 0) & (taken > -(1 << 30))
        plain, size = ~spelt.any(axis=0), (taken > -(1 << 30)).sum(axis=0)
        data = np.ascontiguousarray(taken.T)
        flat = data.tobytes()
        gap = np.minimum(second[n] - first[n], none).tolist()
        ends = range(4 * n, 4 * n * (count + 1), 4 * n)
        ids = [flat[e - m : e] for e, m in zip(ends, (4 * size).tolist(), strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            ids[k] = self.packed(x for i in data[k, n - size[k] :].tolist() for x in ((i,) if i >= 0 else self.spelt(chr(-1 - i))))
        self.known.update(zip(words, zip(first[n].tolist(), gap, ids, strict=True), strict=True))
        self.held += (WORD_BYTES + 2 * n) * count

    @staticmethod
    def packed(ids) -> bytes:
        return np.fromiter(ids, dtype="<i4").tobytes()

    def spelt(self, piece: str) -> tuple[int, ...]:
        i = self.id_of.get(piece)
        return (i,) if i is not None else tuple(self.byte_id[c] for c in piece.encode("utf-8", "surrogatepass"))

    def forward(self, word: str) -> tuple[list[int], list[int], list[int], list[list[tuple[int, int]]]]:
        """Viterbi: least and second least cost to each node, the node before, and edges by end."""
        n, walk, none = len(word), self.walk, 1 << 60
        first, second, back = [0] + [none] * n, [none] * (n + 1), [0] * (n + 1)
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            f, g = first[a], second[a]
            for b in range(a + 1, n + 1):
                c = walk.get(word[a:b])
                more = c is not None
                if c is None or c < 0:
                    if b > a + 1:
                        if not more:
                            break
                        continue
                    c = self.unknown_cost
                into[b].append((a, c))
                v = f + c
                if v < first[b]:
                    second[b], first[b], back[b] = first[b], v, a
                elif v < second[b]:
                    second[b] = v
                if g + c < second[b]:
                    second[b] = g + c
                if not more:
                    break
        return first, second, back, into

    def word(self, word: str) -> tuple[int, int, bytes]:
        """(least cost, what the runner-up costs more, ids of the best path)."""
        found = self.known.get(word)
        if found is None:
            first, second, back, _ = self.forward(word)
            ids: list[tuple[int, ...]] = []
            b = len(word)
            while b:
                ids.append(self.spelt(word[back[b] : b]))
                b = back[b]
            found = (first[-1], min(second[-1] - first[-1], 1 << 60), self.packed(itertools.chain.from_iterable(reversed(ids))))
            if len(word) <= LONG_WORD:
                self.keep(word, found)
        return found

    def word_paths(self, word: str) -> list[tuple[int, bytes]]:
        """The best segmentations of one word as (cost, ids), best first, by backward A*."""
        if (found := self.paths.get(word)) is not None:
            return found
        first, _, _, into = self.forward(word)
        out: list[tuple[int, bytes]] = []
        queue = [(first[-1], 0, (), len(word), 0)]
        taken = [0] * (len(word) + 1)
        while queue and len(out) <= self.n_best:
            _, size, ids, at, done = heapq.heappop(queue)
            taken[at] += 1
            if taken[at] > self.n_best:  # no more than n paths through a node can be among the n best
                continue
            if at == 0:
                out.append((done, self.packed(ids)))
                continue
            for a, c in into[at]:
                piece = self.spelt(word[a:at])
                heapq.heappush(queue, (first[a] + c + done, size + len(piece), piece + ids, a, c + done))
        cost, _, ids = self.word(word)
        out = ([(cost, ids)] + [x for x in out if x[1] != ids])[: self.n_best]
        if len(word) <= LONG_WORD:
            if len(self.paths) >= 10_000:
                self.paths.clear()
            self.paths[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """Parts that every path goes between; the signs after letters are left to learn()."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if MARK + MARK in text or "\0" in text:
            return self.split.split(text)
        if self.line_is_alone:
            text = text.replace("\n", "\0\n\0")
        return [w for w in text.replace(MARK, "\0" + MARK).split("\0") if w]

    def picks(self, words: list[str]) -> tuple[tuple[bytes, ...], list[tuple[int, tuple[tuple[int, int], ...]]]]:
        """The ids of each word's best path, and the best segmentations as (cost, ((word, its way), ...))
        with the words that leave their best path, best first."""
        if not words:
            return (), [(0, ())]
        try:
            cost, gap, ids = zip(*map(self.known.__getitem__, words), strict=True)
        except KeyError:  # long words
            cost, gap, ids = zip(*map(self.word, words), strict=True)
        gaps, least = list(gap), []
        for _ in range(min(self.n_best - 1, len(words))):
            k = gaps.index(min(gaps))
            gaps[k] = 1 << 61
            least.append(k)
        # Backward A* over the chain.  Words that keep their best path cost what the heuristic says, so
        # the search goes from one word that may leave it to the one before.
        least.sort(reverse=True)
        total, out, turn = sum(cost), [], itertools.count()
        queue: list = [(total, next(turn), 0, ())]
        while queue and len(out) < self.n_best:
            c, _, at, pick = heapq.heappop(queue)
            if at == len(least):
                out.append((c, pick))
                continue
            ways = self.word_paths(words[least[at]])
            for j, w in enumerate(ways):
                heapq.heappush(queue, (c + w[0] - ways[0][0], next(turn), at + 1, ((least[at], j), *pick) if j else pick))
        return ids, out

    def ranks_of(self, words: list[str]) -> list[tuple[float, bytes, bool]]:
        """The best segmentations as (score, packed ids, spelling), best first, from a text's words;
        spelling says that the ids stand for the same bytes as the best path's."""
        parts, picks = self.picks(words)
        result = []
        for c, pick in picks:
            ways, same = parts, True
            if pick:
                ways = list(parts)
                for k, j in pick:
                    ways[k] = self.word_paths(words[k])[j][1]
                    same = same and self.bytes_of(ways[k]) == self.bytes_of(parts[k])
            result.append((float(-c), b"".join(ways), same))
        return result

    def n_best_of(self, text: str | None) -> list[tuple[float, list[int]]]:
        """The best segmentations of a whole text as (score, ids), best first."""
        return [(c, np.frombuffer(ids, dtype="<i4").tolist()) for c, ids, _ in self.ranks_of(self.words(text or ""))]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.word(w)[2] for w in self.words(text or "")), dtype="<i4").tolist()

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))

    def decode(self, ids) -> str:
        """The text of ids, packed or listed."""
        data = self.bytes_of(ids) if isinstance(ids, bytes) else b"".join(map(self.text_of.__getitem__, ids))
        return data.decode("utf-8", "surrogatepass")[1:]


_READY: dict[tuple[str, int], Segmenter] = {}


def segmenter(model: str, n_best: int) -> Segmenter:
    """One for each worker process; what grows with the words is dropped after each task."""
    if (model, n_best) not in _READY:
        _READY[model, n_best] = Segmenter(model, n_best)
    return _READY[model, n_best]


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str = MODEL, n_best: int = 4, ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, score, scores, round_trip, ids_sha256, n_best_pieces, n_best_round_trip,
    n_best_sha256[, ids, n_best_ids]) for every document.

    scores and the n_best columns list the best segmentations, at most n_best, best first; the other
    columns are the best one's. round_trip says that decoding the ids gives the text back (with the
    word mark as a space).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_pieces", "score", "scores", "round_trip", "ids_sha256", "n_best_pieces", "n_best_round_trip", "n_best_sha256"] + ["ids", "n_best_ids"] * ids

    def work(batches):
        import hashlib

        import pyarrow as pa

        seg = segmenter(model, n_best)
        for batch in batches:
            for lo in range(0, len(batch), TOGETHER):
                part = batch.slice(lo, TOGETHER)
                cols = [[] for _ in names[1:]]
                texts = part.column(1).to_pylist()
                split = [seg.words(t or "") for t in texts]
                seg.learn(set().union(*split))
                for t, words in zip(texts, split, strict=True):
                    scores, ways, same = zip(*seg.ranks_of(words), strict=True)
                    plain = (t or "").replace(MARK, " ")
                    first = seg.decode(ways[0]) == plain
                    # The same bytes as the best path's give the same text.
                    trips = [first if alike else seg.decode(way) == plain for way, alike in zip(ways, same, strict=True)]
                    sizes, hashes = [len(way) // 4 for way in ways], [hashlib.sha256(way).hexdigest() for way in ways]
                    whole = [np.frombuffer(way, dtype="<i4") for way in ways] if ids else [None]
                    for c, x in zip(cols, (sizes[0], scores[0], scores, first, hashes[0], sizes, trips, hashes, whole[0], whole), strict=False):
                        c.append(x)
                types = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))[: len(cols)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
        seg.forget()
        hand_back()

    schema = f"doc_id {kind}, n_pieces long, score double, scores array<double>, round_trip boolean, ids_sha256 string, n_best_pieces array<long>, n_best_round_trip array<boolean>, n_best_sha256 array<string>" + ", ids array<int>, n_best_ids array<array<int>>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def decode(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give null, none give an empty text."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        seg = segmenter(model, 1)
        for batch in batches:
            texts = [None if x is None else seg.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(work, f"doc_id {kind}, text string")
