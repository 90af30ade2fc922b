"""Quality rules: text statistics and learned decision lists, in DataFrame functions alone.

Statistics come from array functions on each row, without a shuffle.  Windows of five words are
compared by 64-bit hashes within one text.

A decision list is learned by sequential covering.  From a bounded sample of labelled statistics a
rule grows by the threshold that gains most (FOIL's measure), is pruned on rows that did not help to
grow it, and is kept while it is precise enough there; what it covers is then left out and the next
rule is sought.  The list becomes one ordered conditional expression.

Defined results: null and empty texts have zero counts and fail the base rules; rows without a
label or with a null label teach nothing; without labelled rows of both kinds the list is empty and
keeps all; repeated rows get the same result each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FIT_ROWS = 8_000  # labelled rows to learn from, in expectation
MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 3, 0.9, 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once for each row.

    It is bound by a lambda, so that no rewriting of the plan can move it into another lambda and
    have it computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def _repeats(h: Column) -> Column:
    """Words in windows whose hash occurs twice or more in h, the hashes of all windows in order.

    In the order of hashes a window is a repeat if a neighbour is the same.  Each repeat covers five
    words, less what the next one covers.
    """
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        both = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.array_sort(F.transform(both, lambda k: F.get(s, k)["i"]))

    def cover(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1), x + 5) - x))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    return _bound(pairs, lambda s: _bound(places(s), cover))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of a text to its row."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.filter(F.split(t, WORD_GAP, -1), lambda x: x != ""), lambda x: F.xxhash64(x))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))
        # Only texts with a repeated window sort their windows.
        repeats = _bound(windows, lambda h: F.when((n >= 5) & (F.size(F.array_distinct(h)) < F.size(h)), _repeats(h)).otherwise(F.lit(0)))
        return F.struct(n.cast("long").alias("n"), repeats.cast("long").alias("r"))

    space = lambda x: F.translate(x, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: space(x) != "")
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))
    count = lambda chars: (F.char_length(t) - F.char_length(F.translate(t, chars, ""))).cast("long")
    d = docs.withColumns({"_words": _bound(words, of_words), "_lines": _bound(lines, of_lines)})
    return d.withColumns(
        {
            "n_words": F.col("_words.n"),
            "n_repeat_words": F.col("_words.r"),
            "n_lines": F.col("_lines.n"),
            "n_dup_lines": F.col("_lines.d"),
            "word_chars": F.char_length(space(t)).cast("long"),
            "n_symbols": count(SYMBOLS),
            "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈÄÖÜÑÍÓ"),
            "n_digits": count("0123456789"),
            "n_marks": count("!?.,;:"),
        }
    ).drop("_words", "_lines")


def features() -> dict[str, Column]:
    """What rules may test: rates, so that a text's length alone does not decide."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.col("n_upper") / chars,
        "digit_rate": F.col("n_digits") / chars,
        "mark_rate": F.col("n_marks") / words,
        "line_words": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) for rejecting a document."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self, row: dict[str, float]) -> bool:
        return all(row[f] <= x if op == "<=" else row[f] > x for f, op, x in self.conditions)


def _grow(rows: list[tuple[dict[str, float], bool]], names: list[str], most: int, barred: set[str]) -> tuple[tuple[str, str, float], ...]:
    """Adds the condition with the largest FOIL gain until none gains; a barred feature can't begin."""
    conditions: tuple[tuple[str, str, float], ...] = ()
    while len(conditions) < most:
        p0, n0 = sum(y for _, y in rows), sum(not y for _, y in rows)
        if not p0 or not n0:
            break
        best, before = (0.0, None), math.log2(p0 / (p0 + n0))
        for f in names:
            if not conditions and f in barred:
                continue
            order = sorted((r[f], y) for r, y in rows)
            total, ps = len(order), [0]
            for _, y in order:
                ps.append(ps[-1] + y)
            for k in range(1, total):
                if order[k][0] == order[k - 1][0]:
                    continue
                x = (order[k - 1][0] + order[k][0]) / 2
                for op, p, n in (("<=", ps[k], k - ps[k]), (">", p0 - ps[k], total - k - (p0 - ps[k]))):
                    if p >= MIN_COVERED and (gain := p * (math.log2(p / (p + n)) - before)) > best[0] + 1e-12:
                        best = (gain, (f, op, x))
        if best[1] is None:
            break
        conditions += (best[1],)
        rule = Rule(conditions[-1:], 0, 0)
        rows = [(r, y) for r, y in rows if rule.holds(r)]
    return conditions


def _prune(conditions: tuple, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    """The first conditions that do best on rows not used for growing."""
    best = None
    for n in range(1, len(conditions) + 1):
        rule = Rule(conditions[:n], 0, 0)
        hit = [y for r, y in rows if rule.holds(r)]
        p, value = sum(hit), (2 * sum(hit) - len(hit)) / max(1, len(hit))
        if best is None or value > best[0] + 1e-9:
            best = (value, Rule(conditions[:n], p / max(1, len(hit)), len(hit)))
    return best[1]


def learn(rows: list[tuple[dict[str, float], bool]], names: list[str]) -> list[Rule]:
    """An ordered list of rejecting rules; rows hold features and whether the label says reject."""
    grow, check = [x for k, x in enumerate(rows) if k % 3], [x for k, x in enumerate(rows) if k % 3 == 0]
    out: list[Rule] = []
    barred: set[str] = set()
    while conditions := _grow(grow, names, MAX_CONDITIONS, barred):
        rule = _prune(conditions, check)
        if rule.covered < MIN_COVERED or rule.precision < MIN_PRECISION:
            barred.add(conditions[0][0])  # a beginning that misled; another may do
            continue
        out.append(rule)
        barred.clear()
        grow, check = ([x for x in part if not rule.holds(x[0])] for part in (grow, check))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> list[Rule]:
    """Learns from about ``rows`` labelled documents: every labelled id whose hash is low enough.

    Only these ids are broadcast, a number that ``rows`` bounds, and only their statistics reach the
    driver.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) == 0).alias("reject"))
    n = known.count()
    part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(1, n))) + 1)
    part = part.groupBy("doc_id").agg(F.max("reject").alias("reject"))
    stats = base_statistics(docs.select("doc_id", "text").join(F.broadcast(part), "doc_id"))
    cols = features()
    got = stats.select("doc_id", "reject", *(c.alias(k) for k, c in cols.items())).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return learn([({k: r[k] for k in cols}, r["reject"]) for r in got], list(cols))


def rejecting(rules: list[Rule]) -> Column:
    """The index of the first rule that holds, in order; null if none does."""
    cols, out = features(), None
    for k, rule in enumerate(rules):
        test = None
        for f, op, x in rule.conditions:
            one = cols[f] <= F.lit(x) if op == "<=" else cols[f] > F.lit(x)
            test = one if test is None else test & one
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out if out is not None else F.lit(None).cast("int")


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, rule) for every document."""
    stats = base_statistics(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.select("doc_id", *BASE, failed.alias("base_failed"), rejecting(rules).alias("rule"))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
