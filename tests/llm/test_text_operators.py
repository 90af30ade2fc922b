"""Each operator against brute force or an exact round trip, and on odd rows."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.llm import (
    common,
    components,
    decontaminate,
    katz,
    language_id,
    near_dedup,
    quality_model,
    quality_rules,
    sentencepiece_nbest,
    substring_dedup,
    token_counts,
    warc,
)
from latticeflow.llm import queries as llm_queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, half long"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return GAP.findall(text or "")


def frame(spark, texts, schema=DOCS):
    """Rows with odd texts, nulls in every column, repeated rows and names that clash."""
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, base = text(70), text(120)
    out = [None, "", "  \n\t ", "a", "A b c", "été  漢字\x0b x", base, base, base.upper(), base + " tail"]
    out += [" ".join(w if rnd.random() > 0.01 else "zz" for w in base.split()) for _ in range(25)]
    out += [text(30) + " " + passage + "\n" + text(20) for _ in range(8)]
    out += [text(rnd.randint(1, 90)) for _ in range(30)]
    out += [" ".join(["same"] * 130), " ".join(["same"] * 90), text(6000), passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


def brute_repeats(texts, width):
    first, out = {}, []
    split = [words(t) for t in texts]
    for i, w in enumerate(split):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), i)
    for i, w in enumerate(split):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return split, out


@pytest.mark.parametrize("width", [50, 12])
def test_substring_dedup_matches_brute_force(docs, texts, width):
    split, kept = brute_repeats(texts, width)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, width=width).collect()}
    assert len(got) == len(texts)
    for i, (w, k) in enumerate(zip(split, kept, strict=True)):
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(w) - len(k)), i
        assert got[i].kept_text == " ".join(k)
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(k).encode()).hexdigest()


@pytest.mark.parametrize("width", [50, 12])
def test_levels_of_repeats_match_brute_force(docs, texts, width):
    split, longest, at = [words(t) for t in texts], [0] * len(texts), width
    while True:
        first: dict = {}
        for i, w in enumerate(split):
            for s in range(len(w) - at + 1):
                if first.setdefault(tuple(w[s : s + at]), i) < i:
                    longest[i] = at
        if at not in longest:
            break
        at *= 2
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, width=width, levels=True).collect()}
    assert max(longest) > width and [got[i].longest for i in range(len(texts))] == longest
    plain = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, width=width).collect()}
    assert all(plain[i].kept_sha256 == got[i].kept_sha256 for i in plain)


def test_cut_repeats_keeps_columns_and_untouched_texts(docs, texts):
    _, kept = brute_repeats(texts, 50)
    got = substring_dedup.cut_repeats(docs)
    assert got.schema == docs.schema
    for r in got.collect():
        changed = len(kept[r.doc_id]) < len(words(texts[r.doc_id]))
        assert r.text == (" ".join(kept[r.doc_id]) if changed else texts[r.doc_id])
        assert r.n_chars == (len(r.text) if changed else (None if r.text is None else len(texts[r.doc_id])))


def test_substring_dedup_defined_cases(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(3, w), (3, w), (5, w), (None, w), (9, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.n_removed) for r in got.collect()) == [(-1, 0), (3, 0), (3, 0), (5, 60), (9, 0)]
    empty = substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_repeat_lengths_doubles_until_none_survive(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(w)), (1, "x " + " ".join(w[:130])), (2, "y " + " ".join(w[200:260])), (3, "alone")]
    got = substring_dedup.repeat_lengths(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.longest for r in got.collect()} == {1: 100, 2: 50}


def brute_near(texts, num):
    sets = []
    for t in texts:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((at[a], at[b]))
            at = [x if v == y else v for v in at]
    return sets, at


@pytest.mark.parametrize("num", [85, 80, 95])
def test_near_duplicates_match_brute_force(docs, texts, num):
    sets, at = brute_near(texts, num)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, num=num).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), at[i], at[i] == i), i


def test_near_duplicates_follow_chains_within_one_list(spark):
    """Neighbours are linked, the ends are not: one component all the same."""
    texts = [" ".join(f"v{i}" if i < 4 * k else f"w{i}" for i in range(200)) for k in range(25)]
    _, at = brute_near(texts, 85)
    got = near_dedup.near_duplicates(frame(spark, texts), num=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(at))


@pytest.mark.parametrize(("num", "long_k"), [(85, near_dedup.LONG), (80, near_dedup.LONG), (85, 100)])
def test_near_duplicates_in_a_crowd_without_many_links(spark, num, long_k):
    """Copies of one text, most of them edited too much to be linked; a long sketch samples or not."""
    rnd = random.Random(num)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(160):
        w = list(base)
        for k in rnd.sample(range(150), rnd.choice([0, 1, 1, 2, 3, 3, 4, 6])):
            w[k] = f"x{n}_{k}"
        texts.append(" ".join(w[: rnd.choice([150, 150, 149, 140])]))
    _, at = brute_near(texts, num)
    assert 5 < len(set(at)) < 150
    got = near_dedup.near_duplicates(frame(spark, texts), num=num, long_k=long_k)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(at))


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        values = np.unique(rnd.integers(0, 1 << 62, 400).astype(np.uint64))
        a, b = values[rnd.random(len(values)) < 0.9], values[rnd.random(len(values)) < 0.9]
        bits = sum(int(x).bit_count() for x in (near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_near_duplicates_defined_cases(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (7, None), (8, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in got.collect()) == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (7, 7, True), (8, 8, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_overlap_bounds_the_binomial():
    for j in (0.8, 0.85, 0.95):
        t = near_dedup.least_overlap(j)
        miss = sum(math.comb(near_dedup.K, i) * j**i * (1 - j) ** (near_dedup.K - i) for i in range(t))
        assert 1 < t < near_dedup.K and miss <= near_dedup.MISS


def test_tables_of_a_job_are_deleted(spark):
    folder = pathlib.Path(common.scratch_dir(spark).removeprefix("file://")) / "tables"
    common.cut(spark.range(1), "first")
    before = set(folder.iterdir())
    left = lambda: sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    with common.passing(spark):
        with common.passing(spark):
            common.cut(spark.range(3), "inner")
            kept = common.cut(spark.range(4), "outer", stays=True)
        assert kept.count() == 4 and not list(folder.rglob("inner-*"))
        last = common.cut(kept, "last", stays=True)
    assert last.count() == 4 and left() == ["last"]
    rows = [(i, " ".join(f"w{k}" for k in range(60 + i % 2))) for i in range(6)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}
    assert left() == ["classes", "labels", "last", "sketches"]
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        common.cut(spark.range(3), "failed")
        raise ZeroDivisionError
    assert not list(folder.rglob("failed-*"))


def test_components_join_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (None, 3), (7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_token_counts(spark, docs, texts):
    bpe = token_counts.encoder()
    lengths = [len(bpe.encode_ordinary(t)) if t else 0 for t in texts]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs), block=16).cache()
    rows = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == collections.Counter(lengths)
    for k, r in rows.items():
        assert r.docs_ge == sum(x >= k for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in lengths)
        assert r.quantile == sum(x <= k for x in lengths) / len(lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    cut = token_counts.truncated_totals(sums, [0, 1, 7, 100, 10**6])
    assert {r.context_limit: (r.kept_tokens, r.cut_docs) for r in cut.collect()} == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in (0, 1, 7, 100, 10**6)}
    q = {r.probability: r.length for r in token_counts.length_quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    order = sorted(lengths)
    assert q == {p: order[math.ceil(p * len(order)) - 1] for p in (0.1, 0.5, 1.0)}
    empty = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([], DOCS)))
    assert empty.count() == 0


def edit_to_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(prev[j - 1] + (a != b), prev[j] + 1, row[j - 1] + 1)
    best = min(row)
    return best, row.index(best)


def test_myers_distance_matches_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(300):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        assert decontaminate.nearest(item, text, len(item)) == edit_to_substring(item, text)


def test_contaminated_matches_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [text(14) for _ in range(6)] + [None, "", "short"]
    items.append(items[0])

    def damage(t, n):
        t = list(t)
        for _ in range(n):
            k = rnd.randrange(len(t))
            t[k : k + 1] = rnd.choice(["", "z", t[k] + "y"])
        return "".join(t)

    texts = [None, "", "short"] + [text(40) + "  " + damage(items[k % 6], n).upper() + "\n" + text(30) for k, n in enumerate([0, 1, 2, 3, 4, 6, 9])]
    texts += [text(100), items[1] + " " + damage(items[2], 2), items[3], items[3]]
    bench = spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    expected = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            x, n = decontaminate.normal(x or ""), decontaminate.normal(t or "")
            if x:
                e, end = edit_to_substring(x, n)
                if e <= int(len(x) * decontaminate.BUDGET):
                    expected.add((d, i, e, end))
    table = frame(spark, texts)
    for block in (decontaminate.BLOCK_CHARS, 100):
        got = decontaminate.contaminated(table, bench, block_chars=block)
        assert {tuple(r) for r in got.collect()} == expected and expected
    bad = {d for d, *_ in expected}
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == set(range(len(texts))) - bad
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0
    # A very long text, repeated as a row, with an item at its end alone; columns that clash.
    long = text(60000) + " " + items[0]
    rows = [(1, long, 7, "a"), (1, long, 7, "a"), (2, long[: -len(items[0])], 8, "b")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id int, edits string"), bench.filter("item_id = 0")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, len(long))] * 2


def test_language_id_held_out(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 !!", "en"), (10**6 + 2, "", None), (10**6 + 3, "É", None)], data.schema)
    data = data.unionByName(odd).cache()
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = language_id.identify(data, language_id.fit(data.filter(part != 2)))
    rows = {r.doc_id: r for r in found.join(data.select("doc_id", "lang", (part == 2).alias("held")), "doc_id").collect()}
    assert len(rows) == data.count()
    assert [rows[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and rows[10**6].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    held = [r for r in rows.values() if r.held and r.lang and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in language_id.identify(data.limit(3), {}).collect()} == {"und"}
    assert language_id.fit(data.limit(0)) == {}
    kept = language_id.keep_identified(data, language_id.fit(data))
    assert kept.schema == data.schema and kept.filter("doc_id in (1000000, 1000001, 1000002)").count() == 0


def plain_bundle(text, letter, size):
    """The sum of all trigrams' vectors, one trigram at a time."""
    kept = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip()
    if not kept:
        return None
    at = lambda c: letter(0 if c == " " else ord(c)).astype(int)
    kept, out = f" {kept} ", np.zeros(size, dtype=int)
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        out += np.roll(at(a), 2) * np.roll(at(b), 1) * at(c)
    return out


def test_language_id_matches_brute_force(spark, docs, texts):
    """Fit and predictions, trigram by trigram; names clash, rows repeat, one text is long, an id is null."""
    rnd = random.Random(3)
    french = [" ".join(rnd.choice(["été", "château", "où", "français", "l'eau", "cœur"]) for _ in range(n)) for n in (5, 40, 9000)]
    more = [(None, french[0], "fr", 1, 2.0, 3), (500, french[1], "fr", 1, 2.0, 3), (500, french[1], "fr", 1, 2.0, 3), (501, french[2], None, 1, 2.0, 3), (502, "9 9", "fr", None, None, None)]
    odd = [(i, t, "en" if i % 3 else None, 1, 2.0, 3) for i, t in enumerate(texts)] + more
    table = spark.createDataFrame(odd, "doc_id long, text string, lang string, l int, score double, lang_pred int")
    hd, total = language_id.Profiles(), {}
    for _, t, g, *_ in odd:
        v = plain_bundle(t, hd.letter, hd.size)
        if g and v is not None:
            total[g] = total.get(g, 0) + v / np.linalg.norm(v)
    learned = language_id.fit(table)
    assert sorted(learned) == ["en", "fr"]
    assert all(np.allclose(learned[g], v / np.linalg.norm(v), atol=1e-6) for g, v in total.items())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in language_id.identify(table, learned).collect())
    want = []
    for i, t, *_ in odd:
        v = plain_bundle(t, hd.letter, hd.size)
        cos = {g: 0.0 if v is None else float(v @ learned[g] / np.linalg.norm(v)) for g in learned}
        best = max(cos, key=cos.get)
        want.append((i is None, i or 0, "und" if v is None else best, min(1.0, max(0.0, cos[best]))))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4


def test_language_ties_go_to_the_first_name(spark):
    rows = [(1, "abc def abc", "zz"), (2, "abc def abc", "aa"), (3, "abc def abc", "mm")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(table, language_id.fit(table)).collect()} == {"aa"}


def test_language_vectors_are_bound_and_bundled():
    hd = language_id.Profiles(256)
    a, b, c = (hd.letter(ord(x)).astype(int) for x in "abc")
    keys, counts = hd.grams("abc")
    assert len(keys) == 3 and counts.sum() == 3
    gap = hd.letter(0).astype(int)
    one = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * c + np.roll(b, 2) * np.roll(c, 1) * gap
    assert np.array_equal(hd.bundle("ABC!"), one)


def test_quality_model_learns_from_both_views(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    model = quality_model.fit(docs.withColumn("y", F.lit("clash")), labels.filter(train))
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src1", -5), (-3, "x " * 50000, "zz", "new", 100000)], "doc_id long, text string, lang string, source string, n_chars long")
    found = quality_model.classify(docs.select(odd.columns).unionByName(odd), model)
    rows = found.join(labels.filter(~train), "doc_id").select("kept", "quality").collect()
    assert len(rows) > 500 and sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.93
    good = [r for r in rows if r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert found.filter("doc_id < 0").filter("score between 0 and 1").count() == 3
    assert len(model["taught"]) == quality_model.ROUNDS and all(t["meta"] > 0 for t in model["taught"])
    assert quality_model.fit(docs, labels.limit(0)) == {"constant": 1.0}
    assert quality_model.classify(docs.limit(0), {"constant": 1.0}).count() == 0


def test_quality_model_repeated_rows_and_ties(spark):
    """Many equal texts are equally sure; repeated rows of one id are scored alike and change nothing."""
    rows = [(i, f"good plain words {'and more ' * 20}" if i % 2 else "BUY $$$ 99 " * 8, "en", f"s{i % 2}", 100, "clash") for i in range(240)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (61, None), (None, 0)], "doc_id long, quality int")
    once = spark.createDataFrame(rows + [(None, "good plain words", "en", "s1", 16, "clash")], schema)
    twice = once.unionByName(once)
    scores = []
    for table in (once, twice):
        model = quality_model.fit(table, labels)
        found = quality_model.classify(table, model).filter("doc_id is not null").collect()
        assert all(r.kept == bool(r.doc_id % 2) for r in found)
        by_id = collections.defaultdict(set)
        for r in found:
            by_id[r.doc_id].add(r.score)
        assert len(by_id) == 240 and all(len(x) == 1 for x in by_id.values())
        scores.append({i: x.pop() for i, x in by_id.items()})
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in scores[0])


def model_scores():
    """Every piece's score as the library reads it from the model, and the ids of byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.MODEL)
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return pieces, {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}


def brute_scores(text, n, pieces):
    """The n best scores of all segmentations, by keeping the n best at every place of the whole text."""
    if not text:
        return [0.0]
    text = sentencepiece_nbest.MARK + text.replace(" ", sentencepiece_nbest.MARK)
    spelt = min(s for p, (_, s) in pieces.items() if p.strip(sentencepiece_nbest.MARK)) - sentencepiece_nbest.UNKNOWN_PENALTY
    best, longest = [[0.0]], max(map(len, pieces))
    for b in range(1, len(text) + 1):
        into = [s + pieces[text[a:b]][1] for a in range(max(0, b - longest), b) if text[a:b] in pieces for s in best[a]]
        if text[b - 1] not in pieces:
            into += [s + spelt for s in best[b - 1]]
        best.append(sorted(into, reverse=True)[:n])
    return best[-1]


def score_of(ids, pieces, byte_ids):
    """The score of one segmentation from its ids alone."""
    spelt = min(s for p, (_, s) in pieces.items() if p.strip(sentencepiece_nbest.MARK)) - sentencepiece_nbest.UNKNOWN_PENALTY
    by_id, back = {i: s for i, s in pieces.values()}, {i: b for b, i in byte_ids.items()}
    return sum(by_id[i] if i in by_id else spelt * (back[i] & 0xC0 != 0x80) for i in ids)


def test_costs_are_the_models_scores():
    seg, (pieces, _) = sentencepiece_nbest.Segmenter(), model_scores()
    assert {p: -seg.cost[i] for p, i in seg.id_of.items()} == {p: s for p, (_, s) in pieces.items()}
    assert len(set(seg.cost.values())) > 31_000


def test_segmentation_is_n_best_over_whole_texts(texts):
    seg, (pieces, byte_ids) = sentencepiece_nbest.Segmenter(n_best=5), model_scores()
    real = [r for r in texts if r and len(r) < 2000]
    for text in ["hello", "hello world", "a b", "  two", "a  b   ", "né漢𝄞", "x\ny", "ab.c", "int.", "a,b;c", "\0x \ty\r", "z" * 300, *real]:
        for learnt in (False, True):
            if learnt:
                seg.forget()
                seg.learn(set(seg.words(text)))
            got = seg.n_best_of(text)
            assert [s for s, _ in got] == brute_scores(text, 5, pieces), text
            assert len({tuple(i) for _, i in got}) == len(got)
            for s, ids in got:
                assert seg.decode(ids) == text and score_of(ids, pieces, byte_ids) == s
            assert seg.encode(text) == got[0][1]


def test_word_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_nbest, "TABLE_BYTES", 100_000)
    seg, rnd = sentencepiece_nbest.Segmenter(n_best=2), random.Random(4)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    for _ in range(30):
        t = text()
        seg.learn(set(seg.words(t)))
        assert len(seg.known) + len(seg.before) < 1_500
        assert seg.decode(seg.n_best_of(t)[0][1]) == t
    seg.forget()
    assert not seg.known and not seg.before


def test_sentencepiece_round_trip(spark, docs, texts):
    coded = sentencepiece_nbest.encode(docs, n_best=3).cache()
    rows = {r.doc_id: r for r in coded.collect()}
    assert len(rows) == len(texts) and all(r.round_trip for r in rows.values())
    back = {r.doc_id: r.text for r in sentencepiece_nbest.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert rows[0].n_pieces == rows[1].n_pieces == 0 and rows[0].scores == [0.0]
    assert all(r.scores == sorted(r.scores, reverse=True) and len(r.ids) == r.n_pieces for r in rows.values())
    assert sentencepiece_nbest.encode(docs.limit(0)).count() == 0


def test_sentencepiece_gives_every_segmentation(spark, docs, texts):
    seg = sentencepiece_nbest.Segmenter(n_best=3)
    short = {r.doc_id: r.asDict() for r in sentencepiece_nbest.encode(docs, n_best=3, ids=False).collect()}
    more = 0
    for r in sentencepiece_nbest.encode(docs, n_best=3).collect():
        t, want = texts[r.doc_id] or "", seg.n_best_of(texts[r.doc_id])
        assert r.scores == [c for c, _ in want] and r.n_best_ids == [i for _, i in want] and r.n_best_ids[0] == r.ids
        assert len({tuple(i) for i in r.n_best_ids}) == len(want)
        assert r.n_best_pieces == [len(i) for _, i in want]
        assert r.n_best_round_trip == [seg.decode(i) == t.replace(sentencepiece_nbest.MARK, " ") for _, i in want]
        assert r.n_best_sha256 == [hashlib.sha256(np.array(i, dtype="<i4").tobytes()).hexdigest() for _, i in want]
        assert all(short[r.doc_id][c] == r[c] for c in short[r.doc_id])
        more += len(want) > 1
    assert more > 5


def test_warc_round_trip(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("aé漢\r\n ") for _ in range(60000))
    html = [None, "", "x", "y" * 999, "y" * 999, "z" * 1000, "z" * 1000, "z" * 1000, long, long, long + "!", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 40]
    pages = spark.createDataFrame([(i, None if i % 3 == 0 else f"http://x/{i}\r\nEvil: 1", h, "sha") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    path = warc.write(pages, segment_bytes=5000)
    records = warc.read(spark, path)
    assert records.filter("record_type = 'continuation'").count() > 10
    rows = {r.page_id: r for r in warc.resolve(warc.reassemble(records)).collect()}
    assert len(rows) == len(html) and all(r.error is None for r in rows.values())
    for i, h in enumerate(html):
        data = (h or "").encode()
        same = [k for k, x in enumerate(html) if x == h and len(data) >= 1000]
        keeper = max(same, default=i)
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if keeper == i else ("revisit", keeper))
        assert rows[i].payload is None if keeper != i else bytes(rows[i].payload) == data
    cut = records.filter("segment is null or segment <> 2")
    assert {r.page_id for r in warc.reassemble(cut).filter("error is not null").collect()} == {9, 10}
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_warc_repeated_and_missing_ids(spark):
    a, b, c, d = "a" * 40000, "b" * 40000, "c" * 2000, "d" * 3000
    rows = [(1, "u1", a), (1, "u2", a), (1, "u3", b), (2, "u4", c), (2, "u5", d), (3, "u6", c), (4, "u7", "x"), (4, "u8", "x"), (None, "u9", b), (None, "v1", "n" * 30000), (None, "v2", "n" * 30000), (None, "v3", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read(spark, warc.write(pages)).cache()
    assert records.select("record_id").distinct().count() == records.count()
    got = {r.target_uri: r for r in warc.resolve(warc.reassemble(records)).collect()}
    assert len(got) == len(rows) and all(r.error is None for r in got.values())
    revisits = {"u4": 3, "u9": 1}
    for i, url, html in rows:
        r, data = got[url], (html or "").encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(data), hashlib.sha1(data).hexdigest()), url
        assert (r.record_type, r.refers_to) == (("revisit", revisits[url]) if url in revisits else ("response", None)), url
    assert {r.refers_to_id for r in got.values() if r.refers_to_id} <= {r.record_id for r in got.values()}


def test_warc_archives_are_parsed_once(spark, tmp_path, monkeypatch):
    """Origins within an archive, over the edges of archives and with a lost archive, against the
    records taken one by one; the query's result reads no archive again."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    rnd = random.Random(6)
    html = [None, "", "x" * 1200, "x" * 1200] + ["".join(rnd.choice("aé漢\r\n ") for _ in range(n)) for n in (9000, 9000, 200, 40000, 15000, 12000)]
    html.append(html[7])
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    result = llm_queries.op8_warc(spark, str(tmp_path))
    assert "binaryFile" not in result._jdf.queryExecution().toString()
    assert {r.page_id: r.payload_bytes for r in result.collect()} == {i: len((h or "").encode()) for i, h in enumerate(html)}
    path = warc.write(pages, segment_bytes=5000)
    tables = lambda: [sorted(map(repr, warc.resolve(t).select(*warc._names(warc.PAGE), "refers_to").collect())) for t in (warc.read_pages(spark, path), warc.reassemble(warc.read(spark, path)))]
    got, expected = tables()
    assert got == expected and len(got) == len(html) and all("error=None" in r for r in got)
    files = sorted(f for f in pathlib.Path(path.removeprefix("file://")).glob("part-*"))
    assert len(files) > 10
    for f in files[4:6]:
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    got, expected = tables()
    assert got == expected and any("error='" in r for r in got)
    assert warc.read_pages(spark, warc.write(pages.limit(0))).count() == 0


def test_chunked_framing():
    for data in (b"", b"x", b"ab" * 9000):
        assert warc.unchunked(warc.chunked(data, 100)) == data
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def brute_statistics(text):
    w = words(text)
    often = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if often[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if GAP.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_statistics_match_brute_force(spark, docs, texts):
    more = ["a b c d e a b c d e f", "x\nx\n\n \nx\ny", "#$ %% <a> | & *", "a b c d e f a b c d e f a b", "q w e r t y u i o p z"]
    table = frame(spark, texts + more)
    rows = {r.doc_id: r for r in quality_rules.apply_rules(table, []).collect()}
    for i, t in enumerate(texts + more):
        expected = brute_statistics(t)
        assert tuple(rows[i][c] for c in quality_rules.BASE) == expected, i
        assert rows[i].base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert rows[i].kept == (not rows[i].base_failed) and rows[i].rule is None


def test_rules_separate_and_apply_in_order(spark):
    rnd = random.Random(2)
    rows = [({"a": rnd.random() + (k % 4 == 0), "b": rnd.random()}, k % 4 == 0) for k in range(400)]
    rules = quality_rules.learn(rows, ["a", "b"])
    assert rules and rules[0].conditions[0][0] == "a"
    assert sum(any(x.holds(r) for x in rules) == y for r, y in rows) > 390
    assert quality_rules.learn([r for r in rows if r[1]], ["a", "b"]) == [] and quality_rules.learn([], ["a"]) == []
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    rules = quality_rules.fit(docs, labels.filter(train))
    got = quality_rules.apply_rules(docs, rules).join(labels.filter(~train), "doc_id").filter("not base_failed").collect()
    good = [r for r in got if r.quality]
    assert len(good) > 300 and sum(r.kept for r in good) / len(good) > 0.98
    assert quality_rules.fit(docs, labels.limit(0)) == []
    assert "Python" not in quality_rules.apply_rules(docs, rules)._jdf.queryExecution().toString()


def test_rules_as_columns_match_rules_by_hand(spark, docs, texts):
    """The conditional expression against each rule evaluated in Python; thresholds that rows meet
    exactly count as not above, the first of equal rules rejects, and repeated rows agree."""
    stats = quality_rules.base_statistics(docs.select("doc_id", "text"))
    rows = {r.doc_id: r.asDict() for r in stats.select("doc_id", *(c.alias(k) for k, c in quality_rules.features().items())).collect()}
    middle = sorted(r["mean_word"] for r in rows.values())[len(rows) // 2]
    one = quality_rules.Rule((("mean_word", ">", middle), ("line_words", ">", 50.0)), 1.0, 5)
    rules = [one, one, quality_rules.Rule((("mean_word", "<=", middle),), 1.0, 5)]
    got = quality_rules.apply_rules(docs.unionByName(docs), rules).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        first = next((k for k, x in enumerate(rules) if x.holds(rows[r.doc_id])), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
    assert {r.rule for r in got} >= {0, 2, None} or {r.rule for r in got} >= {0, 2}
    assert quality_rules.apply_rules(docs.limit(0), rules).count() == 0


def brute_katz(texts, learns, order):
    """Counts of whole n-grams and the recursion over orders, one word at a time."""
    split = [[w.encode() for w in words((t or "").translate({c: c + 32 for c in range(65, 91)}))] + ["end"] for t in texts]
    counts = [collections.Counter() for _ in range(order + 1)]
    for w, ok in zip(split, learns, strict=True):
        if ok:
            w = ["start", *w]
            for n in range(1, order + 1):
                counts[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(w)))
    after = collections.defaultdict(dict)
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            after[g[:-1]][g[-1]] = c
    d = [None] + [katz.discounts([0] + [sum(c == k for c in counts[n].values()) for k in range(1, katz.CAP + 2)]) for n in range(1, order + 1)]
    worth = lambda n, c: d[n][c] * c if c <= katz.CAP else c - 0.5
    total = sum(counts[1].values())
    unknown = sum(c - worth(1, c) for c in counts[1].values()) / total
    weights = {}

    def p(context, w):
        if not context:
            c = counts[1][w,]
            return worth(1, c) / total if c else unknown
        seen, n = after.get(context, {}), len(context) + 1
        if w in seen:
            return worth(n, seen[w]) / sum(seen.values())
        if not seen:
            return p(context[1:], w)
        if context not in weights:
            left = sum(c - worth(n, c) for c in seen.values()) / sum(seen.values())
            weights[context] = left / (1 - sum(p(context[1:], x) for x in seen))
        return weights[context] * p(context[1:], w)

    return split, counts, p, after


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_matches_brute_force_and_sums_to_one(spark, docs, texts, order):
    learns = [zlib.crc32(str(i).encode()) % 3 != 0 for i in range(len(texts))]
    split, counts, p, after = brute_katz(texts, learns, order)
    uni, total = {g[0]: c for g, c in counts[1].items()}, sum(counts[1].values())
    for a in [("start",), ("nowhere",), *[g for g in after if len(g) == order - 1][:30]]:
        assert sum(p(a, b) for b in uni) + p(a, "unknown") == pytest.approx(1, abs=1e-9)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 0
    for chunk in (katz.CHUNK_TOKENS, 150):
        rows = {r.doc_id: r for r in katz.score(docs, train, order=order, chunk_tokens=chunk).collect()}
        assert len(rows) == len(texts)
        for i, w in enumerate(split):
            r, w2 = rows[i], ["start", *w]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in uni for x in w), total)
            assert r.base_score == pytest.approx(sum(math.log10((uni.get(x, 0) + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w))
            assert r.score == pytest.approx(sum(math.log10(p(tuple(w2[max(0, k - order + 1) : k]), w2[k])) for k in range(1, len(w2))), abs=1e-6), i


def test_katz_ids_of_any_type_and_repeated_rows(spark):
    for kind, ids in (("smallint", [1, 1, 2, None]), ("string", ["a", "a", "b", None]), ("decimal(10,2)", [None] * 4)):
        rows = spark.createDataFrame([(i, "x y z x y", "clash") for i in ids], "doc_id string, text string, score string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = katz.score(rows, F.lit(True))
        assert got.schema["doc_id"].dataType.simpleString() == kind
        got = got.collect()
        assert len(got) == 4 and len({r.score for r in got}) == 1 and {r.train_tokens for r in got} == {24}


def test_katz_without_training_or_rows(spark, docs):
    rows = katz.score(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in rows} == {0} and all(math.isfinite(r.base_score) and math.isfinite(r.score) for r in rows)
    assert katz.score(docs.limit(0), F.lit(True)).count() == 0
