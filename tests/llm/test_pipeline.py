"""The pipeline against a single-process version of its stages."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from latticeflow.llm import decontaminate, language_id, sentencepiece_nbest

from .test_text_operators import brute_near, brute_repeats, edit_to_substring, plain_bundle


def fixture():
    rnd = random.Random(21)
    vocab = {"en": [a + b for a in ("th", "an", "er", "in") for b in ("e", "ing", "ed", "ly", "st")], "fr": [a + b for a in ("é", "oi", "eau", "qu") for b in ("re", "ment", "le", "ç", "x")]}
    text = lambda g, n: " ".join(rnd.choice(vocab[g]) + rnd.choice(vocab[g]) for _ in range(n))
    items = [text("en", 16), text("fr", 14)]
    passage, base = text("en", 64), text("fr", 110)
    rows = [(text(g, rnd.randint(20, 120)), g) for g in ("en", "fr") * 12]
    rows += [(base, "fr"), (base, "fr"), (base + " " + text("fr", 3), "fr"), (None, "en"), ("1234 !!", "en"), ("", None)]
    rows += [(text("en", 40) + "\n" + passage + "  " + text("en", 30), "en") for _ in range(4)]
    rows += [(text("en", 30) + " " + items[0].upper() + "!! " + text("en", 20), "en"), (items[1], "fr")]
    return rows, items


def expected(rows, items):
    hd = language_id.Profiles()
    total = {}
    for t, g in rows:
        v = plain_bundle(t, hd.letter, hd.size)
        if g is not None and v is not None:
            total[g] = total.get(g, 0) + v.astype(float) / max(1e-9, np.linalg.norm(v))
    known = [v / np.linalg.norm(v) for v in total.values()]

    def identified(t):
        v = plain_bundle(t, hd.letter, hd.size)
        return v is not None and max(p @ v for p in known) >= 0.1 * np.linalg.norm(v)

    ids = [i for i, (t, _) in enumerate(rows) if identified(t)]
    _, at = brute_near([rows[i][0] for i in ids], 80)
    ids = [i for k, i in enumerate(ids) if at[k] == k]
    texts = [rows[i][0] for i in ids]
    split, kept = brute_repeats(texts, 50)
    texts = [" ".join(k) if len(k) < len(w) else t for t, w, k in zip(texts, split, kept, strict=True)]
    norm = [decontaminate.normal(x) for x in items]
    bad = [any(edit_to_substring(x, decontaminate.normal(t))[0] <= int(len(x) * decontaminate.BUDGET) for x in norm) for t in texts]
    seg = sentencepiece_nbest.Segmenter(n_best=2)
    out = {}
    for i, t, b in zip(ids, texts, bad, strict=True):
        if not b:
            (score, best), *_ = seg.n_best_of(t)
            out[i] = (len(best), hashlib.sha256(np.array(best, dtype="<i4").tobytes()).hexdigest(), True, round(score, 6))
    return out


def test_pipeline_matches_single_process(spark, tmp_path):
    rows, items = fixture()
    table = [(i, t, g, f"src{i % 3}", None if t is None else len(t)) for i, (t, g) in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_pieces, r.ids_sha256, r.round_trip, round(r.score, 6)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = expected(rows, items)
    assert got == want and 20 < len(want) < len(rows) - 5


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(0, "abc def", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.schema.simpleString() == docs.schema.simpleString(), name
            assert at.count() == (0 if empty else 1), name
    assert [s for s, _ in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "cut_repeated_passages", "drop_contaminated", "encode_pieces"]


def test_stages_on_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    copy, long, item = text(80), text(40000), text(12)
    extra = ("x", 1, "y", "z")
    rows = [(3, copy, "en", *extra), (3, copy, "en", *extra), (5, copy, None, *extra), (None, copy, "en", *extra), (6, long, "en", *extra), (7, text(30) + " " + item, "en", *extra), (8, None, None, None, None, None, None), (9, "", "en", *extra)]
    schema = "doc_id long, text string, lang string, _spans string, component_id int, kept string, _span_id string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        left.append(sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()))
    assert left == [[-1, 3, 3, 5, 6, 7], [-1, 3, 3, 6, 7], [-1, 3, 3, 6, 7], [-1, 3, 3, 6]]
    assert {r.doc_id: r.text for r in docs.collect()} == {None: copy, 3: copy, 6: long}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 3, 3, 6] and all(r.round_trip for r in got)
