import random
from collections import Counter

import numpy as np
from conftest import rows

from graphloom.llm import reading

EASY, HARD = [f"{a}{b}" for a in "bcdfg" for b in ("at", "og", "in", "up")], [f"{a}{b}ation" for a in ("ab", "con", "der", "ex", "in", "per", "pro", "re", "sub", "tran") for b in ("fect", "gress", "ject", "mit", "port", "rupt")]


def text(r, hard):
    words = HARD if hard else EASY
    n = r.randrange(15, 25) if hard else r.randrange(4, 8)
    return " ".join("The " + " ".join(r.choice(words if r.random() < 0.8 else EASY) for _ in range(n)) + "." for _ in range(r.randrange(3, 7)))


def corpus(n=600):
    r = random.Random(1)
    return [(i, text(r, i % 4 == 0), 4 + (i // 4) % 2 if i % 4 == 0 else 1 + i % 3) for i in range(n)]


def test_only_prose_is_read():
    p = reading.Prose()
    got = p.sentences("# Heading\n\nThe cat reads `code here` well. It's\nfine!\n\n| a | b |\n```\nx = not_prose\n```\n- src/a.py\n- camelCase snake_case https://x.example/y well-founded 42\n")
    assert got == [["the", "cat", "reads", "well"], ["it's", "fine"], ["well-founded"]]
    assert p.sentences(None) == p.sentences("") == p.sentences(" \n\t") == []


def test_languages():
    assert [reading.language(Counter(t.split())) for t in ("the cat is in a box", "der hund ist auf dem tisch und", "le chat est dans la maison pour que", "el gato es una cosa que por", "xyz")] == ["en", "de", "fr", "es", "en"]


def test_features_in_batches_equal_single_ones():
    p, r = reading.Prose(), random.Random(2)
    texts = [p.sentences(text(r, i % 2)) for i in range(20)] + [[]]
    shares = {"en": {w: r.random() for w in EASY + HARD[:20]}}
    lists = reading.Lists(shares)
    x, langs = reading.features(texts, lists)
    assert langs[-1] is None and np.isnan(x[-1]).all()
    for i, t in enumerate(texts[:-1]):
        one, _ = reading.features([t], lists)
        assert np.allclose(one[0], x[i])
        words = [w for s in t for w in s]
        assert np.isclose(x[i][6], np.mean([shares["en"].get(w, 0) < reading.SHARES[6] for w in words]))


def test_document_frequencies_count_documents(spark):
    df = spark.createDataFrame([(1, "The cat. The cat."), (2, "the dog"), (3, None), (4, "  ")], "doc_id long, text string")
    assert rows(reading.document_frequencies(df)) == [("en", "", 2), ("en", "cat", 1), ("en", "dog", 1), ("en", "the", 2)]


def test_held_out_accuracy(spark):
    c = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in c] + [(9001, None, "x"), (9002, "", "x"), (9003, " \n", "x")], "doc_id long, text string, level string")
    known = [(i, lv, f"rater_{k}") for i, _, lv in c if i % 3 == 0 for k in range(2)]
    labels = spark.createDataFrame([(*x, None) for x in known + known[:20]] + [(None, 3, "a", None), (3, None, "a", None)], "doc_id long, level int, rater string, rated_at timestamp_ntz")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs, labels).collect()}
    held = [(i, lv) for i, _, lv in c if i % 3]
    assert np.mean([got[i]["demanding"] == (lv >= 4) for i, lv in held]) >= 0.95
    for i in (9001, 9002, 9003):
        assert got[i]["score"] is None and got[i]["demanding"] is False
    assert {r["lang"] for r in reading.profile(reading.reading_levels(docs, labels)).collect()} == {"en", None}


def test_no_labels_one_kind_of_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 2, "a", None)], "doc_id long, level int, rater string, rated_at timestamp_ntz")
    for some in (labels, labels.limit(0)):
        got = reading.reading_levels(docs, some).collect()
        assert all(r["score"] is None and r["demanding"] == (r["formula"] >= reading.COLLEGE) for r in got)
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


def test_real_labels_are_met(spark, small):
    import os

    folder = os.path.join(os.path.dirname(small), "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "reading_labels"))
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = reading.reading_levels(docs, fit).select("doc_id", "demanding")
    both = reading.judged(held).join(got, "doc_id").collect()
    assert np.mean([(r["level"] >= 3.5) == r["demanding"] for r in both]) >= 0.93


def test_the_plain_formula_needs_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(200)] + [(9001, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs).collect()}
    for i in (0, 1, 7):
        r = got[i]
        assert r["score"] is None and abs(r["formula"] - (15.79 * r["unfamiliar"] + 0.0496 * r["sentence_length"] + (3.6365 if r["unfamiliar"] > 0.05 else 0))) < 1e-9
        assert r["demanding"] == (r["formula"] >= reading.COLLEGE)
    assert got[9001]["formula"] is None and got[9001]["demanding"] is False


def test_other_scripts_are_measured_among_their_own():
    p = reading.Prose()
    assert p.sentences("Ο σκύλος τρέχει. Это дом!") == [["ο", "σκύλος", "τρέχει"], ["это", "дом"]]
    assert p.sentences("我们读书。他走。") == [["我", "们", "读", "书"], ["他", "走"]]
    for text, lang in (("ο σκύλος τρέχει", "script:greek"), ("это дом", "script:cyrillic"), ("我们读书。", "script:cjk"), ("xyz", "en"), ("der hund ist это", "de")):
        assert reading.language(Counter(w for s in p.sentences(text) for w in s)) == lang


def test_documents_of_other_scripts_have_measures(spark):
    docs = spark.createDataFrame([(i, "Это дом. Это кот.") for i in range(5)] + [(9, "Непредсказуемость обусловленности предопределяется")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs).collect()}
    assert got[0]["lang"] == "script:cyrillic" and got[0]["unfamiliar"] == 0 and got[9]["demanding"] is not None and got[9]["n_words"] == 3
