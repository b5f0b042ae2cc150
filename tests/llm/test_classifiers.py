"""Toxicity and language: held-out accuracy on small made texts, and odd rows."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from duskgrid.llm import common, language_id, toxicity

SYL = {"en": ["th", "in", "er", "on", "an", "re", "st"], "de": ["sch", "ung", "ein", "keit", "ü", "ber"], "fr": ["eau", "é", "tion", "ou", "ç", "ment"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_toxicity_generalises_to_new_forms():
    rng = random.Random(1)
    docs, y = [], []
    for i in range(500):
        w = text(rng, "en", rng.randint(5, 150)).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), "moron" + rng.choice(["", "s", "in", "ic", "st"]))
        docs.append(" ".join(w))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(docs, np.array(y))
    s = toxicity.scores(m, pa.array(["the morond er", "In THE Morons, st", text(rng, "en", 2000), "", "?!", "er " * 3000 + "moronly" + " in" * 3000], pa.large_string()))
    assert (s[[0, 1, 5]] >= 0.3).all() and (s[[2, 3, 4]] < 0.3).all()


def test_toxicity_rows(spark):
    m = toxicity.fit(["bad moron", "good day"] * 20, np.array([1, 0] * 20))
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "moron " * 9, "c")], "doc_id long, text string, score string")
    got = toxicity.score(df, m).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and got[2].predicted == 1
    assert toxicity.score(df.limit(0), m).count() == 0
    assert toxicity.scores(toxicity.fit([], np.array([])), pa.array(["x"], pa.large_string()))[0] < 1e-9
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "moron" if i % 2 else "day") for i in range(40)], "doc_id long, text string")
    assert toxicity.fit_on(docs, labels).ngram.any() and not toxicity.fit_on(docs.limit(0), labels).ngram.any()


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(8, 80)), lang, 0) for i, lang in enumerate(rng.choice(list(SYL)) for _ in range(300))]
    df = spark.createDataFrame([*rows, (1000, None, "en", 0), (1001, "12 !?", None, 0), (None, "schung einkeit überung", None, 0)], "doc_id long, text string, lang string, score int")
    m = language_id.fit_on(df)
    got = language_id.identify(df, m).collect()
    assert len(got) == 303 and np.mean([r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000]) > 0.97
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == ("und", 0.0) and by[None][0] == "de" and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(df.limit(0), m).count() == 0
    assert language_id.predict(language_id.fit_on(df.limit(0)), pa.array(["the"], pa.large_string()))[0][0] == -1


def test_language_equals_kernel_by_hand():
    rng = random.Random(3)
    texts = [text(rng, lang, 20) for lang in SYL for _ in range(6)]
    sets = [set(np.flatnonzero(row).tolist()) for _, has in language_id.presence(pa.array(texts, pa.large_string())) for row in has]
    plain = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    assert all(abs(len(s) - len(p)) <= 3 for s, p in zip(sets, plain))  # hashes may meet, rarely
    m = language_id.fit(texts, [lang for lang in SYL for _ in range(6)])
    best, score = language_id.predict(m, pa.array(texts, pa.large_string()))
    assert [m.langs[i] for i in best] == [lang for lang in SYL for _ in range(6)]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    own = np.repeat(np.arange(3), 6)
    order = np.random.default_rng(3)
    names = sorted(SYL)
    place = np.array([names.index(lang) for lang in SYL for _ in range(6)])
    marks = np.concatenate([order.permutation(np.flatnonzero(place == k))[: language_id.LANDMARKS] for k in range(3)])
    k = kernel[:, marks]
    coef = np.linalg.solve(k.T @ k + 1e-3 * len(own) * k[marks] + 1e-8 * np.eye(len(marks)), k.T @ (place[:, None] == np.arange(3)))
    assert np.allclose(np.clip((k @ coef).max(axis=1), 0, 1), score, atol=1e-4)


def test_language_odd_training(spark):
    """A doc_id a thousand times, ties between languages, and a very long text."""
    rng = random.Random(5)
    rows = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(["en", "de"] * 40)]
    often = [(7000, text(rng, "en", 12), "en")] * 1000
    df = spark.createDataFrame([*rows, *often], "doc_id long, text string, lang string").repartition(4)
    once = spark.createDataFrame([*rows, often[0]], "doc_id long, text string, lang string")
    a, b = language_id.fit_on(df), language_id.fit_on(once)
    probe = pa.array([text(rng, lang, 20) for lang in ("en", "de") * 10], pa.large_string())
    assert a.langs == b.langs and (language_id.predict(a, probe)[0] == language_id.predict(b, probe)[0]).all()
    both = language_id.fit(["thinon er"] * 8, ["x", "y"] * 4)
    assert [both.langs[i] for i in language_id.predict(both, pa.array(["thinon"], pa.large_string()))[0]] == ["x"]
    best, score = language_id.predict(a, pa.array([text(rng, "de", 120_000)], pa.large_string()))
    assert a.langs[best[0]] == "de" and 0 < score[0] <= 1


def test_toxicity_equals_windows_by_hand():
    """Scores against n-grams, means and windows spelled out word by word."""
    rng = random.Random(9)
    rows = [text(rng, "en", rng.randint(1, 60)) for _ in range(60)]
    m = toxicity.fit([t + (" moron" if i % 3 == 0 else "") for i, t in enumerate(rows)], np.array([int(i % 3 == 0) for i in range(60)]))
    tests = [*rows[:20], "moron", "a", "x " * 40, rows[0] + " morons " + rows[1], "Ünlu'moron 42"]
    got = toxicity.scores(m, pa.array(tests, pa.large_string()))
    import re

    from duskgrid.llm.words import word_ngrams

    for t, s in zip(tests, got, strict=True):
        words = re.findall(r"[^\W_]+", t.lower())
        bags = [word_ngrams([w], toxicity.SIZES, m.buckets_log2)[1] for w in words]
        for w, bag in zip(words, bags, strict=True):
            assert len(bag) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.SIZES)
        tops = []
        for i in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            some = np.concatenate(bags[i : i + toxicity.WINDOW])
            tops.append(m.ngram[some].mean() + m.bias)
        assert abs(s - 1 / (1 + np.exp(-(max(tops) * m.slope + m.shift)))) < 1e-6


def test_toxicity_odd_training(spark):
    """A doc_id a thousand times and labelled both ways; a very long text."""
    rows = [(i, "bad moron here" if i % 2 else "a good day") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    often = spark.createDataFrame([*rows, *([(9000, "moron again")] * 1000)], "doc_id long, text string").repartition(3)
    twice = spark.createDataFrame([*labels, (9000, 1), (9000, 0), (9000, 1)], "doc_id long, toxic int")
    sample = toxicity.training_rows(often, twice, {1: 2000, 0: 3200}, 10_000)
    assert sample.where("text = 'moron again'").count() == 1 and sample.where("text = 'moron again'").first().toxic == 1
    m = toxicity.fit_on(often, twice)
    s = toxicity.scores(m, pa.array(["a good day " * 60_000, "a good day " * 60_000 + "bad moron here"], pa.large_string()))
    assert s[0] < 0.3 <= s[1]


def test_toxicity_learns_from_a_few_hundred_rows(spark):
    """At sf0.01 9 of the 14 held-out toxic documents hold one of the words that make the others toxic; the rest can't be told."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs.select("doc_id", "text"), labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).toPandas()
    assert (rows.predicted[rows.toxic == 1]).mean() >= 0.6 and (rows.predicted[rows.toxic == 0]).mean() < 0.05


def test_classes_that_only_long_texts_show(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(160):
        lang = list(SYL)[i % len(SYL)]
        long = lang == list(SYL)[0]
        words = text(rng, lang, 5000 if long else 40).split()
        if long and i % 2 == 0:  # toxic texts are all long
            words = [w if rng.random() < 0.9 else "moron" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(long and i % 2 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, g in rows if g == list(SYL)[0]) > toxicity.TRAIN_CHARS
    found = language_id.identify(df.select("doc_id", "text"), language_id.fit_on(df)).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    model = toxicity.fit_on(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(df, model).toPandas().set_index("doc_id").predicted
    assert all(got[i] == t for i, t in labels)


def test_spread_keeps_both_ends(spark):
    df = spark.createDataFrame([("a" * 50 + "b" * 50,), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(common.spread(F.col("t"), 40, 4)).collect()] == [" ".join(["a" * 10, "a" * 10, "b" * 10, "b" * 10]), "short", None]
