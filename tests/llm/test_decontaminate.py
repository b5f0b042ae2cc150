"""Decontamination: planted copies found, alignment against the textbook recurrence, both look-up ways alike."""

import random

import numpy as np
from pyspark.sql import functions as F

from duskgrid.llm import decontaminate as D


def textbook(item, weight, passage):
    cost = D.PENALTY * weight.mean()
    s = np.zeros((len(passage) + 1, len(item) + 1))
    for j in range(1, len(passage) + 1):
        for i in range(1, len(item) + 1):
            s[j, i] = max(0, s[j - 1, i - 1] + (weight[i - 1] if passage[j - 1] == item[i - 1] else -cost), s[j - 1, i] - cost, s[j, i - 1] - cost)
    return s.max() / weight.sum()


def test_alignment_is_smith_waterman():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
        passage = [rng.choice("abcdefg") for _ in range(rng.randint(1, 25))]
        of = {w: rng.random() + 0.1 for w in "abcdef"}
        weight = np.array([of[w] for w in item])
        score, a, b = D.align(item, weight, passage)
        assert abs(score - textbook(item, weight, passage)) < 1e-9
        if score:  # the span reported holds the alignment
            assert abs(D.align(item, weight, passage[a:b])[0] - score) < 1e-9


def corpus():
    rng = random.Random(8)
    vocab = [f"{rng.choice('bcdfg')}{i}" for i in range(400)]
    common = ["the", "of", "and", "in"]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = {i: words(rng.randint(15, 40)) for i in range(20)}
    docs, planted = {}, set()
    for d in range(240):
        w = words(rng.randint(1, 300))
        kind = d % 6
        if kind < 3:
            i = d % 20 if d < 120 else 3  # one item is in very many documents
            x = list(items[i])
            if kind == 1:
                for _ in range(len(x) // 6):
                    x[rng.randrange(len(x))] = rng.choice(vocab)
            if kind == 2:
                del x[rng.randrange(len(x))]
                x.insert(rng.randrange(len(x)), "of")
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
            planted.add((d, i))
        docs[d] = " ".join(w).capitalize() + "."
    return docs, {i: " ".join(x) for i, x in items.items()}, planted


def test_finds_planted_and_nothing_else(spark):
    docs, items, planted = corpus()
    df = spark.createDataFrame([*((k, v, 0.5, 1) for k, v in docs.items()), (900, None, 0.1, 1), (901, "", 0.1, 1), (None, items[0], 0.1, 1), (902, "a b", 0.1, 1)], "doc_id long, text string, score double, item_id long").repartition(3)
    bench = spark.createDataFrame([*items.items(), (50, None), (51, "a b"), (52, "")], "item_id long, text string")
    got = D.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(902, 51)}
    for r in got:
        if r.doc_id % 6 == 0:
            assert r.score > 0.999 and items[r.item_id] in r.passage
    joined = D.leaks(df, bench, in_memory=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_no_score_above_its_bound():
    rng = random.Random(6)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
        passage = [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]
        of = {w: rng.random() + 0.1 for w in "abcdef"}
        weight = np.array([of[w] for w in item])
        assert D.align(item, weight, passage)[0] <= D.most(item, weight, passage) + 1e-9


def test_finds_edited_copies_alone_and_beside_others(spark):
    item = [f"w{i}" for i in range(42)]
    fill = lambda d: [f"f{d}x{i}" for i in range(30)]
    edit = lambda d, step: [f"e{d}x{i}" if i % step == step - 1 else w for i, w in enumerate(item)]
    doc = lambda d, x: (d, " ".join(fill(d) + x + fill(-d)))
    clean = [doc(d, random.Random(d).sample(item, len(item))) for d in range(100, 400)]  # its words are everyday ones
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    whole = [doc(d, item) for d in range(400, 430)]
    group = [doc(d, edit(0, 5)) for d in range(500, 560)]
    for more in ([], whole, group, whole + group, whole[:1] + group):
        df = spark.createDataFrame([*clean, *more, doc(5, edit(5, 5)), doc(4, edit(4, 4))], "doc_id long, text string")
        for in_memory in (D.SEEDS_IN_MEMORY, 0) if more == whole else (D.SEEDS_IN_MEMORY,):
            assert {r.doc_id for r in D.leaks(df, bench, in_memory=in_memory).collect()} == {4, 5} | {d for d, _ in more}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.leaks(docs.union(docs), bench).count() == 1


def test_repeated_ids(spark):
    item, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    fill = [(d, " ".join(f"f{d}x{i}" for i in range(40))) for d in range(100, 160)]
    docs = spark.createDataFrame([*fill, (1, "long " * 50 + item), (1, "two words"), (1, item[:-4] + " x"), (2, None), (2, other), (3, ""), (3, "a")] * 2, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, item), (7, other), (7, item), (8, item)], "item_id long, text string")
    both = [sorted((r.doc_id, r.item_id, round(r.score, 9), r.passage) for r in D.leaks(docs, bench, in_memory=n).collect()) for n in (D.SEEDS_IN_MEMORY, 0)]
    assert both[0] == both[1]
    assert [(d, i, s > 0.999) for d, i, s, _ in both[0]] == [(1, 7, True), (1, 8, True), (2, 7, True)]


def test_same_as_aligning_all_pairs(spark):
    docs, items, _ = corpus()
    docs = {d: t for d, t in docs.items() if d % 4 == 0}
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    import re

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    holds = {}
    for t in docs.values():
        for w in set(split(t)):
            holds[w] = holds.get(w, 0) + 1
    want = {}
    for i, t in items.items():
        words = split(t)
        weight = np.array([np.log((len(docs) + 1) / (holds.get(w, 0) + 0.5)) + 0.1 for w in words])
        for d, text in docs.items():
            if (score := D.align(words, weight, split(text))[0]) >= D.THRESHOLD:
                want[d, i] = round(score, 6)
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in D.leaks(df, bench).collect()} == want


def phrases():
    """Two items with a phrase of the language in the middle, and documents that use it in ever new surroundings."""
    items = [[f"a{i}" for i in range(12)] + ["once", "upon", "a", "time", "in", "the", "west"] + [f"b{i}" for i in range(12)], [f"c{i}" for i in range(24)]]
    everyday = [(1000 + d, f"x{d} once upon a time in the west y{d}") for d in range(200)]
    return items, everyday


def seeds_of(spark, docs, items, rare):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    grams = D._grams(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), ["item_id"]).drop("around")
    counted = D._count_in_memory(df, grams.select("item_id", "kind", "h"))
    counts = counted.groupBy("kind", "h").agg(F.approx_count_distinct("around").alias("around"), F.sum("n").alias("n")).cache()
    return grams, counts, D.rare_seeds(grams, counts, rare).join(grams.where("kind = 0"), ["item_id", "h"]).collect()


def test_phrases_are_no_seeds_and_copies_do_not_make_any_common(spark):
    items, everyday = phrases()
    copies = [(d, " ".join(items[d % 2])) for d in range(300)] + [(500 + d, " ".join(w if i % 5 else "q" for i, w in enumerate(items[1]))) for d in range(60)]
    _, counts, seeds = seeds_of(spark, everyday + copies, items, 20)
    at = {(r.item_id, r["at"]) for r in seeds}
    assert not at & {(0, p) for p in range(13, 16)}  # wholly inside the phrase, with rare ones in their stretch
    assert {(1, p) for p in range(22)} <= at and {(0, p) for p in (0, 1, 9, 11, 20, 26)} <= at
    assert counts.where("kind = 0 and around > 20").count() == 5  # once upon a, ... in the west


def test_a_stretch_of_common_ngrams_keeps_them(spark):
    items, everyday = phrases()
    _, _, seeds = seeds_of(spark, everyday, [items[0][12:19], items[1]], 20)
    assert {(r.item_id, r["at"]) for r in seeds} == {(0, p) for p in range(5)}  # item 1 occurs nowhere


def test_rare_seeds_find_edited_copies_beside_phrases_both_ways(spark):
    items, everyday = phrases()
    edited = lambda d, x: " ".join(f"e{d}" if i % 6 == d % 6 else w for i, w in enumerate(x))
    planted = [(d, f"before it {edited(d, items[d % 2])} and behind") for d in range(40)] + [(60, " ".join(items[0])), (61, " ".join(items[0]))]
    df = spark.createDataFrame(everyday + planted, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(d, d % 2) for d in range(40)} | {(60, 0), (61, 0)}
    got = [sorted((r.doc_id, r.item_id, round(r.score, 9), r.first, r.passage) for r in D.leaks(df, bench, in_memory=n, rare=k).collect()) for n, k in ((D.SEEDS_IN_MEMORY, 20), (0, 20), (D.SEEDS_IN_MEMORY, 10**9))]
    assert {(d, i) for d, i, *_ in got[0]} == want
    assert got[0] == got[1] and {r[:3] for r in got[0]} == {r[:3] for r in got[2]}


def test_hits_in_turns_give_the_same_passages(spark):
    docs, items, _ = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    grams = D._grams(spark.createDataFrame(list(items.items()), "item_id long, text string"), ["item_id"])
    seeds = grams.where("kind = 0").select("item_id", "h").distinct().withColumn("size", F.lit(20).cast("long")).cache()
    whole, turns = (sorted(map(str, D._search_in_memory(df, seeds, most).collect())) for most in (D.HITS, 50))
    assert whole and whole == turns


def test_very_long_text_and_clashing_columns(spark):
    items, _ = phrases()
    long = " ".join(f"w{i % 997}" for i in range(400_000))
    docs = spark.createDataFrame([(1, f"{long} {' '.join(items[0])} {long}", 5, "u", 7), (2, long, 6, "v", 8)], "doc_id long, text string, item_id int, h string, size long")
    bench = spark.createDataFrame([(3, " ".join(items[0]), 9, "z")], "item_id long, text string, doc_id int, own string")
    (r,) = D.leaks(docs, bench).collect()
    assert (r.doc_id, r.item_id, r.first, r["last"]) == (1, 3, 400_000, 400_000 + len(items[0]))
