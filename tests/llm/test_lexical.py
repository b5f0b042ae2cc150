"""Ranked search against brute force, on small and odd tables."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from duskgrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, k=20):
    terms = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    total, length = len(terms), sum(sum(c.values()) for _, c in terms)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(FOLD))
        rows = []
        for d, c in terms:
            m = 75 + (25 * sum(c.values()) * total) // length
            s = 0
            for t in asked:
                if t in c:
                    df = sum(t in x for _, x in terms)
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                rows.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=20):
    found = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("seed", "leaf", "tree"), [(1, 6, 20_000), (2, 1, 40), (3, 2, 20_000)])
def test_equals_brute_force(spark, monkeypatch, seed, leaf, tree):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "TREE_DOCS", tree)
    monkeypatch.setattr(lexical, "BATCH", 3)
    words = [f"w{i}" for i in range(40)] + ["É", "straße", "x9"]
    text = lambda n: " ".join(words[min(len(words) - 1, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 12, 40, 200]))) for i in range(150)]
    docs += [(i, docs[5][1]) for i in range(200, 240)]  # copies tie
    items = [(i, text(rng.choice([1, 4, 15]))) for i in range(12)]
    assert searched(spark, docs, items, 7) == brute(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..!"), (None, "apple pie"), (4, "Apple-pie APPLE"), (4, "apple pie"), (5, "pie " * 30_000), (6, "x" * 100_000)]
    items = [(1, "apple"), (1, "pie"), (2, None), (3, "?"), (None, "PIE apple apple"), (9, "nowhere")]
    assert searched(spark, docs, items) == brute(docs, [x for x in items if x[1]])
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_clashing_columns_and_item_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "b", 5, 6, 7)], DOCS + ", n long, terms long, score long")
    items = spark.createDataFrame([(1, "a", 0), (2, "b b", 0), (3, "a b", 0)], ITEMS + ", rank int")
    whole = sorted(map(tuple, lexical.search(docs, items).collect()))
    monkeypatch.setattr(lexical, "ITEM_ROWS", 1)
    assert sorted(map(tuple, lexical.search(docs, items).collect())) == whole == brute([(1, "a b"), (2, "b")], [(1, "a"), (2, "b b"), (3, "a b")])


def test_terms():
    off, code, distinct = lexical.terms_of(pa.array(["", "\u00c9\x7f\u00c0!a_B\u00a0c", " . ", "9Z"], pa.large_string()))
    assert off.tolist() == [0, 0, 4, 4, 5]
    assert distinct.take(pa.array(code)).to_pylist() == ["\u00c9", "\u00c0", "a", "b\u00a0c", "9z"]


def test_leaves_out_what_cannot_win(monkeypatch):
    """Documents without the item's rare terms are not scored one by one."""
    import numpy as np

    looked = []
    plain = lexical.scored
    monkeypatch.setattr(lexical, "scored", lambda w, rows, ptr, *a: looked.append(len(rows)) or plain(w, rows, ptr, *a))
    n = 4000
    term = np.stack([np.arange(n) // 200, 100 + np.arange(n) // 20, 1000 + np.arange(n)], axis=1).ravel()
    tree = lexical.grow(np.arange(n), np.full(n, 100), np.arange(0, 3 * n + 1, 3), term, np.ones(3 * n, np.int64))
    weight = np.zeros(1000 + n, np.int64)
    weight[[3, 3 * 10 + 100, 1000 + 610]] = 10, 100, 1000
    ids, points = lexical.best(tree, weight, 1)
    assert ids.tolist() == [610] and sum(looked) < n / 5
