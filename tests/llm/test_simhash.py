"""SimHash classes against a brute-force version, and the cases that inputs hold now and then."""

import random
import re

import numpy as np
import xxhash

from duskgrid.llm import simhash


def brute(texts, k=4, radius=4):
    fps = {}
    for d, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        g = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        fps[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    root = {d: d for d in fps}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", top(d)) for d in ids}


def rows(df):
    return {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in df.collect()}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["Aa", "b", "É", "dd", "e.", "foo", " x", "zz9"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 12, 60]))) for i in range(150)}
    for i in range(150, 260):
        w = texts[rng.randrange(150)].split(" ")
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = "\n".join(w) + rng.choice(["", " ", "\t\x0b"])
    texts[260] = None
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in texts.items()], "doc_id long, text string, fp string, node string")
    assert rows(simhash.near_duplicates(df)) == brute(texts)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, None), (3, ""), (3, ""), (9, "long " * 60000)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == [(3, 3), (3, 3), (7, 3), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)) for _ in range(8)]]))
    rows_ = [(i, int(f).to_bytes(8, "big"), 0) for i, f in enumerate(fps.tolist())]
    df = spark.createDataFrame(rows_, "node long, fp binary, n long")
    from duskgrid.llm.components import components

    links = simhash.near_links(df, 2, tile=16)
    root = {r.node: r.root for r in components(links).collect()}
    want = {i: i for i in range(len(fps))}
    changed = True
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    lab = np.arange(len(fps))
    while changed:
        new = np.where(near, lab[None], len(fps)).min(axis=1)
        changed = (new != lab).any()
        lab = new
    assert {i: root.get(i, i) for i in want} == dict(enumerate(lab.tolist()))


def test_wide_words(spark):
    a = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, a), (2, a.replace("w150", "x")), (3, a.replace("w", "v"))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, words=8, radius=80).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_first_copies_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 20, 60, 200]))) for _ in range(120)]
    for _ in range(200):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.choice([0, 1, 1, 3])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w += [rng.choice(vocab) for _ in range(rng.randint(1, 80))]
        texts.append(" ".join(w))
    rows_ = [(None if i % 23 == 0 else i // 2, t if i % 50 else None, [i], i) for i, t in enumerate(texts)]
    rows_ += rows_[40:60]  # equal rows
    schema = "doc_id long, text string, fp array<int>, n long"
    df = spark.createDataFrame(rows_, schema).repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.first_copies(df, 5, 84, 8, 0.8, tile=16).collect()]
    sets = []
    for _, t, *_ in rows_:
        w = (t or "").lower().split()
        sets.append(sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))} if w else set()))
    from duskgrid.llm.common import splitmix

    prints = []
    for h in sets:
        h = np.array(h, np.uint64)
        prints.append([simhash.majority_bits(h if k == 0 else splitmix(h, k), np.zeros(len(h), int), 1)[0] for k in range(8)])
    prints, sizes = np.array(prints, np.uint64), np.array([len(s) for s in sets])
    near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= 84) & (np.minimum(sizes[:, None], sizes[None]) >= 0.8 * np.maximum(sizes[:, None], sizes[None]) - 1e-9)
    lab = np.arange(len(sets))
    while ((new := np.where(near, lab[None], len(sets)).min(axis=1)) != lab).any():
        lab = new
    marks = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {r[1] for r in rows_}], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    want = [min(((d is None, d or 0, marks[t]), (d, t)) for (d, t, *_), k in zip(rows_, lab, strict=True) if k == c)[1] for c in set(lab.tolist())]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) < 200
    assert simhash.first_copies(df.limit(0), 5, 84, 8, 0.8).count() == 0
