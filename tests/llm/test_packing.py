"""Packing: nothing lost, nothing overlapping, few sequences."""

import numpy as np
import public_tokenizers
import pytest

from duskgrid.llm import packing
from duskgrid.llm.encode import encoder


def places(p, counts):
    out = []
    for x in np.flatnonzero(counts):
        at = np.flatnonzero(p.length == x)
        for r in range(counts[x]):
            i = at[np.searchsorted(p.rank[at], r, "right") - 1]
            out.append((int(p.seq[i] + (r - p.rank[i]) // p.each[i]), int(p.offset[i] + (r - p.rank[i]) % p.each[i] * x), int(x)))
    return sorted(out)


def gapless(found, capacity, sequences):
    upto = {}
    for s, o, x in found:
        assert o == upto.get(s, 0)
        upto[s] = o + x
    assert sorted(upto) == list(range(sequences)) and all(v <= capacity for v in upto.values())


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_whole(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(1, 90))
    counts = np.zeros(cap + 1, np.int64)
    counts[1:] = rng.integers(0, 12, cap) * (rng.random(cap) < 0.5)
    p = packing.plan(counts, cap)
    found = places(p, counts)
    assert len(found) == counts.sum()
    gapless(found, cap, p.sequences)


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 4096), minlength=4097)
    p = packing.plan(counts, 4096)
    assert p.sequences <= 1.003 * (counts * np.arange(4097)).sum() / 4096 + 1
    halves = np.zeros(101, np.int64)
    halves[[60, 40]] = 7
    assert packing.plan(halves, 100).sequences == 7


def test_query_is_tight(spark):
    from duskgrid.llm import queries

    rows = queries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    found = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    used = len({f[0] for f in found})
    gapless([(sorted({f[0] for f in found}).index(s), o, x) for s, o, x in found], 4096, used)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_pack(spark):
    texts = {1: None, 2: "", 3: "the cat", 4: "dog " * 300, 5: "some words here " * 40, None: "x"}
    df = spark.createDataFrame([(k, t, 9, "c") for k, t in [*texts.items(), (3, "the cat")]], "doc_id long, text string, rank int, offset string").repartition(3)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=64).collect()
    e = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for k, t in texts.items():
        ids = e.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r.piece, r.start, r.ids) for r in got if r.doc_id == k)
        if k == 3:
            assert len(mine) == 2
            mine = mine[:1]
        assert [i for m in mine for i in m[2]] == ids and [m[1] for m in mine] == list(range(0, len(ids), 64))
    found = sorted((r.sequence_id, r.offset, r.length) for r in got)
    gapless(found, 64, len({f[0] for f in found}))
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), capacity=64).count() == 0
