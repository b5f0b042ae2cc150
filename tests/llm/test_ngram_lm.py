"""Elias-Fano sequences, tries and the language model against plain recomputation."""

import math
import mmap
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskgrid.llm import ngram_lm, queries
from duskgrid.llm.elias_fano import EliasFano, packed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("seed", range(12))
def test_sequences(seed):
    rng = np.random.default_rng(seed)
    n, most = int(rng.integers(0, 3000)), int(10 ** rng.uniform(0, 12))
    values = np.sort(rng.integers(0, most + 1, n))
    if seed % 3 == 0:
        values = np.repeat(values, 5)
    whole = EliasFano.of(values)
    data = b"\0" * 16 + packed(whole.parts())
    ef, end = EliasFano.mapped(data, 16)
    assert end == len(data)
    assert ef.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.concatenate([values[:200], values[:200] + 1, rng.integers(0, 2 * most + 2, 300), [0]])
    assert ef.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    if n > 1000:
        assert sum(p.nbytes for p in ef.parts()) * 8 < len(values) * (2 + max(0, math.log2(most / len(values))) + 2) + 1000


def test_trie_maps_from_a_file(tmp_path):
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 60, (900, 2)) * [7, 1], axis=0)
    count, total = rng.integers(1, 9, len(pairs)), pairs[:, 0] * 3 + 20
    unigram = ngram_lm.quantised(1 / (2.0 + pairs[:, 1]))
    made = ngram_lm.Trie.of(pairs[:, 0], pairs[:, 1], count, total, unigram)
    (tmp_path / "trie").write_bytes(made.tobytes())
    with (tmp_path / "trie").open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        trie = ngram_lm.Trie.mapped(m)
        asked = rng.integers(0, 430, (3000, 2)) % [430, 65]
        own = ngram_lm.quantised(1 / (2.0 + asked[:, 1]))
        got = trie.lookup(asked[:, 0], asked[:, 1], own)
        known = {tuple(p): int(ngram_lm.quantised(np.array([(c + ngram_lm.MU * 10 ** (-ngram_lm.STEP * int(u))) / (t + ngram_lm.MU)]))[0]) for p, c, t, u in zip(pairs.tolist(), count, total, unigram)}
        back = {int(p): int(ngram_lm.quantised(np.array([ngram_lm.MU / (t + ngram_lm.MU)]))[0]) for p, t in zip(pairs[:, 0], total)}
        assert got.tolist() == [known.get((v, w), int(u) + back.get(v, 0)) for (v, w), u in zip(asked.tolist(), own)]
        del trie


def brute(docs):
    """doc_id, held_out, n_tokens, n_known, N, base, the unquantised model's score."""
    tokens = [WORD.findall((t or "").translate(FOLD)) + [None] for _, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    one, two, of = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip(["<s>", *t], t))
            of.update(["<s>", *t[:-1]])
    total, words = sum(one.values()), len(one)
    out = []
    for (d, _), t, h in zip(docs, tokens, held):
        p = lambda w: (one[w] + 1) / (total + words + 1)
        base = sum(math.log10(p(w)) for w in t)
        model = sum(math.log10((two[v, w] + ngram_lm.MU * p(w)) / (of[v] + ngram_lm.MU)) for v, w in zip(["<s>", *t], t))
        out.append((d, h, len(t), sum(one[w] > 0 for w in t), total, base, model))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: str(r[:5])) for x in (got, want))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) <= ngram_lm.STEP * 2 * w[2]


@pytest.mark.parametrize(("block", "shard"), [(2_000_000, 2_000_000), (60, 50)])
def test_equals_recomputation(spark, monkeypatch, block, shard):
    rng = random.Random(block)
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_lm, "CHUNK_DOCS", 3)
    words = [f"W{i}" for i in range(30)] + ["É", "a,", "\x00"]
    text = lambda n: rng.choice([" ", "\n", "\t ", "\x0b"]).join(words[min(32, int(rng.expovariate(0.3)))] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(150)] + [(None, "W1 W2"), (3, None), (3, " "), (200, "the " * 500), (201, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, 1, "x", True) for d, t in docs], "doc_id long, text string, block int, word string, held boolean").repartition(3)
    found = ngram_lm.score(df, queries.lm_trains(F.col("doc_id")))
    assert found.columns == [f.split()[0] for f in ngram_lm.RESULT.split(", ")]
    first = sorted(map(tuple, found.collect()), key=str)
    same(first, brute(docs))
    again = ngram_lm.score(df.repartition(5), queries.lm_trains(F.col("doc_id")))
    assert sorted((r.doc_id or 0, r.n_tokens, r.score) for r in again.collect()) == sorted((r[0] or 0, r[2], r[6]) for r in first)


def test_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_lm.score(df([]), F.lit(True)).collect() == []
    got = ngram_lm.score(df([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def test_model_beats_the_base_on_held_out_texts(spark):
    got = queries.op11_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out & (got.n_tokens > 50)]
    assert len(held) > 100 and (held.score > held.base_score).mean() > 0.9
