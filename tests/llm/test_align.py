"""Cross-tokenizer alignment against brute force over bytes."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from duskgrid.llm import align, encode

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(docs):
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    of = {c: b for b, c in encode._BYTES.items()}
    made, counts = [], Counter()
    for d, text in docs:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        ab = [bytes(of[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(ab) != want or b"".join(bb) != want:
            made.append((d, [], [], [], []))
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(ab), spans(bb)
        links = [(x, y) for x, (p, q) in zip(a, sa) for y, (r, s) in zip(b, sb) if max(p, r) < min(q, s)]
        counts.update(links)
        cuts = sorted({q for _, q in sa} & {s for _, s in sb})
        groups = [([x for x, (_, q) in zip(a, sa) if lo < q <= hi], [y for y, (_, s) in zip(b, sb) if lo < s <= hi]) for lo, hi in zip([0, *cuts[:-1]], cuts)]
        made.append((d, a, b, links, groups))
    top = {}
    for (x, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d, a, b, links, groups in made:
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def texts(rng, n):
    pieces = ["the", "cat's", "house", "élève", "\n", "\n\n", "  ", "12345", "日本", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<0x41>", "tionalization", "...", "\t", "́", " "]
    return [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.choice([1, 3, 20]))) for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "a▁"), (None, "the cat"), (6, "the cat"), (6, "the cat"), (7, " the"), (8, "the "), (9, "x" * 3000), (10, "\x00"), (11, "a\r\nb"), (12, "<|endoftext|> <unk>")]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs = ODD + list(enumerate(texts(rng, 120), 100))
    for rows in (3_000_000, 40):
        monkeypatch.setattr(align, "BLOCK_ROWS", rows)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_a int, block string").repartition(3)
        found = align.align(df, A, B)
        assert found.dtypes == [tuple(f.replace("long", "bigint").split()) for f in align.RESULT.split(", ")]
        assert sorted(map(tuple, found.collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_pieces_are_exact_and_forget(monkeypatch):
    e, rng = align.PieceEncoder(B), random.Random(2)
    assert e.by_words
    e.most = 20
    for _ in range(20):
        own = texts(rng, 30)
        off, ids = e.encode(pa.array(own, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == e.pieces.encode(own)
