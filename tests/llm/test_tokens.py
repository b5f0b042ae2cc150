"""The exact encoder and the token store, against the library on whole texts."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskgrid.llm import common, encode, token_store

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = ["a", "B", "é", " ", "\n", "\t", "'s", "1", ".", "　", "<|endoftext|>", "\r", "\x0b", "́", "Σ", "\x1c", "\x85", "ñ", "ß,", "İ", "ﬁ", "word", "  "]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6))
def test_encoder_is_exact(name, texts):
    e = encode.encoder(public_tokenizers.path(name))
    off, ids = e.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


#: Code points whose normal or lower-case form ends in a combining mark, as far as they are letters.
MARKED = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LN" and unicodedata.category(unicodedata.normalize("NFC", chr(c)).lower()[-1])[0] == "M"]


def exact(e, texts):
    off, ids = e.encode(pa.array(texts, pa.large_string()))
    own = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [t for t, a, b, x in zip(texts, off[:-1], off[1:], own, strict=True) if ids[a:b].tolist() != x] == []


@pytest.mark.parametrize("name", NAMES)
def test_encoder_is_exact_before_marks(name):
    assert {"\u0130", "\u0958", "\u09dc", "\u0a33", "\u0b5c"} < set(MARKED) and len(MARKED) >= 60
    e = encode.encoder(public_tokenizers.path(name))
    assert exact(e, [f"{before}{c}{marks}{after}" for c in MARKED for marks in (*".,;:!?", "?!", "...") for before in ("", "GELD") for after in ("", " x")])


@pytest.mark.parametrize("name", NAMES)
def test_encoder_is_exact_for_every_code_point(name):
    e = encode.encoder(public_tokenizers.path(name))
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for i in range(0, len(points), 10_000):
        assert exact(e, [t for c in points[i : i + 10_000] for t in (f"{c}.", f"ab{c}, c", f"x{c}1!? {c}")])
        e.forget()


@pytest.mark.parametrize("name", NAMES)
def test_specials_as_plain_text(name):
    e = encode.encoder(public_tokenizers.path(name), plain=True)
    assert e.tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids != encode.encoder(public_tokenizers.path(name)).tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert exact(e, ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>. y"])


@pytest.mark.parametrize("name", NAMES)
def test_encoder_forgets_and_stays_exact(name, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_SEGMENTS", 50)
    e, rng = encode.Encoder(public_tokenizers.path(name)), random.Random(1)
    assert e.direct and e.mode != "whole"
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(20)) for _ in range(3)]
        off, ids = e.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store_round_trip(spark, tmp_path, encoding):
    rng = random.Random(3)
    texts = {i: rng.choice([None, "", "The cat's  sat.\n\nOn é", "x " * rng.randint(1, 3000)]) for i in range(0, 300, 3)}
    rows = [(i, t, 0, "clash") for i, t in texts.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, ids string").repartition(5)
    path = token_store.write_token_store(df, f"file://{tmp_path}/store", public_tokenizers.path(NAMES[0]), 2, encoding)
    t, at = encode.encoder(public_tokenizers.path(NAMES[0])).tokenizer, 0
    got = token_store.read_token_store(spark, path).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        at += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in common.ids_crc32(token_store.read_token_store(spark, path)).collect()}
    assert crc == {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    import pyarrow.parquet as pq

    files = list((tmp_path / "store").glob("*.parquet"))
    kinds = {e for f in files for e in pq.ParquetFile(f).metadata.row_group(0).column(4).encodings if pq.ParquetFile(f).metadata.num_row_groups}
    assert ("DELTA_BINARY_PACKED" in kinds) == (encoding == "delta")
    assert pq.ParquetFile(files[0]).metadata.row_group(0).column(4).has_offset_index


def test_store_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (5, None)], "doc_id long, text string")
    p = token_store.write_token_store(df, f"file://{tmp_path}/odd", public_tokenizers.path(NAMES[0]), 2)
    got = token_store.read_token_store(spark, p).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5] and [r.start for r in got][-1] == sum(r.n_tokens for r in got[:-1])
    p = token_store.write_token_store(df.limit(0), f"file://{tmp_path}/none", public_tokenizers.path(NAMES[0]), 2)
    assert token_store.read_token_store(spark, p).count() == 0
