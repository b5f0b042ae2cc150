"""Alignment of two tokenizers' tokens over the same text, and which tokens go together in the whole corpus.

Both tokenizations of a text cover the same bytes, so a token is known by where it ends. All steps work on Arrow columns:

1. each batch's token lists are flattened beside their parent indices; token lengths, summed within each document, are
   the places where tokens end;
2. a full outer Acero hash join on (document, end) puts both sides' ends into one table. Ends that both have close a group;
   between two neighbouring ends lies just one overlap of an A and a B token, so every row of the table is one link, and
   its tokens are the next ones of either side;
3. Table.group_by counts links by pair of ids, within documents and within a block of documents; Spark adds the blocks'
   counts up for the corpus and finds the highest of each B id;
4. these numbers go back to each block, pair by pair, and meet the documents' own counts there.

A block is a bounded run of a task's documents (BLOCK_ROWS counts of pairs by document), so a pair that is everywhere is
one row a block, and no key, hot or not, gathers the rows of documents.

A is a byte-level BPE of the tokenizers library over a space and the text; B a sentencepiece model over the text, which
adds that space itself. Special tokens spelled out in a text are plain text. B's words are encoded once each and
remembered, as no piece goes on beyond a word's end (checked when the model is loaded); odd spacing is encoded whole.

Defined results: null and empty texts, and texts whose tokens' bytes differ from space and text on either side (such as
U+2581 in the text, which B takes for a space), have zeros and ''; rows are kept one by one, null and repeated doc_ids too;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm import encode
from duskgrid.llm.common import deleted, list_offsets, new_path, slices, stored, strings, texts_of, trim

#: Bytes of text aligned at a time; counts of pairs by document after which a block ends; blocks of a task at most.
SLICE, BLOCK_ROWS, BLOCKS = 1 << 20, 3_000_000, 1 << 24
#: Segments that either encoder may remember.
SEGMENTS = 250_000
_OWN = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>, a int, b int, code int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_loaded: dict[str, "PieceEncoder"] = {}


class PieceEncoder(encode.Encoder):
    """encode() with a sentencepiece model; words between single spaces are looked up in the cache."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.direct, self.most, self.specials = False, encode.CACHE_SEGMENTS, []
        self.by_words = not any("▁" in n.lstrip("▁") for n in names)
        self.forget()
        probes = ["a b", "the cat's x", "x\ny z", "　a éﬁ", "<s> 1.5"]
        off, ids = self.encode(pa.array(probes, pa.large_string()))
        self.by_words = self.by_words and [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == self._whole(probes)
        self.forget()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, r"^ | $|  |\x{2581}").to_numpy(zero_copy_only=False)
        if not self.by_words:
            odd[:] = True
        parts = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values[off[0] : off[-1]].dictionary_encode()
        entries = self._entries(strings(coded.dictionary))
        ends, flat = self._gathered(entries)
        code = coded.indices.to_numpy()
        ends, ids = encode._picked(ends[:-1][code], np.diff(ends)[code], flat)
        off = ends[off - off[0]].astype(np.int64)
        if not odd.any():
            return off, ids
        own = iter(self._whole(strings(texts.filter(pa.array(odd)))))
        return encode._joined([next(own) if o else ids[a:b].tolist() for o, a, b in zip(odd.tolist(), off[:-1], off[1:], strict=True)])

    def token_bytes(self) -> list[bytes]:
        sp = self.pieces
        return [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for n in (sp.id_to_piece(i),)]


def byte_level(enc: encode.Encoder) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary (its own string for a special token)."""
    of = {c: b for b, c in encode._BYTES.items()}
    n = enc.tokenizer.get_vocab_size(with_added_tokens=True)
    names = [enc.tokenizer.id_to_token(i) or "" for i in range(n)]
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in names]


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    _loaded[path].most = SEGMENTS
    return _loaded[path]


def covers(off: np.ndarray, ids: np.ndarray, table: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether each list of ids spells its text."""
    if not len(ids):
        return np.array([not t for t in texts], bool)
    joined = table.take(pa.array(ids))
    at = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy())])
    data, ends = joined.buffers()[2].to_pybytes(), at[off].tolist()
    return np.fromiter((data[a:b] == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)), bool, len(texts))


def ends_of(lists: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """key (document and the byte at which a token ends), and the token's id under name."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    running = pc.cumulative_sum(lengths.take(ids))
    off = list_offsets(lists)
    before = np.concatenate([[0], running.to_numpy()])[off[:-1]]  # what earlier documents hold
    key = pc.add(pc.multiply(doc, 1 << 32), pc.subtract(running, pa.array(before).take(doc)))
    return pa.table({"key": key, name: ids})


def links_of(a: pa.ListArray, b: pa.ListArray, length_a: pa.Array, length_b: pa.Array) -> pa.Table:
    """doc, a, b, ends_a, ends_b: every link in order, and whether its tokens end with it. Documents cover the same bytes on both sides."""
    met = ends_of(a, length_a, "a").join(ends_of(b, length_b, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    doc = pc.shift_right(met["key"], 32)
    return pa.table({"doc": doc, "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "ends_a": pc.is_valid(met["a"]), "ends_b": pc.is_valid(met["b"])})


def group_digests(links: pa.Table, docs: int) -> tuple[np.ndarray, list[str]]:
    """Of each document how many groups it has, and the SHA-256 of its groups (a1,a2|b1;...), '' without tokens."""
    ends = {x: links[f"ends_{x}"].to_numpy() for x in "ab"}
    common = ends["a"] & ends["b"]
    upto = np.concatenate([[0], np.cumsum(common)])[:-1]  # the group of each row
    sides = []
    for x in "ab":
        own = upto[ends[x]]
        off = np.searchsorted(own, np.arange(common.sum() + 1)).astype(np.int32)
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(off), links[x].filter(links[f"ends_{x}"]).combine_chunks().cast(pa.string())), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    per = np.bincount(links["doc"].to_numpy()[common], minlength=docs)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), groups), ";")
    return per, [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(strings(whole), per.tolist(), strict=True)]


def counted(links: pa.Table, keys: list[str]) -> pa.Table:
    return links.select(keys).group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "n"])


def _lists(off: np.ndarray, ids: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    size = np.where(kept, np.diff(off), 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids[np.repeat(kept, np.diff(off))].astype(np.int32)))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds, by block: a document with its counts by pair (codes, times), or a pair of ids with its code and count."""

    def task(batches):
        enc_a, enc_b = encode.encoder(path_a, SEGMENTS, plain=True), piece_encoder(path_b)
        tables = [pa.array(t, pa.large_binary()) for t in (byte_level(enc_a), enc_b.token_bytes())]
        lengths = [pc.binary_length(t).cast(pa.int64()) for t in tables]
        block, rows, pairs, held = TaskContext.get().partitionId() * BLOCKS, [], [], 0
        for batch in slices(batches, "text", SLICE):
            texts = texts_of(batch, "text")
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            raw = [t if len(t) > 1 else b"" for t in strings(spaced.cast(pa.large_binary()))]
            (off_a, ids_a), (off_b, ids_b) = enc_a.encode(spaced), enc_b.encode(texts)
            kept = np.array([bool(t) for t in raw], bool)
            kept &= covers(off_a, ids_a, tables[0], raw) & covers(off_b, ids_b, tables[1], raw)
            a, b = _lists(off_a, ids_a, kept), _lists(off_b, ids_b, kept)
            links = links_of(a, b, *lengths)
            n_groups, digests = group_digests(links, len(kept))
            own = counted(links, ["doc", "a", "b"]).sort_by("doc").combine_chunks()
            pairs.append(counted(links, ["a", "b"]))
            numbers = [np.diff(list_offsets(a)), np.diff(list_offsets(b)), n_groups, np.bincount(links["doc"].to_numpy(), minlength=len(kept))]
            rows.append((batch.column("doc_id"), numbers, digests, own))
            held += own.num_rows
            if held >= BLOCK_ROWS:
                yield from _block(block, rows, pairs)
                block, rows, pairs, held = block + 1, [], [], 0
        if rows:
            yield from _block(block, rows, pairs)
        enc_a.forget()
        enc_b.forget()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, _OWN)


def _block(block: int, rows: list, pairs: list):
    """A block's rows: its pairs, numbered, and its documents, whose pairs are given by these numbers."""
    total = pa.concat_tables(pairs).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    one = lambda t: t["a"].to_numpy().astype(np.int64) << 32 | t["b"].to_numpy()
    key = one(total)
    order = np.argsort(key, kind="stable")
    key, total = key[order], total.take(pa.array(order))
    yield from _full(pa.table({"block": np.full(len(key), block), "a": total["a"], "b": total["b"], "code": pa.array(np.arange(len(key), dtype=np.int32)), "n": total["n_sum"]}))
    for doc_id, numbers, digests, own in rows:
        off = pa.array(np.searchsorted(own["doc"].to_numpy(), np.arange(len(doc_id) + 1)).astype(np.int32))
        codes = pa.ListArray.from_arrays(off, pa.array(np.searchsorted(key, one(own)).astype(np.int32)))
        times = pa.ListArray.from_arrays(off, own["n"].combine_chunks().cast(pa.int32()))
        yield from _full(pa.table({"block": np.full(len(doc_id), block), "doc_id": doc_id, **{c: pa.array(x.astype(np.int64)) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)}, "groups_sha256": digests, "codes": codes, "times": times}))


def _full(part: pa.Table) -> list[pa.RecordBatch]:
    """part with all columns of _OWN, null where it has none."""
    kinds = {"groups_sha256": pa.string(), "codes": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "a": pa.int32(), "b": pa.int32(), "code": pa.int32()}
    names = [f.split()[0] for f in _OWN.split(", ")]
    return pa.table({n: part[n] if n in part.column_names else pa.nulls(part.num_rows, kinds.get(n, pa.int64())) for n in names}).to_batches(max_chunksize=100_000)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """RESULT for every document: how its two tokenizations meet, and how its links fare among those of all documents."""
    at = new_path(docs.sparkSession, "aligned")
    both = stored(aligned(docs, path_a, path_b), "aligned", 2000, at)
    pairs = both.where("a is not null").select("block", "a", "b", "code", "n")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # a B id has at most as many pairs as A has ids
    ranked = totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))
    back = pairs.select("block", "a", "b", "code").join(ranked, ["a", "b"]).select("block", "code", "total", "best")
    own = both.where("a is null").select(F.col("block").alias("own_block"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = (np.zeros(right.num_rows, np.int64) for _ in range(2))
        code = right["code"].to_numpy()
        total[code], best[code] = right["total"].to_numpy(), right["best"].to_numpy()
        codes, times = (left[c].combine_chunks() for c in ("codes", "times"))
        codes, times = (c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in (codes, times))
        off = list_offsets(codes) if left.num_rows else np.zeros(1, np.int64)
        code, n = (x.flatten().to_numpy().astype(np.int64) if left.num_rows else np.zeros(0, np.int64) for x in (codes, times))
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
        return pa.table({**{c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": upto(n * best[code]), "count_sum": upto(n * total[code]), "groups_sha256": left["groups_sha256"]})

    out = stored(own.groupBy("own_block").cogroup(back.groupBy("block")).applyInArrow(lambda a, b: met(a, b), RESULT), "alignment", 2000)
    deleted(docs.sparkSession, [at])
    return out
