"""A smoothed bigram language model in Elias-Fano tries, and the log probability of every text under it.

The model: p(w) = (c(w) + 1) / (N + V + 1), p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU). Tokens are the words between ASCII
white space, A-Z lower-cased, and an end; a text begins in a context of its own.

A trie has two levels. The upper holds contexts v with their back-off weights MU / (c(v) + MU), the lower their successors
w with log p(w | v). Context ids, pointers to the successors' ranges and the successors themselves (each range lifted by
the last value before it, so that all are one rising sequence) are Elias-Fano coded; logarithms are quantised in steps of
1 / 2048 of a decimal digit, 16 bits each. A bigram is found by successor search for the context, then within its range;
what isn't found backs off. Levels are flat arrays, mapped from bytes.

At scale a trie is a shard: bigrams are dealt by a hash of the context, that of frequent contexts (known by c(v)) by the
successor too, so no shard depends on one word. In Spark's terms:

1. a block is a bounded run of a task's documents: its distinct words with training counts, and its texts as numbers of
   these words, packed;
2. words meet by a shuffle, are counted and numbered, and numbers and counts go back to the blocks, a row a word and block;
3. there each document's base score follows, and the block's distinct bigrams with counts, and the documents that hold them,
   go to their shards;
4. each shard builds its trie from all blocks' training counts, looks every block's bigrams up in it, and answers with a sum
   by document, in whole steps, so that sums don't depend on their order;
5. the answers meet by block.

Order 2 is a choice: an n-gram of three words needs the probability of its last two first, which is a second way there and
back of all n-grams, beyond the disk that the check tool grants.

Defined results: null text counts as empty, which is the end alone; a null doc_id is not held out and trains; rows are kept
one by one, repeated ids too; an empty table gives an empty result; without training rows N is 0 and every token has the
base 1 / 1; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import deleted, freed, new_path, slices, splitmix, stored, texts_of, trim
from duskgrid.llm.elias_fano import EliasFano, packed
from duskgrid.llm.words import byte_words, ragged

#: What the unigram distribution counts for, in tokens of a context; chosen on held-out text, 100 to 4000 do about as well.
MU = 500.0
#: A step of quantised logarithms.
STEP = 1 / 2048
#: Tokens of a block, tokens of a shard, documents in a row of a block, and blocks of a task at most.
BLOCK_TOKENS, SHARD_TOKENS, CHUNK_DOCS, BLOCKS = 4_500_000, 2_000_000, 2_000, 1 << 24
#: A-Z in lower case, every other byte as it is.
_LOWER = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The end, as a word that no text holds.
END = ""
_BLOCKS = "block long, word string, code int, n long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary"
_NUMBERS = "block long, code int, part long, place long, c long, fresh boolean, is_end boolean"
_DEALT = "shard long, block long, grams binary, first int, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"
_ANSWERS = "block long, places array<int>, sums array<long>, first int, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) / STEP), 65535).astype(np.uint16)


@dataclass
class Trie:
    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    backoff: np.ndarray
    prob: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray, total: np.ndarray, unigram: np.ndarray) -> "Trie":
        """From distinct bigrams in order of context and successor; total is c(v) and unigram the quantised p(w) of each."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        size = np.diff(np.append(first, len(context)))
        last = successor[np.append(first[1:], len(context)) - 1] + 1 if len(first) else np.zeros(0, np.int64)
        lift = np.concatenate([[0], np.cumsum(last)])[:-1] if len(first) else last
        prob = (count + MU * 10 ** (-STEP * unigram.astype(float))) / (total + MU)
        return cls(EliasFano.of(context[first]), EliasFano.of(np.append(first, len(context))), EliasFano.of(successor + 1 + np.repeat(lift, size)), quantised(MU / (total[first] + MU)), quantised(prob))

    def tobytes(self) -> bytes:
        return packed([*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.backoff, self.prob])

    @classmethod
    def mapped(cls, buffer) -> "Trie":
        """The trie that buffer (bytes, an Arrow buffer or a memory-mapped file) holds, without a copy."""
        levels, at = [], 0
        for _ in range(3):
            level, at = EliasFano.mapped(buffer, at)
            levels.append(level)
        backoff = np.frombuffer(buffer, np.uint16, levels[0].n, at)
        return cls(*levels, backoff, np.frombuffer(buffer, np.uint16, levels[2].n, at + -(-backoff.nbytes // 8) * 8))

    def lookup(self, context: np.ndarray, successor: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """-log10 p(w | v) of each bigram, in steps."""
        out = unigram.astype(np.int64)
        if not self.contexts.n or not len(context):
            return out
        first = np.flatnonzero(np.diff(context, prepend=-1))  # runs of a context, one each where they are in order
        own, inverse = context[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        at = self.contexts.successor(own)
        held = np.flatnonzero(at < self.contexts.n)
        held = held[self.contexts.access(at[held]) == own[held]]
        low, high, lift, back = (np.full(len(own), x, np.int64) for x in (0, -1, 0, 0))
        low[held], high[held], back[held] = self.pointers.access(at[held]), self.pointers.access(at[held] + 1), self.backoff[at[held]]
        inner = held[low[held] > 0]
        lift[inner] = self.successors.access(low[inner] - 1)
        out += back[inverse]
        asked = np.flatnonzero(high[inverse] > 0)
        c = inverse[asked]
        x = successor[asked] + 1 + lift[c]
        place = self.successors.successor(x)
        inside = np.flatnonzero(place < high[c])
        inside = inside[self.successors.access(place[inside]) == x[inside]]
        out[asked[inside]] = self.prob[place[inside]]
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed together: of each first all lowest bytes, then all second ones, as these are alike."""
    raw = b"".join(np.int64(len(a)).tobytes() + np.int64(a.dtype.itemsize).tobytes() + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, item = np.frombuffer(raw, np.int64, 2, at)
        planes = np.frombuffer(raw, np.uint8, int(n * item), at + 16).reshape(int(item), int(n))
        out.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[int(item)]).reshape(int(n)))
        at += 16 + int(n * item)
    return out


def _table(schema: str, rows: int, **columns) -> pa.Table:
    """columns, and null for what else the schema has."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) if isinstance(columns.get(n), list) else columns[n].cast(kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields})


def blocks(docs: DataFrame, trains: Column) -> DataFrame:
    """_BLOCKS: the distinct words of each block with their training counts, and its documents, as numbers of these words."""

    def block(number: int, parts: list, index: dict[str, int]):
        words = [END, *index]
        code = np.concatenate([c for *_, c in parts])
        size = np.concatenate([n for *_, n, _ in parts])
        held = np.concatenate([h for _, h, *_ in parts])
        ids = pa.concat_arrays([d for d, *_ in parts])
        used = np.bincount(code, minlength=len(words))
        order = np.argsort(-used, kind="stable")  # frequent words get small numbers, which pack well
        new = np.empty(len(words), np.int64)
        new[order] = np.arange(len(words))
        code = new[code].astype(np.int32)
        trained = np.bincount(code[np.repeat(~held, size)], minlength=len(words))
        yield from _table(_BLOCKS, len(words), block=pa.array(np.full(len(words), number)), word=pa.array([words[i] for i in order.tolist()]), code=pa.array(np.arange(len(words))), n=pa.array(trained)).to_batches(max_chunksize=50_000)
        upto = np.concatenate([[0], np.cumsum(size)])
        for a in range(0, len(size), CHUNK_DOCS):
            b = min(a + CHUNK_DOCS, len(size))
            yield from _table(_BLOCKS, 1, block=[number], code=[a], doc_ids=[ids[a:b].to_pylist()], held=[held[a:b].tolist()], sizes=[size[a:b].tolist()], tokens=[_pack(code[upto[a] : upto[b]])]).to_batches()

    def task(batches):
        number, parts, index, seen = TaskContext.get().partitionId() * BLOCKS, [], {}, 0
        for b in slices(batches, "text", 2 << 20):
            off, code, distinct = byte_words(texts_of(b, "text"), _LOWER)
            own = np.fromiter((index.setdefault(w, len(index) + 1) for w in distinct.to_pylist()), np.int64, len(distinct))
            size = np.diff(off) + 1
            whole = np.zeros(int(size.sum()), np.int64)  # number 0 is the end
            last = np.zeros(len(whole), bool)
            last[np.cumsum(size) - 1] = True
            whole[~last] = own[code]
            held = ~pc.fill_null(b.column("trains"), True).to_numpy(zero_copy_only=False).astype(bool)
            parts.append((b.column("doc_id"), held, size.astype(np.int64), whole.astype(np.int32)))
            seen += len(whole)
            if seen >= BLOCK_TOKENS:
                yield from block(number, parts, index)
                number, parts, index, seen = number + 1, [], {}, 0
        if parts:
            yield from block(number, parts, index)
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), trains.alias("trains"))
    return rows.mapInArrow(task, _BLOCKS)


def numbered(words: DataFrame) -> DataFrame:
    """_NUMBERS for each row (block, word, code, n): the word's number in its part and its count over all blocks.

    One shuffle, by word, in which a word is a row a block, so none is hot.
    """

    def task(batches):
        part, done, last = TaskContext.get().partitionId(), -1, None
        for b in batches:
            word = b.column("word")
            fresh = np.ones(len(word), bool)
            fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = word[0].as_py() != last
            last = word[-1].as_py()
            place = done + np.cumsum(fresh)
            done = int(place[-1])
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("code"), pa.array(np.full(len(word), part, np.int64)), pa.array(place), b.column("c"), pa.array(fresh), pc.equal(word, END)], names=[f.split(" ")[0] for f in _NUMBERS.split(", ")])

    counted = words.withColumn("c", F.sum("n").over(Window.partitionBy("word"))).select("block", "word", "code", "c")
    return stored(counted.mapInArrow(task, _NUMBERS), "numbers", 10_000)


def shard_of(context: np.ndarray, successor: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    """Where a bigram belongs: contexts with more tokens than a quarter of a shard's are dealt by the successor too."""
    salts = 1 + total // max(1, SHARD_TOKENS // 4)
    own = splitmix(successor, 1) % salts.astype(np.uint64)
    return (splitmix(splitmix(context) + own, 2) % np.uint64(shards)).astype(np.int64)


def dealt(of_block: DataFrame, numbers: DataFrame, tokens: int, words: int, starts: int, shards: int) -> DataFrame:
    """_DEALT: by block, its documents with base scores, and for each shard the block's bigrams that belong there.

    tokens is N, words V, starts how many training documents there are.
    """

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_DEALT, 0)
        left = left.sort_by("first")
        number, c = (np.zeros(right.num_rows, np.int64) for _ in range(2))
        at = right["of_code"].to_numpy()
        number[at], c[at] = right["id"].to_numpy(), right["c"].to_numpy()
        p = (c + 1) / (tokens + words + 1)
        log, unigram = np.log10(p), quantised(p)
        block, out, sizes, codes, held = left["own_block"][0].as_py(), [], [], [], []
        own_shard = int(splitmix(np.array([block]), 3)[0] % np.uint64(shards))
        for row in left.to_batches(max_chunksize=1):
            size, (code,) = row.column("sizes").flatten().to_numpy(), _unpack(row.column("tokens")[0].as_py())
            doc = np.repeat(np.arange(len(size)), size)
            known, base = (np.bincount(doc, weights=x[code], minlength=len(size)) for x in ((c > 0).astype(float), log))
            out.append(_table(_DEALT, 1, shard=[own_shard], block=[block], first=row.column("first"), doc_ids=row.column("doc_ids"), held=row.column("held"), n_tokens=[size.astype(np.int64).tolist()], n_known=[known.astype(np.int64).tolist()], base=[base.tolist()]))
            sizes.append(size)
            codes.append(code)
            held.append(row.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool))
        size, code, held = (np.concatenate(x) for x in (sizes, codes, held))
        del sizes, codes
        key = np.empty(len(code), np.int64)  # the word before (0: the start, n: word n - 1) and the word
        key[1:] = code[:-1] + 1
        key[np.cumsum(size) - size] = 0
        key = key << 32 | code
        order = np.argsort(key, kind="stable")
        key = key[order]
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        del order, code
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        v, w = (key[cuts] >> 32).astype(np.int32), (key[cuts] & 0xFFFFFFFF).astype(np.int32)
        times = np.diff(np.append(cuts, len(key))).astype(np.int32)
        del key
        trained = np.add.reduceat((~held)[doc].astype(np.int32), cuts)
        context, total = np.append(0, number)[v], np.append(starts, c)[v]
        del v
        shard = shard_of(context, number[w], total, shards).astype(np.int32)
        turn = np.lexsort((number[w], context, shard))
        docs_in, upto = doc[ragged(cuts[turn], times[turn])], np.concatenate([[0], np.cumsum(times[turn])])
        del doc, cuts
        bounds = np.flatnonzero(np.diff(shard[turn], prepend=-1))
        for a, b in zip(bounds, np.append(bounds[1:], len(turn)), strict=True):
            t = turn[a:b]
            first = np.flatnonzero(np.diff(context[t], prepend=-1))
            many = np.diff(np.append(first, len(t))).astype(np.int32)
            grams = _pack(np.diff(context[t][first], prepend=0), total[t][first], many, number[w[t]], unigram[w[t]], trained[t], times[t], docs_in[upto[a] : upto[b]])
            out.append(_table(_DEALT, 1, shard=[int(shard[t[0]])], block=[block], grams=[grams]))
        del docs_in, turn, context, total, shard, w, times, trained
        trim()
        return pa.concat_tables(out)

    return of_block.groupBy("own_block").cogroup(numbers.groupBy("block")).applyInArrow(lambda a, b: met(a, b), _DEALT)


def answered(sent: DataFrame) -> DataFrame:
    """_ANSWERS: each shard's trie built and asked; a sum of steps for every document that has bigrams in it."""

    def asked(rows: pa.Table) -> pa.Table:
        out = [rows.filter(pc.is_null(rows["grams"])).select([f.split(" ")[0] for f in _DEALT.split(", ") if f.split(" ")[0] not in ("shard", "grams")])]
        mine = rows.filter(pc.is_valid(rows["grams"]))
        if mine.num_rows:
            parts = []
            for data in mine["grams"].to_pylist():
                step, total, many, w, unigram, n, times, docs = _unpack(data)
                parts.append((np.repeat(np.cumsum(step), many), np.repeat(total, many), w, unigram, n, times, docs))
            trie = Trie.mapped(_built(parts).tobytes())
            blocks_, places, sums = mine["block"].to_pylist(), [], []
            for context, _, w, unigram, _, times, docs in parts:
                steps = np.repeat(trie.lookup(context, w, unigram), times)
                total = np.bincount(docs, weights=steps)  # whole numbers, exact below 2 ** 53
                held = np.flatnonzero(np.bincount(docs))
                places.append(held.tolist())
                sums.append(total[held].astype(np.int64).tolist())
            del trie, parts, steps
            out.append(_table(_ANSWERS, len(places), block=blocks_, places=places, sums=sums))
            trim()
        return pa.concat_tables([_table(_ANSWERS, t.num_rows, **{n: t[n] for n in t.column_names}) for t in out])

    return sent.groupBy("shard").applyInArrow(lambda t: asked(t), _ANSWERS)


def _built(parts: list) -> Trie:
    """The trie of all blocks' training bigrams."""
    context, total, w, unigram, n = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
    seen = np.flatnonzero(n > 0)
    order = seen[np.lexsort((w[seen], context[seen]))]
    context, total, w, unigram, n = (x[order] for x in (context, total, w, unigram, n))
    first = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
    count = np.add.reduceat(n.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Trie.of(context[first], w[first], count, total[first], unigram[first])


def gathered(answers: DataFrame, tokens: int) -> DataFrame:
    """RESULT: the answers of each block added up by document."""

    def met(rows: pa.Table) -> pa.Table:
        info = rows.filter(pc.is_valid(rows["doc_ids"])).sort_by("first")
        mine = rows.filter(pc.is_valid(rows["places"]))
        flat = lambda t, c: pc.list_flatten(t[c]).combine_chunks()
        ids = flat(info, "doc_ids")
        steps = np.zeros(len(ids), np.int64)
        np.add.at(steps, flat(mine, "places").to_numpy(), flat(mine, "sums").to_numpy())
        return pa.table({"doc_id": ids, "held_out": flat(info, "held"), "n_tokens": flat(info, "n_tokens"), "n_known": flat(info, "n_known"), "train_tokens": pa.array(np.full(len(ids), tokens)), "base_score": flat(info, "base"), "score": pa.array(-STEP * steps)})

    return answers.groupBy("block").applyInArrow(lambda t: met(t), RESULT)


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """RESULT for every document: the model learns from the rows where trains is true (or null)."""
    spark = docs.sparkSession
    at = new_path(spark, "blocks")
    rows = stored(blocks(docs, trains), "blocks", 2000, at)
    words = rows.where("word is not null").select("block", "word", "code", "n")
    numbers = numbered(words)
    freed(spark)
    fresh = numbers.where("fresh")  # a row a word
    parts = fresh.groupBy("part").agg(F.max("place").alias("last"), F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("known"), F.coalesce(F.sum(F.when(F.col("is_end"), F.col("c"))), F.lit(0)).alias("ends")).orderBy("part").collect()  # a row a partition
    # every training document has one end
    tokens, known, ends = (sum(r[c] for r in parts) for c in ("tokens", "known", "ends"))
    before = spark.createDataFrame([(r["part"], int(x)) for r, x in zip(parts, np.cumsum([1, *(r["last"] + 1 for r in parts)]))], "part long, start long")
    everything = rows.where("tokens is not null").agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    ids = numbers.join(F.broadcast(before), "part").select("block", F.col("code").alias("of_code"), (F.col("start") + F.col("place")).alias("id"), "c")
    of_block = rows.where("tokens is not null").select(F.col("block").alias("own_block"), F.col("code").alias("first"), "doc_ids", "held", "sizes", "tokens")
    sent = dealt(of_block, ids, tokens, known, ends, max(1, -(-everything // SHARD_TOKENS)))
    out = stored(gathered(answered(sent), tokens), "scored", 4000)
    deleted(spark, [at])
    return out
