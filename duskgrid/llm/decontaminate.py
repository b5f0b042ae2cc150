"""Benchmark decontamination: n-gram seeds lead passages to test items, Smith-Waterman alignment scores them.

1. One pass over all documents counts, of every n-gram of the items, the surroundings it occurs in (the words AROUND
   places before and behind, together), and of every word of the items the documents that hold it. An n-gram is rare up to RARE
   surroundings. Documents are no measure: copies of an item, whole or edited, make its n-grams frequent, and those that
   an edit broke would look rarer than those that survive it. In copies an n-gram's surroundings are the same ones again;
   only phrases of the language have ever new ones.
2. Seeds are the rare n-grams of each stretch of an item (STRETCH places). n-grams that occur nowhere are none, nor do
   they count; where a stretch has common ones alone these are its seeds, all of them.
3. A second pass finds the seeds in the documents, hence passages: the words around hits of an item that lie near each other.
4. Each passage is aligned with its item, word by word, by Smith-Waterman local alignment; words weigh what they tell
   (log of the share of documents without them), so agreeing on `the` means little. The score is the share of the item's
   own weight that the best alignment keeps; edited and partly paraphrased copies keep most. Passages whose words, in any
   order, weigh too little for the threshold can't reach it and aren't aligned.

A copy is missed if its edits broke every rare n-gram of every stretch that has one, and the rest too.

n-grams and words are looked up in memory where they are few enough (SEEDS_IN_MEMORY, counted first). Beyond it both passes
are joins on hashes instead, with the same counts and passages for every row.

Defined results: null, empty or wordless documents and items match nothing; items shorter than the n-gram are one
shorter n-gram; null ids take no part; rows that repeat a doc_id are looked at one by one, and of all their passages for
an item the best is reported, once; rows that repeat an item_id with other texts are looked for one by one too, and the
best is reported under that id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import slices, splitmix, stored, texts_of
from duskgrid.llm.words import words_of

#: Words of a seed, and the seeds that may be held in memory: 16 MB of hashes.
NGRAM, SEEDS_IN_MEMORY = 3, 2_000_000
#: Surroundings up to which an n-gram is rare, the places of an item that have seeds of their own, and how far
#: surroundings lie from the n-gram: phrases of up to AROUND words show new ones with each of their n-grams.
RARE, STRETCH, AROUND = 1000, 8, 8
#: Hits of a batch that are grouped into passages at a time; beyond it items go in turns.
HITS = 2_000_000
#: Share of an item's weight that an alignment must keep, and what a gap or mismatch costs (times the mean word weight).
THRESHOLD, PENALTY = 0.5, 0.5
#: Hits of an item further apart than this many item lengths belong to different passages.
REACH = 1
#: What the second pass writes: passages.
FOUND = "doc_id long, item_id long, first long, words array<string>"
#: What the first pass writes: a surrounding (around) of an n-gram (kind 0), or the documents (n) that hold a word (kind 1).
COUNTED = "kind byte, h long, around long, n long"
#: Bytes of text in a batch.
BATCH = 4 << 20


def word_hash(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 7) for w in words), np.uint64, len(words)) if words else np.zeros(0, np.uint64)


def ngram_hashes(texts: pa.Array):
    """Hash, text and first word of every n-gram; words' offsets and codes, the words and their hashes.

    A text with fewer words than an n-gram has one n-gram, of all its words.
    """
    off, code, words = words_of(texts)
    hashes = word_hash(words)
    h = hashes[code]
    n = np.diff(off)
    with np.errstate(over="ignore"):
        gram = splitmix(h, 1)
        for j in range(1, NGRAM):
            gram[: max(len(h) - j, 0)] += splitmix(h[j:], j + 1)
    doc = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) + NGRAM <= off[1:][doc] if len(h) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < NGRAM))
    for i in short.tolist():  # a handful of words at most, each
        with np.errstate(over="ignore"):
            gram[off[i]] = sum((splitmix(h[off[i] + j : off[i] + j + 1], j + 1)[0] for j in range(n[i])), np.uint64(n[i]))
        inside[off[i]] = True
    at = np.flatnonzero(inside)
    return gram[at].astype(np.int64), doc[at], at - off[doc[at]], off, code, words, hashes


def surroundings(doc: np.ndarray, at: np.ndarray, off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of the words AROUND places before and behind each n-gram (text, first word), or nearer at an edge; h: hashes of all words."""
    if not len(doc):
        return np.zeros(0, np.int64)
    start, end, pos = off[doc], off[1:][doc], off[doc] + at
    last = np.minimum(pos + NGRAM, end) - 1
    before = np.where(at > 0, h[np.maximum(pos - AROUND, start)], 0)
    after = np.where(last + 1 < end, h[np.minimum(last + AROUND, end - 1)], 0)
    with np.errstate(over="ignore"):
        return (splitmix(before, 11) + splitmix(after, 12)).astype(np.int64)


def _grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (0 n-gram, 1 word), h, at, around: every n-gram and every word of df (keys, all long, and text)."""

    def task(batches):
        for b in slices(batches, "text", BATCH):
            g, d, at, off, code, _, hashes = ngram_hashes(texts_of(b, "text"))
            h = hashes[code]
            w = np.repeat(np.arange(len(off) - 1), np.diff(off))
            for kind, row, value, place, around in ((0, d, g, at, pa.array(surroundings(d, at, off, h))), (1, w, h.astype(np.int64), np.arange(len(w)) - off[w], pa.nulls(len(w), pa.int64()))):
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(pa.array(row)) for k in keys), pa.array(np.full(len(row), kind, np.int8)), pa.array(value), pa.array(place), around], names=[*keys, "kind", "h", "at", "around"])

    return df.select(*keys, "text").mapInArrow(task, ", ".join(f"{k} long" for k in keys) + ", kind byte, h long, at long, around long")


def word_counts(off: np.ndarray, code: np.ndarray, h: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted (sorted) word hashes those that the texts hold, and how many texts hold each. h: hashes of the codes."""
    place = np.searchsorted(wanted, h).clip(0, max(len(wanted) - 1, 0))
    mine = np.where(wanted[place] == h, place, -1)[code] if len(wanted) and len(h) else np.full(len(code), -1)
    held = mine >= 0
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[held]
    once = np.unique(doc * max(len(wanted), 1) + mine[held])
    n = np.bincount(once % max(len(wanted), 1), minlength=len(wanted))
    some = np.flatnonzero(n)
    return wanted[some], n[some]


def _counted(kind: int, h: np.ndarray, around: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    filled = [pa.nulls(len(h), pa.int64()) if c is None else pa.array(c) for c in (around, n)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h), *filled], names=["kind", "h", "around", "n"])


def _count_in_memory(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """COUNTED of docs (doc_id, text) for marks (kind, h), which are few. A batch gives a surrounding once."""
    t = marks.select("kind", "h").distinct().toArrow()
    kind, h = t["kind"].to_numpy(), t["h"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(h[kind == 0]), np.sort(h[kind == 1])))  # counted before: SEEDS_IN_MEMORY at most

    def task(batches):
        grams, wanted = shared.value
        for b in slices(batches, "text", BATCH):
            g, d, at, off, code, _, hashes = ngram_hashes(texts_of(b, "text"))
            hit = np.flatnonzero(_among(g, grams))
            pairs = np.unique(np.stack([g[hit], surroundings(d[hit], at[hit], off, hashes[code])]), axis=1)
            yield _counted(0, pairs[0], pairs[1], None)
            held, n = word_counts(off, code, hashes.astype(np.int64), wanted)
            yield _counted(1, held, None, n)

    return docs.mapInArrow(task, COUNTED)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of known (sorted)."""
    return known[np.searchsorted(known, x).clip(0, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _search_in_memory(docs: DataFrame, seeds: DataFrame, most: int = HITS) -> DataFrame:
    """FOUND of docs (doc_id, text) for seeds (item_id, h, size), which are few."""
    t = seeds.toArrow()
    h, item, size = (t[c].to_numpy() for c in ("h", "item_id", "size"))
    order = np.argsort(h, kind="stable")
    turn = np.unique(item, return_inverse=True)[1]
    shared = docs.sparkSession.sparkContext.broadcast((h[order], item[order], size[order], turn[order]))  # counted before: SEEDS_IN_MEMORY at most

    def task(batches):
        h, item, size, turn = shared.value
        for b in slices(batches, "text", BATCH):
            g, d, at, off, code, words, _ = ngram_hashes(texts_of(b, "text"))
            hit = np.flatnonzero(_among(g, h))
            g, d, at = g[hit], d[hit], at[hit]
            turns = max(1, -(-int((np.searchsorted(h, g, "right") - np.searchsorted(h, g)).sum()) // most))
            for k in range(turns):
                own = np.flatnonzero(turn % turns == k) if turns > 1 else np.arange(len(h))
                lo, hi = np.searchsorted(h[own], g), np.searchsorted(h[own], g, "right")
                many = hi - lo
                ends = np.cumsum(many)
                seed = own[np.repeat(lo - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
                yield _windows(b.column("doc_id"), np.repeat(d, many), item[seed], np.repeat(at, many), size[seed], off, code, words)

    return docs.mapInArrow(task, FOUND)


def _search_by_join(keyed: DataFrame, grams: DataFrame, seeds: DataFrame) -> DataFrame:
    """FOUND as _search_in_memory gives it, by joins on the hash; rows of keyed are told apart by doc_id and a hash of their text."""
    one = F.struct("item_id", "at", "size")
    hits = grams.where("kind = 0").join(seeds, "h").groupBy("doc_id", "key").agg(F.collect_set(one).alias("hits"))  # a set: equal rows give each hit as often as they are there

    def again(batches):
        for b in slices(batches, "text", BATCH):
            _, _, _, off, code, words, _ = ngram_hashes(texts_of(b, "text"))
            lists = b.column("hits")
            flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
            item, at, size = (flat.field(i).to_numpy() for i in range(3))
            yield _windows(b.column("doc_id"), np.repeat(np.arange(b.num_rows), n), item, at, size, off, code, words)

    return keyed.join(hits, ["doc_id", "key"]).select("doc_id", "text", "hits").mapInArrow(again, FOUND)


def _count_by_join(keyed: DataFrame, grams: DataFrame, marks: DataFrame) -> DataFrame:
    """COUNTED as _count_in_memory gives it, surroundings once a document."""
    wanted = marks.select("kind", "h").distinct()
    mine = grams.join(wanted, ["kind", "h"], "left_semi")
    around = mine.where("kind = 0").select("kind", "h", "around", F.lit(None).cast("long").alias("n"))
    times = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    held = mine.where("kind = 1").select("kind", "h", "doc_id", "key").distinct().join(times, ["doc_id", "key"])
    return around.union(held.select("kind", "h", F.lit(None).cast("long").alias("around"), F.col("times").alias("n")))


def rare_seeds(grams: DataFrame, counts: DataFrame, rare: int = RARE) -> DataFrame:
    """item_id, h: the seeds among grams (item_id, kind, h, at) by counts (kind, h, around: how many surroundings).

    Of every stretch of an item the rare n-grams, or all that occur where none is rare.
    """
    occurring = grams.where("kind = 0").join(counts.where("kind = 0").select("h", "around"), "h")  # around, of grams, is dropped before
    least = F.min("around").over(Window.partitionBy("item_id", F.floor(F.col("at") / STRETCH)))
    return occurring.withColumn("_least", least).where((F.col("around") <= rare) | (F.col("_least") > rare)).select("item_id", "h").distinct()


def _cluster(doc: np.ndarray, item: np.ndarray, at: np.ndarray, reach: np.ndarray):
    """Groups hits, sorted by document, item and place, into runs with no gap over reach; yields run starts and ends."""
    order = np.lexsort((at, item, doc))
    doc, item, at, reach = doc[order], item[order], at[order], reach[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > reach[1:])
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(doc)) - 1
    return doc[starts], item[starts], at[starts], at[ends[: len(starts)]], reach[starts]


def _windows(ids, doc, item, at, size, off, code, words) -> pa.RecordBatch:
    d, i, a, z, reach = _cluster(doc, item, at, size * REACH)
    first = np.maximum(a - reach, 0)
    end = np.minimum(z + NGRAM + reach, np.diff(off)[d]) if len(d) else z
    n = end - first
    cuts = np.concatenate([[0], np.cumsum(n)])
    start = (off[d] + first) - cuts[:-1]
    picked = code[np.repeat(start, n) + np.arange(cuts[-1])] if len(d) else code[:0]
    text = pa.array(words, pa.string()).take(pa.array(picked))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(i.astype(np.int64)), pa.array(first.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), text)], names=["doc_id", "item_id", "first", "words"])


def align(item: list[str], weight: np.ndarray, passage: list[str]) -> tuple[float, int, int]:
    """Best local alignment: share of the item's weight kept, and the passage words from and to which it runs."""
    total, cost = float(weight.sum()), PENALTY * float(weight.mean()) if len(weight) else 0.0
    if not total or not passage:
        return 0.0, 0, 0
    codes = {w: i for i, w in enumerate(item)}
    p = np.array([codes.get(w, -1) for w in passage])
    own = np.array([codes[w] for w in item])
    m = len(item)
    row, start = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    ramp = cost * np.arange(m + 1)
    best = (0.0, 0, 0)
    for j, w in enumerate(p.tolist()):  # one row a passage word; gaps along the item by a running maximum
        diag = row[:-1] + np.where(own == w, weight, -cost)
        up = row[1:] - cost
        take = diag >= up
        value = np.concatenate([[0.0], np.maximum(np.where(take, diag, up), 0)])
        begin = np.concatenate([[j + 1], np.where(value[1:] > 0, np.where(take, np.where(row[:-1] > 0, start[:-1], j), start[1:]), j + 1)])
        lifted = value + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(m + 1), 0))
        row, start = top - ramp, begin[source]
        k = int(row.argmax())
        if row[k] > best[0] + 1e-12:
            best = (float(row[k]), int(start[k]), j + 1)
    return best[0] / total, best[1], best[2]


def most(item: list[str], weight: np.ndarray, passage: list[str]) -> float:
    """What align can score at most: the share of the item's weight whose words the passage holds, in any order."""
    held, total = set(passage), float(weight.sum())
    return float(weight[[w in held for w in item]].sum()) / total if total else 0.0


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, in_memory: int = SEEDS_IN_MEMORY, rare: int = RARE) -> DataFrame:
    """doc_id, item_id, score, first, last, passage: the best passage of each document for each item it leaks.

    docs (doc_id, text), items (item_id, text). first and last number the document's words, from 0, last excluded.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("own"), F.col("text").cast("string").alias("text")).distinct()
    named = stored(named.select(F.xxhash64("own", "text").alias("item_id"), "own", "text"), "items")  # from here on an item is an id with a text
    items = named.select("item_id", "text")
    grams = stored(_grams(items, ["item_id"]).drop("around"), "item-grams")
    sizes = grams.where("kind = 1").groupBy("item_id").agg(F.count("*").alias("size"))
    marks = stored(grams.select("item_id", "kind", "h").distinct().join(sizes, "item_id"), "marks")
    few = marks.count() <= in_memory
    if not few:
        keyed = docs.withColumn("key", F.xxhash64("text"))
        all_grams = stored(_grams(keyed, ["doc_id", "key"]), "document-grams")
    counted = _count_in_memory(docs, marks) if few else _count_by_join(keyed, all_grams, marks)
    counts = stored(counted.groupBy("kind", "h").agg(F.approx_count_distinct("around").alias("around"), F.sum("n").alias("n")), "counts")
    seeds = stored(rare_seeds(grams, counts, rare).join(sizes, "item_id"), "seeds")
    found = stored(_search_in_memory(docs, seeds) if few else _search_by_join(keyed, all_grams, seeds), "passages")
    total = docs.count()
    counts = counts.where("kind = 1").select("h", "n")
    known = grams.where("kind = 1").join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = F.log((F.lit(float(total)) + 1) / (F.col("n") + 0.5)) + 0.1  # also a word that all documents hold tells a little
    weights = known.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", told.alias("w")))), lambda x: x["w"]).alias("weights"))
    texts = stored(_item_words(items).join(weights, "item_id"), "weighed")
    met = found.join(texts, "item_id").select("doc_id", "item_id", "first", "words", "item", "weights")

    def task(batches):
        for b in batches:
            ids, items_, firsts, words, item, weight = (c.to_pylist() for c in b.columns)
            out = []
            for k in range(b.num_rows):
                w = np.array(weight[k])
                if most(item[k], w, words[k]) < threshold - 1e-9:
                    continue
                s, x, y = align(item[k], w, words[k])
                if s >= threshold:
                    out.append((ids[k], items_[k], s, firsts[k] + x, firsts[k] + y, " ".join(words[k][x:y])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "item_id", "score", "first", "last", "passage"])

    spread = met.repartition(F.xxhash64("doc_id", "item_id", "first", "words"))
    scored = stored(spread.mapInArrow(task, "doc_id long, item_id long, score double, first long, last long, passage string"), "scored", 500)
    best = F.max_by(F.struct("score", "first", "last", "passage"), F.struct("score", -F.col("first"), "passage"))
    return scored.join(named.select("item_id", "own"), "item_id").groupBy("doc_id", F.col("own").alias("item_id")).agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _item_words(items: DataFrame) -> DataFrame:
    def task(batches):
        for b in slices(batches, "text", BATCH):
            off, code, words = words_of(texts_of(b, "text"))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(words, pa.string()).take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists], names=["item_id", "item"])

    return items.mapInArrow(task, "item_id long, item array<string>")
