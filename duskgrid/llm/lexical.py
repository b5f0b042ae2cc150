"""Ranked lexical search: for each item of a query set the documents with the highest scores, by document FP-trees.

1. One pass over the documents counts every text's terms and keeps, of the terms that some item holds, how often each
   occurs: the restricted term vector. N, L and the document frequencies follow from these rows by aggregates.
2. Each task orders the vectors' terms by document frequency, most frequent first, and puts its documents, a bounded
   number at a time, into a trie: documents that begin with the same terms share a path (chains are one node, and few
   documents end a path). A node keeps, of everything below it, the largest tf of each term and the smallest m.
3. A score grows with tf and falls with m, so these two bound the scores below a node. Each item goes depth-first, best
   bound first, some nodes at a time, and leaves out what can't reach its k-th best score so far.
4. The best k of each task's trees meet in a ranking by item, which Spark limits before its shuffle too.

No document is shuffled. Items go in blocks (ITEM_ROWS, ITEM_CHARS), so what is broadcast, an item block's terms, is
bounded whatever the size of the query set; further blocks are further passes.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased.

Defined results: null and empty texts have no terms and are not counted in N; every row of documents and every row of
items stands for itself, repeated ids included (a repeated item_id has its ranks repeated); a null doc_id comes last among
equal scores; items without terms, or whose terms nothing holds, have no rows; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import list_offsets, slices, stored, texts_of
from duskgrid.llm.words import byte_words, ragged

#: Rows and characters of an item block (a longer single item is a block of its own).
ITEM_ROWS, ITEM_CHARS = 2000, 4_000_000
#: Documents and vector entries of a tree, documents that end a path, and nodes looked at together.
TREE_DOCS, TREE_ENTRIES, LEAF, BATCH = 20_000, 4_000_000, 6, 64
#: A byte's part in terms: lower case for A-Z, itself for other term bytes (all of UTF-8 beyond ASCII too), else a space.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
_TERM_BYTES = _TERM_BYTES[:128] + bytes(range(128, 256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's terms, their codes, and the distinct terms that the codes mean."""
    return byte_words(texts, _TERM_BYTES)


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, terms, tfs: every document's number of terms and its restricted vector, terms as places in the list."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of one item block

    def task(batches):
        known = pa.array(shared.value, pa.large_string())
        for b in slices(batches, "text", 4 << 20):
            off, code, distinct = terms_of(texts_of(b, "text"))
            place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(off)
            term = place[code] if len(code) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            held = term >= 0
            pair, tf = np.unique(doc[held] * max(1, len(known)) + term[held], return_counts=True)
            who, term = np.divmod(pair, max(1, len(known)))
            ends = pa.array(np.searchsorted(who, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(task, "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors", 2000)


@dataclass
class Tree:
    """Documents in the order of their paths, and nodes (0 is the root); entries are by document and by node."""

    doc_id: np.ndarray
    m: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    low: np.ndarray  # of each node the first document below it, and the end
    high: np.ndarray
    child_ptr: np.ndarray
    child: np.ndarray
    node_m: np.ndarray
    node_ptr: np.ndarray
    node_term: np.ndarray
    node_tf: np.ndarray


def grow(doc_id: np.ndarray, m: np.ndarray, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Tree:
    """The tree of documents whose entries, term numbers ascending, lie from ptr[i] to ptr[i + 1]."""
    size = np.diff(ptr)
    keys = term.astype(">u4").tobytes()
    order = np.array(sorted(range(len(size)), key=lambda i: keys[4 * ptr[i] : 4 * ptr[i + 1]]), np.int64)
    at = ragged(ptr[:-1][order], size[order])
    doc_id, m, size, term, tf = doc_id[order], m[order], size[order], term[at], tf[at]
    ptr = np.concatenate([[0], np.cumsum(size)])
    shared = [0] * len(size)  # terms at the start that a document has in common with the one before
    for i in range(1, len(size)):
        n = min(size[i - 1], size[i])
        other = np.flatnonzero(term[ptr[i - 1] : ptr[i - 1] + n] != term[ptr[i] : ptr[i] + n])
        shared[i] = int(other[0]) if len(other) else int(n)
    nodes, children, todo = [(0, len(size))], [], [0]
    shared = np.array(shared)
    for node in todo:  # todo grows
        a, b = nodes[node]
        own = []
        if b - a > LEAF:
            inside = shared[a + 1 : b]
            cuts = [a, *(np.flatnonzero(inside == inside.min()) + a + 1).tolist(), b]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own.append(len(nodes))
                nodes.append((lo, hi))
            todo += own
        children.append(own)
    low, high = np.array(nodes).T
    entries = [_maxima(term[ptr[a] : ptr[b]], tf[ptr[a] : ptr[b]]) for a, b in nodes]
    upto = lambda lists: np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    return Tree(
        doc_id, m, ptr, term, tf, low, high,
        upto(children), np.array([c for x in children for c in x], np.int64),
        np.array([m[a:b].min() for a, b in nodes]), upto([t for t, _ in entries]), np.concatenate([t for t, _ in entries]), np.concatenate([x for _, x in entries]),
    )


def _maxima(term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(term, kind="stable")
    t = term[order]
    first = np.flatnonzero(np.diff(t, prepend=-1))
    return t[first], np.maximum.reduceat(tf[order], first)


def scored(weight: np.ndarray, rows: np.ndarray, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The score of each row's entries: exact for documents, a bound for nodes."""
    size = ptr[rows + 1] - ptr[rows]
    at = ragged(ptr[rows], size)
    w = weight[term[at]]
    hit = np.flatnonzero(w)
    own, t = np.repeat(np.arange(len(rows)), size)[hit], tf[at[hit]].astype(np.int64)
    out = np.zeros(len(rows), np.int64)
    np.add.at(out, own, w[hit] * ((1_000_000_000 * t) // (1000 * t + 12 * m[rows][own])))
    return out


def best(tree: Tree, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and score of the k best documents of a tree for one item (weight: w of each of its terms times repeats)."""
    ids, points, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    stack = [(int(scored(weight, np.zeros(1, np.int64), tree.node_ptr, tree.node_term, tree.node_tf, tree.node_m)[0]), 0)]
    while stack:
        taken, stack = stack[-BATCH:], stack[:-BATCH]
        at = np.array([n for bound, n in taken if bound >= least], np.int64)
        inner = tree.child_ptr[at + 1] > tree.child_ptr[at]
        if (ends := at[~inner]).size:
            rows = ragged(tree.low[ends], tree.high[ends] - tree.low[ends])
            s = scored(weight, rows, tree.ptr, tree.term, tree.tf, tree.m)
            ids, points = np.concatenate([ids, tree.doc_id[rows[s >= least]]]), np.concatenate([points, s[s >= least]])
            if len(ids) > k:
                first = np.lexsort((ids, -points))[:k]
                ids, points = ids[first], points[first]
            if len(ids) == k:
                least = max(1, int(points.min()))  # an equal score may still win by its doc_id
        if (inside := at[inner]).size:
            below = tree.child[ragged(tree.child_ptr[inside], tree.child_ptr[inside + 1] - tree.child_ptr[inside])]
            bound = scored(weight, below, tree.node_ptr, tree.node_term, tree.node_tf, tree.node_m)
            order = np.argsort(bound, kind="stable")
            stack += [(b, n) for b, n in zip(bound[order].tolist(), below[order].tolist(), strict=True) if b >= least]
    return ids, points


def found_in_trees(rows: DataFrame, rank: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]], total: int, length: int, k: int) -> DataFrame:
    """item (its place in weights), doc_id, score: the best k of every tree."""
    shared = rows.sparkSession.sparkContext.broadcast((rank, weights))  # of one item block
    null = np.iinfo(np.int64).max

    def searched(docs: list[tuple]) -> pa.RecordBatch:
        rank, weights = shared.value
        doc_id, m, size, term, tf = (np.concatenate(x) for x in zip(*docs, strict=True))
        tree = grow(doc_id, m, np.concatenate([[0], np.cumsum(size)]), term, tf)
        out = [], [], []
        weight = np.zeros(len(rank), np.int64)
        for i, (at, w) in enumerate(weights):
            weight[at] = w
            ids, points = best(tree, weight, k)
            weight[at] = 0
            for column, x in zip(out, (np.full(len(ids), i), ids, points), strict=True):
                column.append(x)
        item, ids, points = (np.concatenate(x) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == null), pa.array(points)], names=["item", "doc_id", "score"])

    def task(batches):
        rank, _ = shared.value
        docs, n_docs, n_entries = [], 0, 0
        for b in batches:
            col = b.column("terms")
            size = np.diff(list_offsets(col))
            if not size.sum():
                continue
            term, tf = rank[col.flatten().to_numpy()], b.column("tfs").flatten().to_numpy()
            order = np.lexsort((term, np.repeat(np.arange(len(size)), size)))
            kept = size > 0
            m = 75 + (25 * b.column("n").to_numpy().astype(np.int64) * total) // length
            docs.append((pc.fill_null(b.column("doc_id"), null).to_numpy()[kept], m[kept], size[kept], term[order], tf[order]))
            n_docs, n_entries = n_docs + int(kept.sum()), n_entries + len(term)
            if n_docs >= TREE_DOCS or n_entries >= TREE_ENTRIES:
                yield searched(docs)
                docs, n_docs, n_entries = [], 0, 0
        if docs:
            yield searched(docs)

    return rows.mapInArrow(task, "item long, doc_id long, score long")


def item_blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Rows (item_id, text) of items, in blocks."""
    block, chars = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        if block and (len(block) >= ITEM_ROWS or chars + len(row["text"]) > ITEM_CHARS):
            yield block
            block, chars = [], 0
        block.append(row)
        chars += len(row["text"])
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for every item, highest first."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        off, code, distinct = terms_of(pa.array([r["text"] for r in block], pa.large_string()))
        if not len(distinct):
            continue
        rows = vectors(docs, distinct.to_pylist())
        total, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(distinct), np.int64)
        for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row a term of the block
            df[term] = n
        w = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        weights = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            own, times = np.unique(code[a:b], return_counts=True)
            weights.append((rank[own], w[own] * times))
        found = found_in_trees(rows, rank, weights, total, max(1, length), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kind}")
        out = out.union(stored(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked", 4000))  # names: at most ITEM_ROWS
    return out
