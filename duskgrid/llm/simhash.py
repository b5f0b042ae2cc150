"""SimHash near-duplicates: fingerprints of word shingles, compared exactly, tile against tile.

Distinct fingerprints are dealt into tiles by population count (large counts into several tiles). Two fingerprints
within the radius differ in population count by no more than the radius, so tile pairs further apart are never made.
Where a shingle similarity is asked for, tiles are dealt by number of shingles too, as sets of which one holds less than
that share of the other's size can't be that similar. Inside a pair the same bounds narrow each comparison to a run of
rows; what remains is compared with exclusive-or and bit counts, all words of it. Each tile pair reduces its links to a
spanning forest, so a group of thousands of near copies leaves about one link a member, never one a pair.

Work grows with the square of the number of distinct fingerprints, as exact comparison does, and so do the bytes
shuffled, divided by TILE; memory a task doesn't grow.

Defined results: null or wordless text has fingerprint zero and links like any other; repeated rows are kept; an empty
table gives an empty result; other columns are ignored. near_duplicates leaves out rows with a null doc_id; first_copies
takes them, after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskgrid.llm.common import fields, slices, splitmix, stored, strings, texts_of
from duskgrid.llm.components import components

SEED = 42
#: Fingerprints a tile holds on average at most: a megabyte for each word of 64 bits.
TILE = 131_072
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of an ASCII-lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes.split parts at exactly \\x20 and \\x09-\\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the word whose bit is set where over half of its hashes have it set."""
    n = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs, np.uint64)
    for byte in range(8):
        value = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        for a in range(0, n_docs, 512):  # counts of each byte value, by document
            i, j = np.searchsorted(doc, [a, min(a + 512, n_docs)])
            m = min(512, n_docs - a)
            have = np.bincount((doc[i:j] - a) * 256 + value[i:j], minlength=m * 256).reshape(m, 256) @ _BITS
            more = (have * 2 > n[a : a + m, None]).astype(np.uint64)
            out[a : a + m] |= (more << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """docs (text and others) with fp (binary, 8 bytes a word, big-endian) and n, the number of shingles, for its text.

    The first 64-bit word is the majority of the shingles' XXH64 (seed 42); further words are the majority of mixed
    values of the same hashes, for callers that want a finer measure of similarity. distinct: each shingle counts once.
    """
    kept = [c for c in docs.columns if c != "text"]

    def task(batches):
        for b in slices(batches, "text"):
            hs = [shingle_hashes(t, shingle) for t in strings(texts_of(b, "text").cast(pa.large_binary()))]
            if distinct:
                hs = [np.unique(h) for h in hs]
            n = np.array([len(x) for x in hs], np.int64)
            doc, h = np.repeat(np.arange(len(hs)), n), np.concatenate(hs)
            out = np.stack([majority_bits(h if w == 0 else splitmix(h, w), doc, len(hs)) for w in range(words)], axis=1)
            raw = out.astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array([raw[i : i + 8 * words] for i in range(0, len(raw), 8 * words)], pa.binary()), pa.array(n)], names=[*kept, "fp", "n"])

    return docs.mapInArrow(task, f"{fields(docs, kept)}, fp binary, n long")


def tile_links(a: np.ndarray, b: np.ndarray, node_a: np.ndarray, node_b: np.ndarray, key_a: np.ndarray, key_b: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as node pairs, of the links between rows of a and rows of b.

    a, b: (rows, words). Rows link if they differ in at most radius bits and the key of b lies in low .. high of a's row.
    """
    order = np.argsort(key_b, kind="stable")
    b, node_b, key_b = b[order], node_b[order], key_b[order]
    nodes, flat = np.unique(np.concatenate([node_a, node_b]), return_inverse=True)
    at_a, at_b = flat[: len(a)].astype(np.int32), flat[len(a) :].astype(np.int32)
    root = np.arange(len(nodes), dtype=np.int32)
    us, vs = [], []
    order = np.argsort(key_a, kind="stable")
    first, last = np.searchsorted(key_b, low[order]), np.searchsorted(key_b, high[order], "right")
    dense = min(a.shape[1], radius // 32 + 1)  # so many words of unlike texts differ in more than radius bits nearly always
    columns = [np.ascontiguousarray(b[:, w]) for w in range(dense)]
    r = 0
    while r < len(order):
        i, step = first[r], max(1, (1 << 17) // max(1, last[r] - first[r]))
        while step > 1 and (last[min(r + step, len(order)) - 1] - i) * step > 1 << 18:
            step //= 2
        some, j = order[r : r + step], last[min(r + step, len(order)) - 1]
        r += step
        if i >= j:
            continue
        bits = sum(np.bitwise_count(a[some, w][:, None] ^ columns[w][None, i:j]).astype(np.uint16) for w in range(dense)) if dense > 1 else np.bitwise_count(a[some, 0][:, None] ^ columns[0][None, i:j])
        x, y = np.nonzero(bits <= radius)
        x, y = some[x], y + i
        ok = (key_b[y] >= low[x]) & (key_b[y] <= high[x])
        x, y = x[ok], y[ok]
        if dense < a.shape[1] and len(x):
            ok = np.concatenate([np.bitwise_count(a[x[p : p + (1 << 17)]] ^ b[y[p : p + (1 << 17)]]).sum(axis=1, dtype=int) <= radius for p in range(0, len(x), 1 << 17)])
            x, y = x[ok], y[ok]
        u, v = at_a[x], at_b[y]
        while len(keep := np.flatnonzero(root[u] != root[v])):  # each pass ties roots to smaller ones, by real links
            u, v = u[keep], v[keep]
            hi, lo = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
            pick = np.lexsort((lo, hi))
            pick = pick[np.unique(hi[pick], return_index=True)[1]]
            us.append(u[pick])
            vs.append(v[pick])
            root[hi[pick]] = lo[pick]
            while (root[root] != root).any():
                root = root[root]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return nodes[np.concatenate(us)], nodes[np.concatenate(vs)]


def near_links(fps: DataFrame, radius: int, share: float = 0.0, tile: int = TILE) -> DataFrame:
    """u, v: links that connect what is within the radius, among rows of fps (node, fp, n), written once.

    share: of two linked rows, the smaller n is at least this share of the larger one; 0 asks nothing of n.
    """
    # population counts in bands of a quarter of the radius, sizes in classes of which only neighbours can link
    width, step = max(1, radius // 4), -np.log(share) if share else 1.0
    whole = F.aggregate(F.sequence(F.lit(0), (F.length("fp") / 8 - 1).cast("int")), F.lit(0), lambda s, w: s + F.bit_count(F.conv(F.hex(F.substring(F.col("fp"), (w * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")))
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / step).cast("int") if share else F.lit(0)
    rows = fps.select("node", "fp", "n", F.floor(whole / width).cast("int").alias("band"), size.alias("size"))
    groups = stored(rows.groupBy("band", "size").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")), "tile-groups")  # a row a band and class: a few hundred
    chunk = F.pmod(F.xxhash64("fp", "n"), F.col("chunks")).cast("int").alias("chunk")
    dealt = rows.join(F.broadcast(groups), ["band", "size"]).select(F.struct("band", "size", chunk).alias("t"), "node", "fp", "n")
    tiles = stored(dealt.groupBy("t").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"), F.collect_list("n").alias("ns")), "tiles")
    reach = (radius + width - 1) // width
    own = groups.withColumn("db", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("ds", F.explode(F.array(*[F.lit(d) for d in ((-1, 0, 1) if share else (0,))])))
    other = groups.select(F.col("band").alias("ob"), F.col("size").alias("os"), F.col("chunks").alias("oc"))
    met = own.join(F.broadcast(other), (F.col("ob") == F.col("band") + F.col("db")) & (F.col("os") == F.col("size") + F.col("ds")))
    each = met.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("oc") - 1)))
    pairs = stored(each.select(F.struct("band", "size", F.col("c").alias("chunk")).alias("a"), F.struct(F.col("ob").alias("band"), F.col("os").alias("size"), F.col("d").alias("chunk")).alias("b")).where("a <= b"), "tile-pairs")
    left = tiles.join(pairs, F.col("t") == F.col("a")).select("a", "b", F.col("nodes").alias("na"), F.col("fps").alias("fa"), F.col("ns").alias("sa"))
    right = tiles.join(pairs, F.col("t") == F.col("b")).select("a", "b", F.col("nodes").alias("nb"), F.col("fps").alias("fb"), F.col("ns").alias("sb"))
    tasks = min(10_000, pairs.count() // 4 + 1)  # by work, not by bytes: a pair of small tiles is much comparing
    left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "a", "b")

    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                na, sa, nb, sb = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("na", "sa", "nb", "sb"))
                a, b = (np.frombuffer(b"".join(strings(batch.column(c).slice(k, 1).flatten())), ">u8").astype(np.uint64).reshape(n, -1) for c, n in (("fa", len(na)), ("fb", len(nb))))
                if share:
                    keys = sa, sb, np.ceil(sa * share - 1e-9).astype(np.int64), np.floor(sa / share + 1e-9).astype(np.int64)
                else:  # halves of words within the radius have population counts within it
                    pa_, pb = (np.bitwise_count(x[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int64) for x in (a, b))
                    keys = pa_, pb, pa_ - radius, pa_ + radius
                u, v = tile_links(a, b, na, nb, *keys, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return stored(left.join(right, ["a", "b"]).select("na", "fa", "sa", "nb", "fb", "sb").mapInArrow(task, "u long, v long"), "near-links", 4)


def classes(fps: DataFrame, radius: int, share: float = 0.0, tile: int = TILE) -> DataFrame:
    """fp, n, root: the class of every distinct fingerprint of fps (node, fp, n), named by its smallest node."""
    size = F.col("n") if share else F.lit(0).cast("long")
    nodes = stored(fps.groupBy("fp", size.alias("n")).agg(F.min("node").alias("node")), "distinct")
    roots = components(near_links(nodes, radius, share, tile))
    return stored(nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("root")), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, words: int = 1, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included) of docs (doc_id, text).

    radius counts differing bits of the whole fingerprint (64 bits a word).
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = stored(fingerprints(rows, shingle, words), "fingerprints", 1000)
    named = classes(fps.select(F.col("doc_id").alias("node"), "fp", "n"), radius, tile=tile)
    return fps.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", F.col("root").alias("component_id"))


def first_copies(docs: DataFrame, shingle: int, radius: int, words: int, share: float, tile: int = TILE) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays, null doc_ids coming last.

    Of rows with one doc_id the one whose text has the smaller hash stays, of equal rows one. Rows link if their
    fingerprints of distinct shingles differ in at most radius bits and their numbers of shingles by no more than share.
    """
    mark = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.monotonically_increasing_id().alias("node"), F.col("text").cast("string").alias("text"))
    fps = stored(fingerprints(rows, shingle, words, distinct=True), "fingerprints", 1000)  # from here on node is fixed
    named = classes(fps.select("node", "fp", "n"), radius, share, tile)
    placed = fps.join(named, ["fp", "n"]).select("doc_id", "mark", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = placed.groupBy("root").agg(F.min(rank).alias("kept"))
    keys = placed.groupBy("doc_id", "mark", "root").agg(F.count("*").alias("times"))
    fate = stored(keys.join(kept, "root").select("doc_id", "mark", (rank == F.col("kept")).alias("stays"), "times").where("not stays or times > 1"), "copies")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.mark"))
    alone = docs.alias("d").join(fate.alias("f"), same, "left_anti")
    repeated = docs.alias("d").join(fate.where("stays").alias("f"), same, "left_semi").withColumn("_mark", mark).dropDuplicates(["doc_id", "_mark"])
    return alone.unionByName(repeated.select(*docs.columns)).select(*docs.columns)
