"""Approximate nearest neighbours by cross-polytope hashing, exactly reranked.

A table turns unit vectors by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and gives
each the signed axis it is nearest to, twice, by two rotations: the pair is its bucket. A row lies in one bucket of each
table; a query looks into the buckets of its several nearest pairs (multiprobe), and everything found there is ranked by
exact Euclidean distance on the original vectors, in double precision.

Buckets are dealt into groups of about BLOCK rows of a table; a query goes once to each group that holds buckets it
probes, with their list. Groups that hold more are divided into blocks by a hash of vec_id, and a group's queries too, so
no bucket, however full, meets in one task; each block keeps only the best k of each of its queries. Of rows with one and
the same vector only the k + 1 smallest ids can be among anyone's k nearest, so only they are searched: that loses nothing.

How many buckets a query probes follows from the table itself: SAMPLE queries (the first by a hash of their id) are
answered exactly, by one pass over all rows, and the ranks of their true neighbours' buckets among those they would probe
tell the fewest probes that find WANTED of these. How many axes a bucket has follows from the number of rows, so that a
bucket holds a bounded number of them on average.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as query nor as
candidate; rows with a null vec_id neither; a query meets vectors of its own length only, as there is no distance to
others; repeated vec_ids count once, with the least of their vectors; fewer candidates than k give them all (any query
with fewer than k found is completed by an exact scan in blocks); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import fields, list_offsets, splitmix, stored
from duskgrid.llm.words import ragged

TABLES = 20
#: Queries of the sample, the share of their neighbours that must be found, probes that are tried, and rows of a bucket.
SAMPLE, WANTED, TRIED, BUCKET_ROWS = 64, 0.97, (12, 24, 48, 96, 192, 288, 384, 576, 768, 1152, 1536, 2304, 3072, 4608, 6144, 8192), 64
#: Rows and queries of a group of buckets that meet in one block.
BLOCK, QUERY_BLOCK = 20_000, 2_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Rows, padded to a power of two, after the pseudo-rotation of a table's which-th hash."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([11, table, which])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, probes): the buckets of unit rows in a table, nearest axes first."""
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for k in range(hashes):
        y = rotated(x, table, k)
        signed = np.concatenate([y, -y], axis=1)
        near = _least(-signed, probes)
        loss = 1 - np.take_along_axis(signed, near, axis=1)
        total = (total[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * signed.shape[1] + near[:, None, :]).reshape(len(x), -1)
        best = _least(total, probes)  # of tuples of axes, the smallest total loss first
        total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values of each row, least first."""
    if n == 1:
        return values.argmin(axis=1)[:, None]
    some = np.argpartition(values, n - 1, axis=1)[:, :n] if n < values.shape[1] else np.broadcast_to(np.arange(values.shape[1]), values.shape)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(values, some, axis=1), axis=1, kind="stable"), axis=1)


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def usable(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, v (as it is), d (its length): distinct rows that take part."""
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).alias("v"))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))


def hashed(rows: DataFrame, tables: int, hashes: dict[int, int], groups: int) -> DataFrame:
    """t, d, g, b, id, v: each vector once for each table, with its bucket and the group of buckets this lies in."""

    def task(batches):
        for batch in batches:
            for d, at in _by_length(batch):
                unit = _unit(batch.column("v").take(at))
                for t in range(tables):
                    code = buckets(unit, t, hashes[d], 1)[:, 0]
                    yield _rows(batch, at, t, d, [("g", _group(code, groups)), ("b", code)])

    return rows.mapInArrow(task, f"t int, d int, g long, b long, id long, {fields(rows, ['v'])}")


def probing(rows: DataFrame, tables: int, hashes: dict[int, int], probes: dict[int, int], groups: int) -> DataFrame:
    """t, d, g, bs, id, v: each query once for each group of buckets that it probes, with the list of these."""

    def task(batches):
        for batch in batches:
            for d, at in _by_length(batch):
                unit = _unit(batch.column("v").take(at))
                for t in range(tables):
                    code = buckets(unit, t, hashes[d], probes[d])
                    who, flat = np.repeat(np.arange(len(code)), code.shape[1]), code.ravel()
                    group = _group(flat, groups)
                    order = np.lexsort((flat, group, who))
                    who, flat, group = who[order], flat[order], group[order]
                    cuts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(flat)).astype(np.int32)), pa.array(flat))
                    yield _rows(batch, at.take(pa.array(who[cuts])), t, d, [("g", group[cuts]), ("bs", lists)])

    return rows.mapInArrow(task, f"t int, d int, g long, bs array<long>, id long, {fields(rows, ['v'])}")


def _by_length(batch: pa.RecordBatch):
    d = batch.column("d").to_numpy()
    return [(int(n), pa.array(np.flatnonzero(d == n))) for n in np.unique(d)]


def _unit(v: pa.Array) -> np.ndarray:
    return _units(matrix(v))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _group(code: np.ndarray, groups: int) -> np.ndarray:
    return (splitmix(code) % np.uint64(groups)).astype(np.int64)


def _rows(batch: pa.RecordBatch, at: pa.Array, t: int, d: int, own: list) -> pa.RecordBatch:
    cols = {"t": pa.array(np.full(len(at), t, np.int32)), "d": pa.array(np.full(len(at), d, np.int32)), **{n: x if isinstance(x, pa.Array) else pa.array(x) for n, x in own}, "id": batch.column("vec_id").take(at), "v": batch.column("v").take(at)}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def best_of(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, meet=None) -> pa.Table:
    """For each query its k nearest of rows (itself excluded), ties to the smaller id: query_id, vec_id, score.

    meet: of each query the (sorted) buckets it probes and the rows' buckets, in order; None: all rows.
    """
    found = [], [], []
    step = max(1, (1 << 15) // max(1, len(rows)))
    for a in range(0, len(queries), step):
        b = min(a + step, len(queries))
        if meet is None:
            q, r = np.repeat(np.arange(a, b), len(rows)), np.tile(np.arange(len(rows)), b - a)
        else:
            lists, own = meet
            asked = np.concatenate(lists[a:b])
            lo, hi = np.searchsorted(own, asked), np.searchsorted(own, asked, "right")
            q, r = np.repeat(np.repeat(np.arange(a, b), [len(x) for x in lists[a:b]]), hi - lo), ragged(lo, hi - lo)
        other = qid[q] != ids[r]
        q, r = q[other], r[other]
        dist = np.concatenate([np.zeros(0), *(np.sqrt(((queries[q[i : i + (1 << 14)]] - rows[r[i : i + (1 << 14)]]) ** 2).sum(axis=1)) for i in range(0, len(q), 1 << 14))])
        order = np.lexsort((ids[r], dist, q))
        q, r, dist = q[order], r[order], dist[order]
        first = np.searchsorted(q, q)  # where each query's rows begin
        kept = np.arange(len(q)) - first < k
        for out, x in zip(found, (qid[q[kept]], ids[r[kept]], dist[kept]), strict=True):
            out.append(x)
    kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
    return pa.table({n: pa.array(np.concatenate(x) if x else [], kind) for (n, kind), x in zip(kinds, found, strict=True)})


def _met(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = left.combine_chunks(), right.combine_chunks()
        if not q.num_rows or not r.num_rows:
            return best_of(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), k)
        meet = None
        if "bs" in q.column_names:
            r = r.sort_by("b").combine_chunks()
            meet = _lists(q["bs"].combine_chunks()), r["b"].to_numpy()
        qv, rv = (matrix(t["v"].combine_chunks()) for t in (q, r))
        return best_of(qv, q["id"].to_numpy(), rv, r["id"].to_numpy(), k, meet)

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda a, b: task(a, b), "query_id long, vec_id long, score double")


def _lists(col: pa.Array) -> list[np.ndarray]:
    return np.split(col.flatten().to_numpy(), list_offsets(col)[1:-1])


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, each candidate once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def axes(rows: int, d: int) -> int:
    """Rotations whose axes make a bucket: as many as it takes for BUCKET_ROWS rows in each of the (2 d) ** axes buckets, 2 to 4."""
    wide = 2 * (1 << max(0, d - 1).bit_length())
    return int(np.clip(np.ceil(np.log(max(1, rows) / BUCKET_ROWS) / np.log(wide)), 2, 4))


def exact(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score, v: the k nearest of each batch of rows (vec_id, v, d), for queries given by vector length: (ids, vectors)."""

    def task(batches):
        for batch in batches:
            for d, at in _by_length(batch):
                if d not in asked:
                    continue
                qid, q = asked[d]
                v, ids = batch.column("v").take(at), batch.column("vec_id").take(at)
                found = best_of(q, qid, matrix(v), ids.to_numpy(), k)
                place = dict(zip(ids.to_pylist(), range(len(ids)), strict=True))
                own = v.take(pa.array([place[i] for i in found["vec_id"].to_pylist()], pa.int64()))
                for part in found.append_column("v", own).to_batches():
                    yield part

    return rows.mapInArrow(task, f"query_id long, vec_id long, score double, {fields(rows, ['v'])}")


def probes_wanted(single: DataFrame, queries: DataFrame, k: int, tables: int, hashes: dict[int, int]) -> dict[int, int]:
    """By vector length the fewest probes of TRIED that find WANTED of the true neighbours of the sample (the most, if none does).

    What comes to the driver is SAMPLE queries of each length and k neighbours of each.
    """
    first = Window.partitionBy("d").orderBy(F.xxhash64("vec_id"), "vec_id")
    asked: dict[int, list] = {}
    for r in queries.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SAMPLE).collect():
        asked.setdefault(r["d"], []).append((r["vec_id"], np.array(r["v"], float)))
    given = {d: (np.array([i for i, _ in x], np.int64), np.stack([v for _, v in x])) for d, x in asked.items()}
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near: dict[int, list] = {}
    for r in exact(single, given, k).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).collect():
        near.setdefault(r["query_id"], []).append(np.array(r["v"], float))
    out = {}
    for d, (ids, vectors) in given.items():
        most = min(TRIED[-1], (2 * (1 << max(0, d - 1).bit_length())) ** hashes[d])
        pairs = [(i, v) for i, q in enumerate(ids.tolist()) for v in near.get(q, [])]
        if not pairs:
            out[d] = min(TRIED[0], most)
            continue
        who, close = np.array([i for i, _ in pairs]), _units(np.stack([v for _, v in pairs]))
        rank = np.full(len(pairs), most)
        for t in range(tables):
            probed, own = buckets(_units(vectors), t, hashes[d], most), buckets(close, t, hashes[d], 1)[:, 0]
            hit = probed[who] == own[:, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
        out[d] = next((p for p in TRIED if p <= most and (rank < p).mean() >= WANTED), most)
    return out


def search(rows: DataFrame, is_query: Column, k: int = 10, vec: str = "embedding", tables: int = TABLES, probes: int | None = None, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row where is_query (a condition on vec_id) among all others.

    probes and hashes (axes of a bucket) follow from the table unless given.
    """
    base = stored(usable(rows, vec), "vectors")
    queries = base.where(is_query)
    same = Window.partitionBy("v").orderBy("vec_id")
    single = stored(base.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"), "vectors-once")
    total = single.count()
    groups = max(1, -(-total // BLOCK))
    lengths = {r["d"]: r["n"] for r in single.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row a length
    many = {d: hashes or axes(n, d) for d, n in lengths.items()}
    tried = dict.fromkeys(lengths, probes) if probes else probes_wanted(single, queries, k, tables, many)
    index = stored(hashed(single, tables, many, groups), "buckets", 1000)
    probed = stored(probing(queries, tables, many, tried, groups), "probes", 1000)
    keys = ["t", "d", "g"]
    sizes, asked = index.groupBy(*keys).agg(F.count("*").alias("rows")), probed.groupBy(*keys).agg(F.count("*").alias("asked"))
    # a row a group that is asked for
    blocks = stored(sizes.join(asked, keys).select(*keys, F.ceil(F.col("rows") / (2 * BLOCK)).cast("int").alias("nr"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("nq")), "blocks")

    def dealt(df: DataFrame, own: str, other: str, more: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(blocks, keys).withColumn(own[1:], part).withColumn(other[1:], meets).select(*keys, "r", "q", more, "id", "v")

    near = _met(dealt(probed, "nq", "nr", "bs"), dealt(index, "nr", "nq", "b"), [*keys, "r", "q"], k)
    found = stored(top(near, k), "found")
    alike = single.groupBy("d").agg(F.count("*").alias("alike"))  # a row a length
    held = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(alike, "d").join(held, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("alike") - 1))
    lacking = stored(short.select("d", F.col("vec_id").alias("id"), "v"), "lacking")
    if (few := lacking.count()) > 0:  # too few rows in the buckets they probe: all rows for these, block by block
        nr, nq = -(-total // BLOCK), -(-few // QUERY_BLOCK)
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = lacking.withColumn("q", block(nq)).withColumn("r", every(nr))
        r = single.withColumnRenamed("vec_id", "id").withColumn("r", block(nr)).withColumn("q", every(nq))
        found = top(found.select("query_id", "vec_id", "score").unionByName(_met(q, r, ["d", "r", "q"], k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
