"""Sums of weights times pixels by entity and date: a product of two sparse tables, in blocks.

A row a pixel and entity is many times the input, and so are sums of it before they meet, so neither is shuffled. Weights lie
in blocks of entities, pixels in blocks of dates, both cut by cell; a task takes one block of each, reads its parts of like
cells and keeps the sums of its entities and dates alone. What goes to disk is each table twice; blocks are read many times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows that a task holds while it makes blocks, pairs of rows that it multiplies at a time, rows of a batch that it returns.
HELD, PAIRS, GIVEN = 3 << 20, 1 << 18, 1 << 16
#: Blocks of dates at most. Weights are read so many times; pixels once a block of entities, of which there are more as tables grow.
DATES = 20


def blocks(spark: SparkSession) -> int:
    """Blocks of entities, and of cells; a task holds the sums of one of them and of one block of dates."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def sums(pixels: DataFrame, weights: DataFrame, by: list[str], left: dict[str, Column], right: dict[str, Column], of: dict[str, tuple[str, str | None]], keep: dict[str, Column] | None = None, dealt: bool = False) -> DataFrame:
    """entity, by, keep and, for each name of `of`, the sum of a left times a right column over the pairs of like cell_id.

    left are columns of weights, right of pixels (None: 1). Where right is null a pair adds 0, whatever left is; else pairs whose
    left is null add nothing, and a sum of none is null. keep: of weights, what is the same in all rows of an entity; windows by
    entity need no shuffle. dealt: pixels lie by cell already.
    """
    n, keep = blocks(pixels.sparkSession), keep or {}
    if pixels.schema["cell_id"].dataType != weights.schema["cell_id"].dataType:
        pixels, weights = (d.withColumn("cell_id", F.col("cell_id").cast("long")) for d in (pixels, weights))
    there, cut = F.col("cell_id").isNotNull(), F.pmod(F.hash("cell_id"), F.lit(n)).alias("_k")
    w = weights.repartition(n, "entity").withColumns(keep).where(there)
    w = w.select(F.pmod(F.hash("entity"), F.lit(n)).alias("_at"), cut, "cell_id", "entity", *keep, *[c.cast("double").alias(name) for name, c in left.items()])
    rows = pixels.where(there)
    day = F.pmod(F.hash(*by), F.lit(min(n, DATES))) if by else F.lit(0)
    p = (rows if dealt else rows.repartition(n, "cell_id")).select(day.alias("_at"), cut, "cell_id", *by, *[c.alias(name) for name, c in right.items()])
    a, b = (d.mapInArrow(_Packed(named), "_at int, _k int, _n int, _block binary").repartitionById(m, "_at").select(*[F.col(c).alias(f"{c}_{side}") for c in ("_k", "_n", "_block")]) for d, named, side, m in ((w, ["entity"], "w", n), (p, by, "p", min(n, DATES) if by else 1)))
    like = (F.col("_k_w") <= F.col("_k_p")) & (F.col("_k_w") >= F.col("_k_p"))  # not `=`, by which blocks would be shuffled once more
    met = a.join(b.hint("shuffle_replicate_nl"), like).select(F.col("_k_w").alias("_k"), F.col("_n_w").alias("_n"), F.col("_block_w").alias("_w"), F.col("_block_p").alias("_p"))
    fields = [*[w.schema[c] for c in ("entity", *keep)], *[p.schema[c] for c in by], *[StructField(name, DoubleType()) for name in of]]
    out = met.mapInArrow(_Product(by, list(left), list(right), of, list(keep)), StructType([StructField(f.name, f.dataType) for f in fields]))
    return out.select("entity", *by, *keep, *of)


class _Packed:
    """Rows of a block and of like cells (_at, _k) as one row, in order of cells; the named columns as dictionaries."""

    def __init__(self, named: list[str]):
        self.named, self.most = named, HELD  # as the driver has it

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, count = [], 0, 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= self.most:
                for out in self.packed(held, count):
                    count += 1
                    yield out
                held, n = [], 0
        if n:
            yield from self.packed(held, count)

    def packed(self, held: list[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        order = pc.sort_indices(t["cell_id"]).to_numpy()
        at, k = (t[c].to_numpy() for c in ("_at", "_k"))
        order = order[np.lexsort((k[order], at[order]))]  # it is stable
        at, k, t = at[order], k[order], t.drop_columns(["_at", "_k"]).take(pa.array(order))
        cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(k) != 0)) + 1).tolist(), len(order)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = t.slice(i, j - i)
            arrays = [_one(part[c]).dictionary_encode("encode") if c in self.named else _one(part[c]) for c in part.column_names]
            part = pa.RecordBatch.from_arrays(arrays, names=t.column_names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
                writer.write_batch(part)
            count += 1
            yield pa.RecordBatch.from_arrays([pa.array([at[i]], pa.int32()), pa.array([k[i]], pa.int32()), pa.array([count], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_at", "_k", "_n", "_block"])


def _one(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _read(block: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(block.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()


def _filled(c: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """The values, 0 where there is none, and where that is (None: nowhere)."""
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False) if c.null_count else None


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


class _Codes:
    """Numbers of values, in the order in which they are first seen."""

    def __init__(self):
        self.values = None

    def of(self, values: pa.Array) -> np.ndarray:
        """The numbers of distinct values."""
        if self.values is None:
            self.values = values
            return np.arange(len(values))
        found = pc.index_in(values, value_set=self.values)
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = out < 0
        if new.any():
            out[new] = np.arange(len(self.values), len(self.values) + new.sum())
            self.values = pa.concat_arrays([self.values, values.filter(pa.array(new))])
        return out

    def rows(self, c: pa.DictionaryArray) -> np.ndarray:
        return self.of(c.dictionary)[c.indices.to_numpy()]


class _Product:
    def __init__(self, by: list[str], left: list[str], right: list[str], of: dict[str, tuple[str, str | None]], keep: list[str]):
        self.by, self.left, self.right, self.of, self.keep = by, left, right, of, keep
        self.most, self.given = PAIRS, GIVEN

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.entities, self.kept = _Codes(), []
        self.levels, self.pairs = [_Codes() for _ in self.by], [_Codes() for _ in self.by[1:]]
        self.grid = np.zeros((0, 0), np.int32)  # of entity and date the place of their sums, from 1
        self.n, self.known, self.sums, self.some = 0, None, {c: np.zeros(0) for c in self.of}, {}
        read = None
        for b in batches:
            ks, ns, ws, ps = (b.column(b.schema.get_field_index(c)) for c in ("_k", "_n", "_w", "_p"))
            for i, of in enumerate(zip(ks.to_pylist(), ns.to_pylist(), strict=True)):
                if read != of:
                    read, w = of, self.weights(_read(ws[i]))
                self.add(w, _read(ps[i]))
        yield from self.out()

    def weights(self, t: pa.RecordBatch) -> dict:
        cells, e = t.column("cell_id"), t.column("entity")
        seen = 0 if self.entities.values is None else len(self.entities.values)
        code = self.entities.of(e.dictionary)
        at = e.indices.to_numpy()
        if self.keep and (code >= seen).any():
            first = np.zeros(len(code), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            self.kept.append(t.select(self.keep).take(pa.array(first[code >= seen])))
        runs = pc.run_end_encode(cells)
        ends = runs.run_ends.to_numpy().astype(np.int64)
        values, none = {}, {}
        for c in self.left:
            values[c], none[c] = _filled(t.column(c))
        odd = any(not np.isfinite(x).all() for x in values.values())
        return {"cells": runs.values, "start": np.concatenate([[0], ends[:-1]]), "size": np.diff(ends, prepend=0), "e": code[at], "values": values, "none": none, "odd": odd, "gaps": any(x is not None for x in none.values())}

    def dates(self, t: pa.RecordBatch) -> np.ndarray:
        if not self.by:
            return np.zeros(t.num_rows, np.int64)
        d = self.levels[0].rows(t.column(self.by[0]))
        for c, level, pair in zip(self.by[1:], self.levels[1:], self.pairs, strict=True):
            u, back = np.unique(d << 32 | level.rows(t.column(c)), return_inverse=True)
            d = pair.of(pa.array(u))[back]
        return d

    def add(self, w: dict, t: pa.RecordBatch) -> None:
        found = pc.index_in(t.column("cell_id"), value_set=w["cells"])
        rows = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            return
        cell = found.drop_null().to_numpy().astype(np.int64)
        if w["gaps"] and self.known is None:  # until now every pair had all left values
            self.known, self.some = np.arange(len(next(iter(self.sums.values())))) < self.n, {c: np.zeros(len(x), bool) for c, x in self.sums.items()}
        d, start, size = self.dates(t)[rows], w["start"][cell], w["size"][cell]
        right = {c: tuple(x if x is None else x[rows] for x in _filled(t.column(c))) for c in self.right}
        upto = np.cumsum(size)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + self.most, "right")))
            own = size[i:j]
            ri = np.repeat(np.arange(i, j), own)
            li = np.arange(len(ri)) + np.repeat(start[i:j] - (upto[i:j] - upto[i] + size[i] - own), own)
            self.place(w, right, li, ri, self.at(w["e"][li], d[ri]))
            i = j

    def at(self, e: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Where the sums of entities and dates are; new ones get places."""
        need = int(e.max()) + 1, int(d.max()) + 1
        if any(x > have for x, have in zip(need, self.grid.shape, strict=True)):
            size = tuple(have if x <= have else max(2 * have, x) for x, have in zip(need, self.grid.shape, strict=True))
            grid = np.zeros(size, np.int32)
            grid[: self.grid.shape[0], : self.grid.shape[1]] = self.grid
            self.grid = grid
        key, flat = e * self.grid.shape[1] + d, self.grid.reshape(-1)
        place = flat[key]
        if (place == 0).any():
            new = np.unique(key[place == 0])
            flat[new] = np.arange(self.n + 1, self.n + 1 + len(new))
            self.n += len(new)
            self.sums = {c: _grown(x, self.n) for c, x in self.sums.items()}
            if self.known is not None:
                self.known, self.some = _grown(self.known, self.n), {c: _grown(x, self.n) for c, x in self.some.items()}
            place = flat[key]
        return place - 1

    def place(self, w: dict, right: dict, li: np.ndarray, ri: np.ndarray, at: np.ndarray) -> None:
        if self.known is not None and not w["gaps"]:
            self.known[at] = True
        a, b = {}, {}
        for c, (x, y) in self.of.items():
            if x not in a:
                a[x] = w["values"][x][li]
            if y is not None and y not in b:
                b[y] = right[y][0][ri]
            product = a[x] if y is None else a[x] * b[y]
            absent = None if y is None or right[y][1] is None else right[y][1][ri]
            if w["odd"] and absent is not None:
                product[absent] = 0
            np.add.at(self.sums[c], at, product)
            if w["gaps"]:
                none = w["none"][x]
                there = np.ones(len(at), bool) if none is None else ~none[li]
                self.some[c][at[there if absent is None else there | absent]] = True

    def out(self) -> Iterator[pa.RecordBatch]:
        flat = self.grid.reshape(-1)
        keys = np.flatnonzero(flat)
        kept = pa.Table.from_batches(self.kept).combine_chunks() if self.kept else None
        for i in range(0, len(keys), self.given):
            e, d = np.divmod(keys[i : i + self.given], self.grid.shape[1])
            at = flat[keys[i : i + self.given]] - 1
            days = []
            for level, pair in zip(self.levels[:0:-1], self.pairs[::-1], strict=True):
                both = pair.values.to_numpy()[d]
                d = both >> 32
                days.append(level.values.take(pa.array(both & 0xFFFFFFFF)))
            days += [level.values.take(pa.array(d)) for level in self.levels[:1]]
            mine = [_one(kept[c]).take(pa.array(e)) for c in self.keep]
            totals = [pa.array(x[at], mask=None if self.known is None else ~(self.known[at] | self.some[c][at])) for c, x in self.sums.items()]
            yield pa.RecordBatch.from_arrays([self.entities.values.take(pa.array(e)), *mine, *days[::-1], *totals], names=["entity", *self.keep, *self.by, *self.of])
