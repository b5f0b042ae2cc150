"""What the corpus operators share: tables in the shared folder, Arrow batches of bounded bytes, checksums."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskgrid.sources.io import own_folder

#: Remainder of crc32(doc_id as text) by FOLDS that is held out from every training step.
FOLDS, HELD_OUT = 4, 2


#: Paths that each open scratch() has handed out, the innermost last.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, one of our own where all is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = own_folder(spark.sparkContext.applicationId)
    return f"{where.rstrip('/')}/duskgrid-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders, through Spark's own file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, kept: str) -> Iterator[None]:
    """Deletes what is stored inside when it ends well, tables named kept excepted."""
    _scratch.append([])
    try:
        yield
        deleted(spark, (p for p in _scratch[-1] if not p.rsplit("/", 1)[1].startswith(f"{kept}-")))
    finally:
        _scratch.pop()


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside use Arrow batches of at most so many rows; afterwards the session's setting is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, rows: int = 2000, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, so a lost executor costs no earlier work.

    rows bounds the Arrow batches of Python steps on the way.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with batch_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored: it does so when the driver collects its garbage."""
    for _ in range(2):  # the first round lets go of what Python holds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Gives the system back what has been freed: Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        give(0)


def release_memory() -> None:
    """trim(), once unreachable objects are gone: after training."""
    gc.collect()
    trim()


def held_out(doc_id: Column) -> Column:
    """True for rows that no training step may see."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT


def spread(text: Column, most: int, spans: int) -> Column:
    """text, or of one of more than so many characters that many in spans, evenly spread from the first to the last."""
    each = most // spans
    place = lambda i: (1 + F.floor((F.length(text) - each) * i / (spans - 1))).cast("int")
    return F.when(text.isNull() | (F.length(text) <= most), text).otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(spans - 1)), lambda i: F.substring(text, place(i), F.lit(each)))))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column holds about most_bytes in each (a single longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = text_bytes(batch.column(column))
        block = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
    trim()


def strings(a: pa.Array) -> list:
    """The array's values, by way of an object array, which is many times faster than to_pylist()."""
    return a.to_numpy(zero_copy_only=False).tolist()


def fields(df: DataFrame, columns: Iterable[str]) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def text_bytes(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large strings, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(column), "").cast(pa.large_string())


def list_offsets(col: pa.Array) -> np.ndarray:
    """Offsets of a list array, from 0, also where it is a slice."""
    off = col.offsets.to_numpy().astype(np.int64)
    return off - off[0]


def crc_of_ids(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    return np.fromiter((zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(offsets) - 1)


def ids_crc32(df: DataFrame, column: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """df with the list of ids replaced by its checksum."""
    kept = [c for c in df.columns if c != column]

    def digest(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(column))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(crc_of_ids(col.flatten().to_numpy(), list_offsets(col)))], names=[*kept, out])

    return df.mapInArrow(digest, f"{fields(df, kept)}, {out} long")


def splitmix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
