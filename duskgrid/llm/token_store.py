"""Token-ID output: Parquet list columns with dictionary or delta encoding, in ascending document order.

File format, one row per document, sorted by (doc_id, text) over all part files:

    part long       part file number, ascending with doc_id
    row_start long  ids of the documents before this one in its part
    doc_id long
    n_tokens int
    ids array<int>  the text's ids and then the end id

Row groups and pages have the sizes asked for, and Parquet's column and offset indexes cover every page, so a reader
that wants metadata (or a doc_id range) never touches the ids it doesn't need. Ids are dictionary-encoded (bit-packed
indexes; the dictionary is bounded by the vocabulary) or delta-encoded.

Defined results: null text counts as empty (the end id alone); null doc_id sorts first; repeated doc_ids are kept, in
order of text; an empty table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import batch_rows, slices, texts_of
from duskgrid.llm.encode import encoder

SCHEMA = "part long, row_start long, doc_id long, n_tokens int, ids array<int>"
#: Bytes of text encoded at a time.
BATCH_BYTES = 6 << 20


def encode_sorted(batches, tokenizer_path: str, end_id: int):
    """Rows of SCHEMA for batches of (doc_id, text) that come in the order wanted."""
    part, done, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
    for b in slices(batches, "text", BATCH_BYTES):
        off, ids = enc.encode(texts_of(b, "text"))
        n = np.diff(off) + 1
        ends = np.cumsum(n)
        out = np.empty(ends[-1], np.int32)
        last = np.zeros(ends[-1], bool)
        last[ends - 1] = True
        out[last], out[~last] = end_id, ids
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(done + ends - n), b.column("doc_id"), pa.array(n.astype(np.int32)), lists], names=["part", "row_start", "doc_id", "n_tokens", "ids"])
        done += int(ends[-1])


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20) -> str:
    """Encodes docs (doc_id, text) and writes the store to path, a folder that all executors reach."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.withColumn("_t", F.xxhash64("text")).repartitionByRange("doc_id", "_t").sortWithinPartitions("doc_id", "_t", "text").select("doc_id", "text")
    writer = (
        ordered.mapInArrow(lambda it: encode_sorted(it, tokenizer_path, end_id), SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", encoding == "dictionary")
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .option("compression", "zstd")
    )
    with batch_rows(docs.sparkSession, 2500):
        writer.parquet(path)
    return path


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Leaving ids out leaves them unread."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row a part file: small at every size
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("row_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
