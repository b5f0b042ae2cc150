"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) to a DataFrame; run() has every stage's result as Parquet in the shared
folder and reads it from there for the next. The first two stages write theirs themselves, as their last step sends texts
through Python, in Arrow batches that are bounded there (ROWS) whatever the session says; the others end in joins. All
stages but the last return the columns of documents.

Defined results: a stage judges rows, never all rows of a doc_id: rows with a null doc_id, and rows that repeat a doc_id
with other texts, stay or go by their own text. Columns beyond those of documents pass through. Empty tables give empty
results; without labelled rows no row is toxic, and without rows in a language no language can be told.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskgrid.llm import common, decontaminate, language_id, packing, simhash, toxicity

#: A document goes if its toxicity is at least this.
TOXIC = 0.5
#: Near duplicates: distinct 5-word shingles in 512-bit fingerprints. Texts with a Jaccard similarity of 0.8 differ in 15 %
#: of bits on average (cosine 2 * 0.8 / 1.8); 84 bits are 16 %. Nor can one have fewer than 0.8 of the other's shingles.
SHINGLE, WORDS, RADIUS, SIMILARITY = 5, 8, 84, 0.8
TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Rows of an Arrow batch that holds texts.
ROWS = 1000


def _folded(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one, so that none clashes with a column that an operator adds."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("others"))


def _unfolded(docs: DataFrame, folded: DataFrame) -> DataFrame:
    return folded.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told (null texts and texts without a letter can't be)."""
    model = language_id.fit_on(docs)
    return common.stored(_unfolded(docs, language_id.identify(_folded(docs), model).where("lang_pred <> 'und'")), "language", ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, trained on labelled ones among them, holds toxic."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.stored(_unfolded(docs, toxicity.score(_folded(docs), model, TOXIC).where("predicted = 0")), "toxicity", ROWS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies keeps one row: that with the smallest doc_id, null doc_ids coming last."""
    return simhash.first_copies(docs, SHINGLE, RADIUS, WORDS, SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or edited. A row is looked for by a hash of doc_id and text."""
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.leaks(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaking = common.stored(found.select(F.col("doc_id").alias("_row")).distinct(), "leaking")
    return docs.join(leaking, row == F.col("_row"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of what is left, with its ids and its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: Stages whose result is written when they return.
WRITTEN = (identify_language, drop_toxic)
#: No stage is something that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What else a stage stores on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.scratch(spark, name):
            docs = stage(spark, docs, sf_dir)
            if stage not in WRITTEN:
                docs = common.stored(docs, name)
    return docs
