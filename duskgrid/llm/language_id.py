"""Language identification by a string kernel: blended-spectrum presence kernel, Nystroem landmarks, kernel ridge.

The kernel of two texts is the number of hashed character n-grams (1 to 4, over letters, words parted by one space)
that both hold, over the root of the product of how many each holds. A bounded sample of labelled rows is mapped onto
landmarks by that kernel; a one-versus-rest ridge regression is solved there. A text's decision values are a product of
its presence vector with (landmarks times coefficients), a matrix of n-grams by languages that is folded once; batches
of texts are scored by that product.

Defined results: lang_pred is `und` with score 0 if the text is null or has no letter, or if no labelled row exists; ties
go to the language first in alphabetical order; rows that repeat a doc_id and language are one training row (the least of
their texts), even if they fill their share of the sample; rows are never dropped; null doc_id passes through; other
columns pass through unless named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import fields, held_out, release_memory, slices, spread, strings, texts_of

GRAMS, BITS = 4, 16
#: Training sees, of each language, the first PER_SHARE rows by hash of each of SHARES shares of its labelled rows (448 at
#: most, so no task needs all rows of a language), TRAIN_CHARS of each (of a longer text SPANS stretches, evenly spread), and
#: takes LANDMARKS of them as landmarks.
SHARES, PER_SHARE, TRAIN_CHARS, SPANS, LANDMARKS = 64, 7, 6000, 6, 60
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  # n-grams by languages: normalised landmarks times ridge coefficients


def presence(texts: pa.Array):
    """Yields, for a few texts at a time, the first one's number and a 0/1 matrix: which text holds which hashed n-gram."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    lens = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lens)
    block = np.maximum(ends // 400_000, np.arange(len(lens)) // 64)  # bounds both characters and texts at a time
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lens)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        c = np.frombuffer("".join(strings(clean.slice(a, b - a))).encode("utf-32-le"), np.uint32).astype(np.uint64)
        doc = np.repeat(np.arange(b - a), lens[a:b])
        has = np.zeros((b - a, 1 << BITS), bool)
        h = np.zeros(len(c), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, GRAMS + 1):
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] + c[n - 1 :] * _MULT[n - 1]
                inside = doc[: len(h)] == doc[n - 1 :]
                key = (h ^ (h >> np.uint64(32)) ^ np.uint64(n)) * _MIX >> np.uint64(64 - BITS)
                has[doc[: len(h)][inside], key[inside].astype(np.int64)] = True
        yield a, has


def norms(has: np.ndarray) -> np.ndarray:
    """The root of how many n-grams each text holds."""
    return np.sqrt(np.maximum(has.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def fit(texts: list[str], langs: list[str], ridge: float = 1e-3, seed: int = 3) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    own = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    marks = np.concatenate([rng.permutation(np.flatnonzero(own == k))[:LANDMARKS] for k in range(len(names))])
    z = np.concatenate([has for _, has in presence(pa.array([texts[i] for i in marks], pa.large_string()))])
    size = norms(z)
    blocks = [slice(c, c + (1 << BITS) // 16) for c in range(0, 1 << BITS, (1 << BITS) // 16)]  # floats of a sixteenth at a time
    k = np.concatenate([sum(has[:, c].astype(np.float32) @ z[:, c].T.astype(np.float32) for c in blocks) / norms(has) / size.T for _, has in presence(pa.array(texts, pa.large_string()))]).astype(float)
    weight = (1 / np.bincount(own)[own])[:, None] * len(own) / len(names)  # languages count alike
    left = k.T @ (k * weight) + ridge * len(own) * k[marks] + 1e-8 * np.eye(len(marks))
    coef = np.linalg.solve(left, k.T @ ((own[:, None] == np.arange(len(names))) * weight))
    return Model(names, np.concatenate([z[:, c].T.astype(float) @ (coef / size) for c in blocks]).astype(np.float32))


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (-1: none) and score of each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.langs:
        return best, score
    for a, has in presence(texts):
        f = has.astype(np.float32) @ model.matrix / norms(has)
        best[a : a + len(f)], score[a : a + len(f)] = f.argmax(axis=1), np.clip(f.max(axis=1), 0, 1)
    best[~lettered], score[~lettered] = -1, 0
    return best, score


def fit_on(docs: DataFrame) -> Model:
    """Trains on a bounded sample of docs (doc_id, text, lang) outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.xxhash64("doc_id").alias("_h"))
    first = Window.partitionBy("_lang", F.pmod("_h", F.lit(SHARES))).orderBy("_h", "_id")
    few = labelled.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= PER_SHARE).select("_id", "_lang").distinct()
    # SHARES * PER_SHARE ids a language: bounded by the number of languages, so it may be broadcast
    met = docs.where(F.col("text").isNotNull()).withColumn("text", spread(F.col("text"), TRAIN_CHARS, SPANS)).join(F.broadcast(few), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    rows = met.groupBy("_id", "_lang").agg(F.min("text").alias("text")).toArrow()
    pairs = sorted(zip(rows["text"].to_pylist(), rows["_lang"].to_pylist(), strict=True))
    del rows
    model = fit([t for t, _ in pairs], [x for _, x in pairs])
    del pairs
    release_memory()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams by languages: a few MB at every input size

    def task(batches):
        names = pa.array([*shared.value.langs, "und"])
        for b in slices(batches, "text"):
            best, score = predict(shared.value, texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(task, f"{fields(docs, kept)}, lang_pred string, score double")
