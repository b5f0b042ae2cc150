"""Toxicity by subword-bag embeddings: n-gram vectors averaged over a window of words into a linear softmax.

Every word is the bag of its hashed character n-grams (between boundary marks) and itself, so a misspelling or a new
form of a word shares most vectors with the known one. Vectors and softmax are trained jointly, in numpy on the driver,
on a bounded sample of labelled rows. A document is as toxic as its most toxic window, so a few words in a long text
still count; training therefore treats labels as being about some window of a document. It starts from the windows of toxic
documents that hold a word more bound to toxic documents than words are to documents under shuffled labels, and then
keeps those the model itself holds toxic. Toxic windows are repeated until they are a fair share, and batches are the
smaller, and passes the more, the fewer rows there are. A document with no such window teaches only through others.

Scoring needs no vectors: a window's logit is the mean of per-n-gram numbers (vector times softmax weights), which are
summed once for each distinct word.

Defined results: null, empty or wordless text scores 0 (to 12 digits); rows are never dropped; null doc_id passes
through; without labelled rows of both kinds every score is 0; a doc_id labelled both ways counts as toxic, and rows that
repeat a doc_id are one training row (the least of their texts); other columns pass through unless named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskgrid.llm.common import fields, held_out, release_memory, slices, spread, texts_of, trim
from duskgrid.llm.words import CHUNK, ragged, word_ngrams, words_of

SIZES = (3, 4, 5, 6)
WINDOW, STRIDE = 8, 4
#: Labelled rows that training sees at most, of each kind, and the characters of each: of a longer text SPANS stretches,
#: evenly spread from its first to its last character.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS, SPANS = 2000, 3200, 10_000, 10
#: Training steps wanted of a pass over its windows, passes at least and at most, and clean windows for a toxic one.
STEPS, LEAST_PASSES, MOST_PASSES, CLEAN_EACH = 500, 3, 12, 8
#: Logit of a text in which there is nothing to read.
WORDLESS = -40.0
#: Words whose numbers a worker remembers.
CACHE_WORDS = 150_000


@dataclass
class Model:
    ngram: np.ndarray  # what each n-gram adds to the logit, over the window's number of n-grams
    bias: float
    buckets_log2: int
    slope: float = 1.0  # from a document's highest window logit to its own logit
    shift: float = 0.0


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of every window; a text of no more than WINDOW words has one, an empty text none."""
    n = np.diff(off)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    first = off[doc] + (ragged(np.zeros(len(n), np.int64), many) * STRIDE)
    return doc, first, np.minimum(first + WINDOW, off[doc + 1])


def fit(texts: list[str], toxic: np.ndarray, dim: int = 8, buckets_log2: int = 19, seed: int = 7) -> Model:
    """Trains on texts and their 0/1 labels."""
    toxic = np.asarray(toxic)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Model(np.zeros(1 << buckets_log2), -30.0, buckets_log2)
    rng = np.random.default_rng(seed)
    off, code, words = coded(texts)
    goff, grams = word_ngrams(words, SIZES, buckets_log2)
    release_memory()
    doc, first, end = windows(off)
    label = toxic[doc]
    vectors = rng.uniform(-1, 1, (1 << buckets_log2, dim)).astype(np.float32) / dim
    weights, bias = rng.normal(0, 1, (dim, 2)), np.zeros(2)
    sums = [np.full_like(vectors, 1e-6), np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)]

    def train(toxic_ones: np.ndarray, clean_ones: np.ndarray, rate: float) -> None:
        again = int(np.clip(len(clean_ones) // (CLEAN_EACH * max(1, len(toxic_ones))), 1, 40))
        rows = np.concatenate([np.repeat(toxic_ones, again), clean_ones])
        target = np.concatenate([np.ones(len(toxic_ones) * again, int), np.zeros(len(clean_ones), int)])
        batch = int(np.clip(len(rows) // 64, 64, 1024))
        for _ in range(int(np.clip(STEPS * batch // max(1, len(rows)), LEAST_PASSES, MOST_PASSES))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                pick = rows[order[a : a + batch]]
                y = target[order[a : a + batch]]
                w = code[ragged(first[pick], end[pick] - first[pick])]
                size = goff[w + 1] - goff[w]
                ids = grams[ragged(goff[w], size)]
                upto = np.concatenate([[0], np.cumsum(size)])
                words_upto = np.concatenate([[0], np.cumsum(end[pick] - first[pick])])
                cut = upto[words_upto]
                count = np.diff(cut)[:, None]
                mean = np.add.reduceat(vectors[ids], cut[:-1], axis=0) / count
                z = mean @ weights + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ weights.T) / count
                own = np.repeat(np.arange(len(y)), count[:, 0])
                seen, inverse = np.unique(ids, return_inverse=True)
                grad = np.stack([np.bincount(inverse, weights=back[own, d], minlength=len(seen)) for d in range(dim)], axis=1)
                sums[0][seen] += grad**2
                vectors[seen] -= rate * grad / np.sqrt(sums[0][seen])
                for k, (value, g) in enumerate(((weights, mean.T @ p), (bias, p.sum(axis=0))), 1):
                    sums[k] += g**2
                    value -= 0.3 * rate * g / np.sqrt(sums[k])

    def some(rows: np.ndarray, n: int) -> np.ndarray:
        return rows if len(rows) <= n else rng.choice(rows, n, replace=False)

    def numbers() -> Model:
        return Model(vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]), buckets_log2)

    pos, neg = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    bound = bound_to(off, code, len(words), toxic, first, end)
    shuffled = rng.permutation(toxic)
    chance = np.full(len(toxic), -np.inf)
    np.maximum.at(chance, doc, bound_to(off, code, len(words), shuffled, first, end))
    start = pos[bound[pos] > np.quantile(chance[(shuffled == 1) & (np.diff(off) > 0)], 0.9)] if ((shuffled == 1) & (np.diff(off) > 0)).any() else pos
    train(some(start if len(start) else pos, 20_000), some(neg, 30_000), 0.15)
    for _ in range(2):
        p = _sigmoid(highest(numbers(), off, code, words)[1])
        sure, never = pos[p[pos] >= 0.5], pos[p[pos] < 0.1]
        hard = neg[np.argsort(-p[neg], kind="stable")[:15_000]]
        train(some(sure, 20_000), np.concatenate([some(never, 10_000), hard, some(neg, 20_000)]), 0.15)
    model = numbers()
    z = highest(model, off, code, words)[0]
    return calibrated(model, z[z > WORDLESS], toxic[z > WORDLESS])


def bound_to(off: np.ndarray, code: np.ndarray, words: int, toxic: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each window the highest z, over its words, of how many toxic documents hold the word beyond the expected number."""
    doc, word = np.divmod(np.unique(np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off)) * words + code), max(1, words))
    n, held = np.bincount(word, minlength=words), np.bincount(word, weights=toxic[doc], minlength=words)
    share = toxic.mean()
    z = ((held - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9)))[code]
    out = np.full(len(first), -np.inf)
    for i in range(WINDOW):
        at = np.flatnonzero(first + i < end)
        out[at] = np.maximum(out[at], z[first[at] + i])
    return out


def coded(texts: list[str], step: int = 256) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """words_of(texts), a few texts at a time."""
    index: dict[str, int] = {}
    sizes, codes = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for i in range(0, len(texts), step):
        off, code, words = words_of(pa.array(texts[i : i + step], pa.large_string()))
        own = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
        sizes.append(np.diff(off))
        codes.append(own[code])
    return np.cumsum(np.concatenate(sizes)), np.concatenate(codes), list(index)


def calibrated(model: Model, z: np.ndarray, toxic: np.ndarray) -> Model:
    """model with the slope and shift that make its document scores probabilities (logistic regression by Newton steps)."""
    a = np.zeros(2)
    x = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(30):
        p = _sigmoid(x @ a)
        grad = x.T @ (p - toxic) + 1e-3 * a
        a -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return replace(model, slope=float(max(a[0], 1e-3)), shift=float(a[1]))


def word_numbers(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its n-grams' numbers, and how many they are."""
    total, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
    for i in range(0, len(words), CHUNK):
        off, grams = word_ngrams(words[i : i + CHUNK], SIZES, model.buckets_log2)
        total[i : i + CHUNK], count[i : i + CHUNK] = np.add.reduceat(model.ngram[grams], off[:-1], dtype=float), np.diff(off)
    return total, count


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def window_logits(model: Model, code: np.ndarray, words: list[str], first: np.ndarray, end: np.ndarray, numbers=None) -> np.ndarray:
    total, count = numbers or word_numbers(model, words)
    t, c = (np.concatenate([[0.0], np.cumsum(x[code])]) for x in (total, count))
    return (t[end] - t[first]) / np.maximum(c[end] - c[first], 1) + model.bias


def highest(model: Model, off: np.ndarray, code: np.ndarray, words: list[str], numbers=None) -> tuple[np.ndarray, np.ndarray]:
    """The highest window logit of each text (WORDLESS for a text without words), and all window logits."""
    doc, first, end = windows(off)
    z = window_logits(model, code, words, first, end, numbers)
    out = np.full(len(off) - 1, WORDLESS)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(starts):
        out[doc[starts]] = np.maximum.reduceat(z, starts)
    return out, z


def scores(model: Model, texts: pa.Array, cache: dict | None = None) -> np.ndarray:
    """The toxicity of each text, from its highest window."""
    off, code, words = words_of(texts)
    numbers = word_numbers(model, words) if cache is None else _remembered(model, words, cache)
    z = highest(model, off, code, words, numbers)[0]
    return _sigmoid(np.where(z > WORDLESS, z * model.slope + model.shift, WORDLESS))


def _remembered(model: Model, words: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    fresh = [w for w in words if w not in cache]
    total, count = word_numbers(model, fresh)
    cache.update(zip(fresh, zip(total.tolist(), count.tolist(), strict=True), strict=True))
    both = np.array([cache[w] for w in words], float).reshape(len(words), 2)
    return both[:, 0], both[:, 1]


def training_rows(docs: DataFrame, labels: DataFrame, per_label: dict[int, int], max_chars: int) -> DataFrame:
    """text, toxic: a bounded sample, by hash of doc_id, of labelled rows outside the held-out fold."""
    ids = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(*per_label)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    parts = [ids.where(F.col("_toxic") == v).orderBy(F.xxhash64("_id"), "_id").limit(n) for v, n in per_label.items()]
    few = parts[0]
    for p in parts[1:]:
        few = few.union(p)
    # at most sum(per_label) rows of two numbers: bounded, so it may be broadcast
    met = docs.select("doc_id", spread(F.col("text"), max_chars, SPANS).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return met.groupBy("_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic")).select("text", "toxic")


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_rows(docs, labels, {1: TOXIC_ROWS, 0: CLEAN_ROWS}, TRAIN_CHARS).toArrow()
    rows = sorted(zip(sample["text"].to_pylist(), sample["toxic"].to_pylist(), strict=True))  # the order of arrival must not matter
    del sample
    texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows], int)
    del rows
    model = fit(texts, toxic)
    del texts
    release_memory()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket: 4 MB at every input size

    def task(batches):
        cache: dict = {}
        for b in slices(batches, "text", 2 << 20):
            s = scores(shared.value, texts_of(b, "text"), cache)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])
        cache.clear()
        trim()

    return docs.select(*kept).mapInArrow(task, f"{fields(docs, kept)}, score double, predicted int")
