"""Best-fit packing by linear grouping: documents' token pieces into as few sequences as possible.

Only how many pieces there are of each length matters for a plan, and lengths have no more values than a sequence has
places. So the plan is made on the driver from that histogram alone (bounded by the capacity, whatever the corpus):

1. large lengths are put, longest first, into groups of equal cardinality and rounded up to the longest of the group;
2. for these few sizes, configurations (how many of each size share a sequence) are optimised as a linear programme
   by column generation: a knapsack finds the best configuration at the current prices until none improves; the
   solution is rounded down;
3. the actual lengths take the places of their group's size, which leaves room;
4. what is left, large rests first and then the small lengths, goes best-fit, longest first, into that room.

The plan says, for every length, which sequence and offset its r-th piece gets. Pieces are numbered within their
length by counts per part and length, so the assignment is a join on small keys and a look-up, without any task
seeing all pieces of a length.

Defined results: null text counts as empty (the end id alone); null doc_ids and repeated rows are kept, each row being
a document of its own; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import slices, stored, texts_of, trim
from duskgrid.llm.encode import encoder
from duskgrid.llm.words import ragged

PIECES = "part long, rank long, doc_id long, piece int, start long, length long, ids array<int>"
#: Segments that the encoder may remember here.
SEGMENTS = 300_000
#: Number of groups, and the shares of the capacity beyond which a length is large; the best plan among them is taken.
GROUPS, LARGE = 80, (1 / 3, 1 / 8)


@dataclass
class Plan:
    """Row i: pieces of a length with ranks from rank[i] fill sequences seq[i], seq[i] + 1, ..., each[i] in each, from offset[i]."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    sequences: int


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """Configurations and how often each is used, from the linear programme's optimum rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    used = demand / np.diag(columns)
    for _ in range(rounds):
        prices = np.linalg.solve(columns.T, np.ones(k))
        config, value = knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, config.astype(float))
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        used = np.maximum(used - t * step, 0)
        used[out] = t
        columns[:, out] = config
    return [(int(n + 1e-6), columns[:, i].astype(int)) for i, n in enumerate(used) if n + 1e-6 >= 1]


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes within the capacity with the highest total price."""
    best = np.zeros(capacity + 1)
    took = []
    for s, v in zip(sizes.tolist(), prices.tolist(), strict=True):
        count = np.zeros(capacity + 1, np.int32)
        if v > 0:
            n = 1
            while n * s <= capacity:  # copies in powers of two, the last round included, make every multiplicity
                other = best[: capacity + 1 - n * s] + n * v
                better = other > best[n * s :] + 1e-12
                moved = count[: capacity + 1 - n * s] + n
                best[n * s :] = np.where(better, other, best[n * s :])
                count[n * s :] = np.where(better, moved, count[n * s :])
                n *= 2
        took.append(count)
    config, room = np.zeros(len(sizes), np.int64), int(best.argmax())
    for i in range(len(sizes) - 1, -1, -1):
        config[i] = took[i][room]
        room -= config[i] * int(sizes[i])
    return config, float(config @ prices)


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """A packing of counts[l] pieces of each length l (0 < l <= capacity) into sequences of at most capacity."""
    return min((grouped_plan(counts, capacity, share) for share in LARGE), key=lambda p: p.sequences)


def grouped_plan(counts: np.ndarray, capacity: int, large_share: float) -> Plan:
    counts = counts.astype(np.int64).copy()
    made: list[list] = []  # alike sequences: [how many, room, runs of (length, each), parent or -1]
    large = np.arange(capacity, int(capacity * large_share), -1)
    large = large[counts[large] > 0]
    if len(large):
        ends = np.cumsum(counts[large])
        group = np.minimum((ends - 1) * GROUPS // ends[-1], GROUPS - 1)  # by the last piece of each length
        names, at = np.unique(group, return_inverse=True)
        sizes = np.array([large[at == g].max() for g in range(len(names))])
        demand = np.array([counts[large[at == g]].sum() for g in range(len(names))], float)
        runs = [[[int(x), int(counts[x])] for x in large[at == g]] for g in range(len(names))]
        for times, config in configurations(sizes, demand, capacity):
            fill = [g for g in range(len(sizes)) for _ in range(config[g])]
            while times and all(sum(n for _, n in runs[g]) for g in set(fill)):
                step, took = times, []
                need: dict[tuple[int, int], int] = {}
                heads = {g: list(runs[g]) for g in set(fill)}
                for g in fill:  # the head run of a group serves its slots; its rest bounds how many sequences are alike
                    while heads[g] and heads[g][0][1] - need.get((g, heads[g][0][0]), 0) <= 0:
                        heads[g].pop(0)
                    if not heads[g]:
                        break
                    need[g, heads[g][0][0]] = need.get((g, heads[g][0][0]), 0) + 1
                    took.append(heads[g][0][0])
                else:
                    left = {(g, x): n for g in heads for x, n in runs[g]}
                    step = min([step, *(left[key] // n for key, n in need.items())])
                    for (g, x), n in need.items():
                        next(r for r in runs[g] if r[0] == x)[1] -= n * step
                        counts[x] -= n * step
                    runs = [[r for r in rs if r[1]] for rs in runs]
                    made.append([step, capacity - sum(took), sorted({x: took.count(x) for x in took}.items()), -1])
                    times -= step
                    continue
                break
    rooms: dict[int, list[int]] = {}
    for i, m in enumerate(made):
        rooms.setdefault(m[1], []).append(i)
    have = np.zeros(capacity + 1, bool)
    have[list(rooms)] = True
    for x in range(capacity, 0, -1):
        while counts[x]:
            fit = np.flatnonzero(have[x:])
            if not len(fit):  # new sequences, filled with this length
                each = capacity // x
                n = int(counts[x])
                for many, per in ((n // each, each), (1 if n % each else 0, n % each)):
                    if many:
                        made.append([many, capacity - per * x, [(x, per)], -1])
                        rooms.setdefault(capacity - per * x, []).append(len(made) - 1)
                        have[capacity - per * x] = True
                counts[x] = 0
                break
            room = x + int(fit[0])
            i = rooms[room].pop()
            have[room] = bool(rooms[room])
            many, each, n = made[i][0], room // x, int(counts[x])
            full = min(many, n // each)
            if full == 0:  # one sequence takes all that is left
                full, each = 1, n
            counts[x] -= full * each
            if full < many:  # the rest of these alike sequences stays as it was
                made.append([many - full, room, [], i])
                made.append([full, room - each * x, [(x, each)], i])
                made[i][0] = 0
                again = ((len(made) - 2, room), (len(made) - 1, room - each * x))
            else:
                made.append([full, room - each * x, [(x, each)], i])
                made[i][0] = 0
                again = ((len(made) - 1, room - each * x),)
            for j, r in again:
                rooms.setdefault(r, []).append(j)
                have[r] = True
    out, given, seq = [], np.zeros(capacity + 1, np.int64), 0
    for i, (many, *_rest) in enumerate(made):
        if not many:
            continue
        inside, j = [], i
        while j >= 0:
            inside += made[j][2]
            j = made[j][3]
        at = 0
        for x, each in reversed(inside):
            out.append((x, given[x], each, seq, at))
            given[x] += many * each
            at += x * each
        seq += many
    rows = np.array(out, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return Plan(*rows.T, seq)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """PIECES of docs (doc_id, text), written once: ids with the end id, cut only where longer than the capacity.

    rank numbers the pieces of a length within a part.
    """

    def task(batches):
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path, SEGMENTS)
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches, "text", 2 << 20):
            off, ids = enc.encode(texts_of(b, "text"))
            n = np.diff(off) + 1
            ends = np.cumsum(n)
            out = np.empty(ends[-1], np.int32)
            last = np.zeros(ends[-1], bool)
            last[ends - 1] = True
            out[last], out[~last] = end_id, ids
            cuts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = ragged(np.zeros(len(n), np.int64), cuts)
            length = np.minimum(n[doc] - piece * capacity, capacity)
            order = np.argsort(length, kind="stable")
            run = length[order]
            within = np.arange(len(run)) - np.searchsorted(run, run)
            rank = np.empty(len(run), np.int64)
            rank[order] = seen[run] + within
            seen += np.bincount(length, minlength=capacity + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part, np.int64)), pa.array(rank), b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), lists], names=["part", "rank", "doc_id", "piece", "start", "length", "ids"])
        enc.forget()  # the worker outlives the task, and later steps need the memory more
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(task, PIECES), "pieces", 2500)


def make_plan(cut: DataFrame, capacity: int) -> tuple[Plan, DataFrame]:
    """The plan for pieces (part, rank, length), and how many of a length lie in earlier parts."""
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: at most capacity
        totals[r["length"]] = r["n"]
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    return plan(totals, capacity), before


def place(cut: DataFrame, planned: Plan, before: DataFrame) -> DataFrame:
    """cut with sequence_id and offset instead of part and rank; all other columns stay."""
    kept = [c for c in cut.columns if c not in ("part", "rank")]
    runs: dict[int, list] = {}
    for length, *run in zip(planned.length.tolist(), planned.rank.tolist(), planned.each.tolist(), planned.seq.tolist(), planned.offset.tolist(), strict=True):
        runs.setdefault(length, []).append(tuple(run))
    table = cut.sparkSession.createDataFrame(list(runs.items()), "length long, _runs array<struct<rank:long,each:long,seq:long,offset:long>>")
    # a row a length, bounded by the capacity: it may be broadcast
    ranked = cut.join(before, ["part", "length"]).withColumn("_nth", F.col("rank") + F.col("before")).join(F.broadcast(table), "length")
    run = F.element_at(F.filter("_runs", lambda x: x["rank"] <= F.col("_nth")), -1)
    placed = ranked.withColumn("_run", run).withColumn("_nth", F.col("_nth") - F.col("_run.rank"))
    return placed.select(*kept, (F.col("_run.seq") + F.floor(F.col("_nth") / F.col("_run.each"))).alias("sequence_id"), (F.col("_run.offset") + F.col("_nth") % F.col("_run.each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece of docs and its place."""
    cut = pieces(docs, tokenizer_path, end_id, capacity)
    planned, before = make_plan(cut, capacity)
    return place(cut, planned, before)
