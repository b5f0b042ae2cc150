"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans.

A conversation's turns lie on a line by the prefix sums of their tokens, counted as they are written. The line is cut
into cells of half of what history and the conversation's system turn leave of the budget; a window holds the turns that
start in one cell (a turn longer than a cell has a window to itself, so turns are never cut). In front of its new turns a
window repeats the system turn and, within a limit, the turns just before, as far as the budget allows; only a turn that is
longer than the budget by itself exceeds it. A system turn that takes over half of what history leaves isn't repeated.
Only new assistant turns are under the loss mask, so every target counts once however often it is repeated.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `\\` becomes `\\\\` and `<|` becomes `<\\|`
(in roles a line feed becomes `\\n` too), so no text can pass for a mark, and reading undoes it exactly.

Prefix sums are two-level (within range partitions, then over partitions), windows are grouped by (conversation, cell):
a conversation with a third of all turns is spread over tasks like any other rows.

Defined results: null role or text is empty; null turn numbers sort first; equal turn numbers are ordered by role and
text; repeated rows are kept; rows with a null conv_id take no part; an empty table gives no window; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskgrid.llm.common import batch_rows, slices, stored, strings
from duskgrid.llm.encode import encoder

#: Tokens of a window, and of the history it repeats.
BUDGET, HISTORY = 2048, 512
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
WINDOWS = "conv_id long, window long, n_repeated int, n_tokens long, text string, loss_start array<int>, loss_end array<int>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """A turn as it is written: what leads to the text, the text, and what closes it."""
    return f"<|im_start|>{escape_role(role)}\n", escape(text), "<|im_end|>\n"


def turn_positions(convs: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, idx, at, role, text, n: every turn with its number and its first token's place in the conversation."""

    def task(batches):
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        conv, idx, at = None, 0, 0
        for b in slices(batches, "text"):
            written = ["".join(parts_of(r, t)) for r, t in zip(strings(b.column("role")), strings(b.column("text")), strict=True)]
            n = np.diff(enc.encode(pa.array(written, pa.large_string()))[0])
            ids = b.column("conv_id").to_numpy()
            new = np.ones(len(ids), bool)
            new[1:] = ids[1:] != ids[:-1]
            new[0] = conv is None or ids[0] != conv
            run = np.cumsum(new) - 1 if new[0] else np.cumsum(new)  # without a new first row, run 0 goes on from before
            starts = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
            upto = np.concatenate([[0], np.cumsum(n)])
            i = np.arange(len(ids)) - starts[run]
            a = upto[:-1] - upto[starts[run]]
            if not new[0]:
                first = run == 0
                i[first] += idx
                a[first] += at
            conv, idx, at = ids[-1], int(i[-1]) + 1, int(a[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(i), pa.array(a), b.column("role"), b.column("text"), pa.array(n.astype(np.int64))], names=["conv_id", "part", "idx", "at", "role", "text", "n"])

    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.withColumn("_h", F.xxhash64("role", "text")).repartitionByRange("conv_id", "turn", "_h").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    local = stored(ordered.mapInArrow(task, "conv_id long, part long, idx long, at long, role string, text string, n long"), "turns")
    sums = local.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = sums.select("conv_id", "part", F.sum("rows").over(earlier).alias("rows"), F.sum("tokens").over(earlier).alias("tokens")).where("rows > 0")
    return local.join(stored(before, "turns-before"), ["conv_id", "part"], "left").select("conv_id", (F.col("idx") + F.coalesce("rows", F.lit(0))).alias("idx"), (F.col("at") + F.coalesce("tokens", F.lit(0))).alias("at"), "role", "text", "n")


def format_windows(convs: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOWS of convs (conv_id, turn, role, text)."""
    if not 0 <= history <= budget - 4:
        raise ValueError("the history must leave some of the budget")
    most = (budget - history) // 2
    turns = turn_positions(convs, tokenizer_path)
    first = turns.where("idx = 0 and role = 'system'").where(F.col("n") <= most)
    turns = turns.join(first.select("conv_id", F.col("n").alias("head")), "conv_id", "left")
    cell = F.floor((F.lit(budget - history) - F.coalesce("head", F.lit(0))) / 2)
    turns = turns.withColumn("own", F.floor(F.col("at") / cell)).withColumn("last", F.floor((F.col("at") + history) / cell))
    # a window's number: twice its cell, and one more for a long turn, which starts last in its cell
    places = turns.withColumn("window", F.col("own") * 2 + (F.col("n") > cell).cast("long")).withColumn("new", F.lit(True))
    behind = turns.where(F.col("n") <= history).withColumn("window", F.explode(F.sequence(F.col("own") * 2 + 1, F.col("last") * 2 + 1))).withColumn("new", F.lit(False))
    one = F.struct("idx", "at", "role", "text", "n", "new")
    grouped = places.unionByName(behind).groupBy("conv_id", "window").agg(F.collect_list(one).alias("turns"), F.max("new").alias("some")).where("some").drop("some")
    system = first.select("conv_id", F.struct("role", "text", "n").alias("system"))

    def task(batches):
        for b in batches:
            out = []
            for conv, window, rows, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.sort(key=lambda r: (r["idx"], r["new"]))
                fresh = [r for r in rows if r["new"]]
                first, room = fresh[0], budget - sum(r["n"] for r in fresh)
                head = None if head is None or first["idx"] == 0 or head["n"] > room else head
                room -= head["n"] if head else 0
                unbroken = []
                for r in reversed([r for r in rows if not r["new"] and r["idx"] < first["idx"] and r["at"] >= first["at"] - history]):
                    if r["idx"] != first["idx"] - len(unbroken) - 1 or r["n"] > room or r["idx"] == 0 and head:
                        break  # only turns that follow each other without a hole
                    unbroken.append(r)
                    room -= r["n"]
                repeated = [*([head] if head else []), *unbroken[::-1]]
                starts, ends, parts, at = [], [], [], 0
                for k, r in enumerate([*repeated, *fresh]):
                    lead, body, close = parts_of(r["role"], r["text"])
                    if k >= len(repeated) and r["role"] == "assistant":
                        starts.append(at + len(lead))
                        ends.append(at + len(lead) + len(body))
                    parts.append(lead + body + close)
                    at += len(parts[-1])
                text = "".join(parts)
                out.append((conv, window, len(repeated), sum(r["n"] for r in [*repeated, *fresh]), text, starts, ends))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds, strict=True)], names=["conv_id", "window", "n_repeated", "n_tokens", "text", "loss_start", "loss_end"])

    return grouped.join(system, "conv_id", "left").select("conv_id", "window", "turns", "system").mapInArrow(task, WINDOWS)


def write_windows(convs: DataFrame, path: str, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> str:
    """Writes the windows of convs as Parquet to path, a folder that all executors reach."""
    windows = format_windows(convs, tokenizer_path, budget, history)
    with batch_rows(convs.sparkSession, 500):
        windows.write.option("compression", "zstd").parquet(path)
    return path


def parse(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """Role and text of a window's new turns."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)[n_repeated:]]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from a written folder alone.

    SHA-256 is sequential, so a conversation's windows stream, in order, through one task, which holds one at a time.
    """
    rows = spark.read.schema(WINDOWS).parquet(path).select("conv_id", "window", "n_repeated", "text", "loss_start", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def task(batches):
        now, out = None, []

        def done():
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

        for b in batches:
            for conv, _, repeated, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text, repeated):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, z in zip(starts, ends, strict=True):
                    target = unescape(text[a:z])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            if out:
                yield batch()
                out = []
        if now is not None:
            done()
            yield batch()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
