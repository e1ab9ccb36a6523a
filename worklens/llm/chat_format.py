"""Roles of transcript turns by a hidden Markov model, then canonical rendering.

The hidden states are the roles; a turn shows its speaker marker (``User:``, ``Assistant:`` and the
like), its length, its number of lines, whether it asks and whether it instructs. Start, transition
and emission probabilities are counts (plus one) over labelled turns of conversations that are
not held out; Viterbi gives each conversation's most likely roles. The given role is never
an input of a prediction.

Turns are sorted by conversation over range partitions, so that a conversation of any length
may lie across several. Of a conversation that crosses a border each part is reduced to the matrix of best scores from
the state before it to its last state; the parts' matrices (a few numbers for each partition)
are combined on the driver, and every part is then decoded between its fixed ends. The
result is that of Viterbi over the whole conversation.

Edge cases: turns without a number come last, turns of one number go by their text's hash; turns without a
conversation id are one conversation. A null text is empty and a turn like any other. Turns without a label do not
count in training; without any labelled turn every role is ``unknown``. Repeated rows are turns of their own. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import partitions, rows_of, ship, stage, table

ship(__name__)

MARKER = r"(?i)^\s*[#*>\[<|]*\s*(user|human|customer|question|q|assistant|bot|ai|model|answer|a|system|instructions?)\s*[\]>|*]*\s*[:>]+\s*"
GROUPS = {1: ("user", "human", "customer", "question", "q"), 2: ("assistant", "bot", "ai", "model", "answer", "a"), 3: ("system", "instruction", "instructions")}
#: Values of each feature.
SIZES = (4, 16, 9, 2, 2)
#: A table with more labelled roles than this is refused, as the model grows with their square.
MOST_ROLES = 256
UNKNOWN = "unknown"


def features(text: Column) -> Column:
    said = F.lower(F.regexp_extract(text, MARKER, 1))
    marker = F.lit(0)
    for code, words in GROUPS.items():
        marker = F.when(said.isin(*words), code).otherwise(marker)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.array(marker, F.least(F.floor(F.log2(F.length(text) + 1.0)), F.lit(15)).cast("int"), F.least(lines, F.lit(8)).cast("int"),
                   text.contains("?").cast("int"), text.rlike(r"(?i)^\s*(you are|you must|always|never|be )").cast("int"))


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (what, role, value, n) over turns in order: starts, steps and shown features."""
    n: Counter = Counter()
    for batch in batches:
        for conv, role, shown, before, follows, held in rows_of(batch):
            if held or role is None:
                continue
            if not follows:
                n["start", role, ""] += 1
            elif before is not None:
                n["step", before, role] += 1
            for i, v in enumerate(shown):
                n[f"f{i}", role, str(v)] += 1
    rows = [(*k, c) for k, c in n.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["what", "role", "value", "n"])


class Model:
    def __init__(self, counts: dict[tuple[str, str, str], int]):
        total = Counter()
        for (what, role, _), c in counts.items():
            total[role] += c * (what == "f0")
        self.roles = sorted(total)
        if len(self.roles) > MOST_ROLES:
            raise ValueError(f"more than {MOST_ROLES} roles are labelled")
        get = lambda what, role, value: counts.get((what, role, value), 0) + 1.0
        log = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
        self.start = log(np.array([get("start", r, "") for r in self.roles])) if self.roles else None
        self.step = log(np.array([[get("step", a, b) for b in self.roles] for a in self.roles])) if self.roles else None
        self.shown = [log(np.array([[get(f"f{i}", r, str(v)) for v in range(size)] for r in self.roles])) for i, size in enumerate(SIZES)] if self.roles else None

    def emission(self, shown) -> np.ndarray:
        return sum(t[:, v] for t, v in zip(self.shown, shown, strict=True))

    def through(self, turns) -> np.ndarray:
        """Best score from each state before the turns (rows; the last row: from the start) to each last state."""
        best = None
        for shown in turns:
            move = np.vstack([self.step, self.start]) if best is None else (best[:, :, None] + self.step[None]).max(axis=1)
            best = move + self.emission(shown)
        return best

    def decode(self, turns, before: int | None = None, last: int | None = None) -> list[int]:
        """The most likely states, after a given state and up to a given last one; ties go to the first state."""
        score, back = None, []
        for shown in turns:
            if score is None:
                score = (self.start if before is None else self.step[before]) + self.emission(shown)
            else:
                moves = score[:, None] + self.step
                back.append(moves.argmax(axis=0))
                score = moves.max(axis=0) + self.emission(shown)
        state = int(score.argmax()) if last is None else last
        path = [state]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def crossing(borders: list[tuple[int, str, str]]) -> list[list[int]]:
    """Runs of partitions that share a conversation, from (part, first, last conversation) in order."""
    runs: list[list[int]] = []
    for (p, _, last), (q, first, _) in zip(borders, borders[1:], strict=False):
        if last == first:
            if runs and runs[-1][-1] == p and borders[[b[0] for b in borders].index(p)][1] == last:
                runs[-1].append(q)
            else:
                runs.append([p, q])
    return runs


def ends_of(model: Model, matrices: list[np.ndarray]) -> list[int]:
    """The last state of each part of a conversation, given the parts' matrices in order."""
    score, back = matrices[0][-1], []
    for m in matrices[1:]:
        moves = score[:, None] + m[:-1]
        back.append(moves.argmax(axis=0))
        score = moves.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def ordered(turns: DataFrame) -> DataFrame:
    """Turns sorted by conversation, with the key ``conv``, the partition ``part`` and the place ``at`` in it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-"))
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), conv.alias("conv"), features(text).alias("shown"), F.xxhash64(text).alias("h"))
    order = ["conv", F.asc_nulls_last("turn"), "h"]
    return stage(rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("h"))


def parse(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and role_pred of every row of (conv_id, turn, role, text)."""
    from pyspark.sql import Window
    spark = turns.sparkSession
    rows = ordered(turns)
    edge = (rows.groupBy("part").agg(F.min_by("conv", "at").alias("first"), F.max_by(F.struct("conv", "role"), "at").alias("end"))
            .select("part", "first", F.col("end.conv").alias("last"), F.col("end.role").alias("role")).orderBy("part").collect())
    place = Window.partitionBy("part").orderBy("at")  # a partition is one task's rows already
    # the first turn of a partition follows the last one of the partition before it
    earlier = {b["part"]: a for a, b in zip(edge, edge[1:], strict=False)}
    of_part = lambda field: F.get(F.array(*[F.lit(earlier[p][field] if p in earlier else None) for p in range(max((r["part"] for r in edge), default=-1) + 1)]).cast("array<string>"), F.col("part"))
    opens = F.row_number().over(place) == 1
    before = lambda column, field: F.when(opens, of_part(field)).otherwise(F.lag(column).over(place))
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    lagged = rows.select("conv", "role", "shown", before("role", "role").alias("before"),
                         F.coalesce(before("conv", "last") == F.col("conv"), F.lit(False)).alias("follows"), held.alias("held"))
    counted = lagged.mapInArrow(tally, "what string, role string, value string, n long").groupBy("what", "role", "value").agg(F.sum("n").alias("n"))
    counts = {(r["what"], r["role"], r["value"]): r["n"] for r in counted.collect()}
    model = Model(counts)
    out = "conv_id {}, turn {}, role string, text string, role_pred string".format(*[turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")])
    if not model.roles:
        return rows.select("conv_id", "turn", "role", "text", F.lit(UNKNOWN).alias("role_pred"))
    runs = crossing([tuple(r)[:3] for r in edge])
    by_part = {r["part"]: r for r in edge}
    shared = {(p, by_part[p]["last" if i == 0 else "first"]): k for k, run in enumerate(runs) for i, p in enumerate(run)}
    fixed: dict[tuple[int, str], tuple[int | None, int]] = {}
    if shared:
        wanted = F.array(*[F.lit(f"{p}/{c}") for p, c in shared])

        def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
            m = model.through(pdf.sort_values("at")["shown"])
            return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "conv": [pdf["conv"].iloc[0]], "m": [m.astype("<f8").tobytes()]})

        found = (rows.select("part", "conv", "at", "shown").where(F.array_contains(wanted, F.concat_ws("/", "part", "conv")))
                 .groupBy("part", "conv").applyInPandas(matrix, "part int, conv string, m binary").collect())
        known = {(r["part"], r["conv"]): np.frombuffer(r["m"], dtype="<f8").reshape(-1, len(model.roles)) for r in found}
        for run in runs:
            keys = [next(k for k in shared if k[0] == p and shared[k] == runs.index(run)) for p in run]
            before = None
            for key, last in zip(keys, ends_of(model, [known[k] for k in keys]), strict=True):
                fixed[key] = (before, last)
                before = last

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        states = []
        for conv, group in groupby(zip(pdf["conv"], pdf["shown"], strict=True), key=lambda x: x[0]):
            states += model.decode([s for _, s in group], *fixed.get((int(pdf["part"].iloc[0]), conv), (None, None)))
        pdf["role_pred"] = [model.roles[s] for s in states]
        return pdf[["conv_id", "turn", "role", "text", "role_pred"]]

    return rows.groupBy("part").applyInPandas(decode, out)


def render(role: Column, text: Column) -> Column:
    """The canonical turn: role, text without its marker, end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(text, MARKER, "")), F.lit("\n<|end|>"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return parsed.select("conv_id", "turn", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))
