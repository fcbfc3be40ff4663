"""Operator 2: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is text whose lines may begin with a speaker marker ("User: ...", "### Assistant",
"[system] ...").  A state is a role together with whether the line begins a turn or goes on with it.
A line's observations are the role that its marker names (or none), whether a blank line stands
before it, its length class, and whether it ends in a question mark.  All probabilities are counts
with add-one smoothing over the labelled lines of conversations outside the held-out fold: a table
of bounded size, summed in Spark.  Viterbi gives the most likely states; a marker is cut from a line
that begins a turn of the role it names, any other line keeps its text; turns are rendered as
``<|role|>``, the text, ``<|end|>``.

Long conversations come in parts of at most ``PART`` source rows, so that no task or output row is
unbounded.  The model is decoded across them: each part gives its table of best scores from state to
state, the tables of a conversation are combined in order, and each part is decoded between the
states that it must begin after and end in.  A part begins a turn, since a source row does.

Cases: null and empty texts are empty turns, which leave no line; a role outside the three counts
as no marker and teaches nothing; null turns come first; turns that tie are ordered by text; repeated
rows stay repeated; rows without a conv_id are left out; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.common import batch, crc_mod, rows_of, Scratch

ROLES = ("system", "user", "assistant")
PART = 256
#: Names that mark a speaker.
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "question", "q"), "assistant": ("assistant", "ai", "bot", "answer", "a")}
#: Marker styles of the raw transcripts.
STYLES = ("{}: ", "### {}\n", "[{}] ", "<{}> ", "**{}:** ")
_ALIASES = {name: role for role, names in NAMES.items() for name in names}
_NAME = "(" + "|".join(sorted(_ALIASES, key=len, reverse=True)) + ")"
_MARKER = re.compile(rf"^\s*(?:#{{1,4}}\s*{_NAME}\s*:?\s*$|\[{_NAME}\]\s*|<{_NAME}>\s*|\*\*{_NAME}:\*\*\s*|{_NAME}\s*:\s+)", re.IGNORECASE)
K = 2 * len(ROLES)  # states: role * 2, plus one for a line that goes on
MARKS, SIZES = len(ROLES) + 1, 5
_FIRST = np.arange(K) % 2 == 0
_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("roles", pa.string()), ("rendered", pa.string())])
_TABLE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("best", pa.list_(pa.float64()))])


def marker(line: str) -> tuple[int, str]:
    """The number of the role that a line's marker names (-1: none), and the line without it."""
    found = _MARKER.match(line)
    return (ROLES.index(_ALIASES[next(filter(None, found.groups())).lower()]), line[found.end() :]) if found else (-1, line)


def observed(text: str) -> list[tuple[int, str, str]]:
    """(observation, line, line without its marker) of every line that is not blank.

    A marker alone on its line belongs to the line after it; with nothing after it but another marker, it
    is an empty turn and leaves nothing."""
    out, blank, held = [], False, None
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        mark, bare = marker(line)
        if mark >= 0 and not bare.strip():
            held = (mark, line)
            continue
        whole = line
        if held is not None and mark < 0:
            mark, whole, bare = held[0], f"{held[1]}\n{line}", line
        held = None
        size = min(SIZES - 1, int(math.log10(len(bare) + 1) * 2))
        out.append((((mark + 1) * 2 + blank) * SIZES * 2 + size * 2 + bare.rstrip().endswith("?"), whole, bare))
        blank = False
    return out


OBSERVATIONS = MARKS * 2 * SIZES * 2


def viterbi(model: dict, seen: list[int], entry: int | None = None, end: int | None = None) -> tuple[list[int], float]:
    """The best states of a part's lines and their score.  ``entry``: the state before the part (none:
    the conversation begins); ``end``: the state that the last line must have."""
    score = (model["start"] if entry is None else np.where(_FIRST, model["trans"][entry], -np.inf)) + model["emit"][:, seen[0]]
    back = []
    for o in seen[1:]:
        step = score[:, None] + model["trans"]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + model["emit"][:, o]
    path = [int(score.argmax()) if end is None else end]
    best = float(score[path[0]])
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best


def part_table(model: dict, seen: list[int]) -> np.ndarray:
    """Best score of a part from each state before it to each state of its last line; of the first part
    of a conversation every row is the same, from the start.  A part without lines changes nothing."""
    if not seen:
        return np.where(np.eye(K, dtype=bool), 0.0, -np.inf)
    score = np.where(_FIRST, model["trans"], -np.inf) + model["emit"][:, seen[0]]
    for o in seen[1:]:
        score = (score[:, :, None] + model["trans"]).max(axis=1) + model["emit"][:, o]
    return score


def turns_of(states: list[int], lines: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns: list[tuple[str, list[str]]] = []
    for state, (o, whole, bare) in zip(states, lines, strict=True):
        role, goes_on = ROLES[state // 2], state % 2
        named = o // (4 * SIZES) - 1
        if goes_on and turns:
            turns[-1][1].append(whole)
        else:
            turns.append((role, [bare if named == state // 2 else whole]))
    return [(role, "\n".join(text).strip()) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def decode(model: dict, text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole transcript."""
    lines = observed(text)
    return turns_of(viterbi(model, [o for o, _, _ in lines])[0], lines) if lines else []


def raw_parts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, parts, roles, pieces): transcripts in one of the marker styles, by a hash of conv_id;
    one turn in four has a blank line in place of its marker.

    Rows are numbered in two steps, in blocks of turn numbers and by running counts of the blocks."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block"))
    blocks = blocks.withColumn("before", running - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("conv_id"))).drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "text", "role")) - 1
    rows = rows.join(blocks, ["conv_id", "block"]).withColumn("at", F.col("before") + inside)
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    known = F.col("role").isin(*ROLES) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0)
    head = F.lit("\n")
    for i, s in enumerate(STYLES):
        before, after = s.split("{}")
        head = F.when(known & (style == i), F.concat(F.lit(before), F.initcap("role"), F.lit(after))).otherwise(head)
    rows = rows.select("conv_id", F.floor(F.col("at") / PART).alias("part"), F.ceil(F.col("all") / PART).alias("parts"), F.struct("at", "role", F.concat(head, "text").alias("piece")).alias("t"))
    return rows.groupBy("conv_id", "part", "parts").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "part", "parts", F.col("t.role").alias("roles"), F.col("t.piece").alias("pieces"))


def labelled_lines(roles: list[str | None], pieces: list[str]) -> list[tuple[int, int]] | None:
    """(state, observation) of a transcript whose turns are known; none if a line's turn is not."""
    out = []
    for k, (role, piece) in enumerate(zip(roles, pieces, strict=True)):
        lines = observed(piece if k == 0 else "\n" + piece if piece.startswith("\n") else piece)
        if lines and role not in ROLES:
            return None
        out += [(2 * ROLES.index(role) + (i > 0), o) for i, (o, _, _) in enumerate(lines)]
    return out


def fit(raw: DataFrame) -> dict:
    """Log-probabilities counted over the parts of ``raw``; partial counts leave the tasks."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for piece in rows_of(batches):
            for part, roles, pieces in zip(*(piece.column(c).to_pylist() for c in ("part", "roles", "pieces")), strict=True):
                lines = labelled_lines(roles, pieces)
                if not lines:
                    continue
                total.update((0, s, o) for s, o in lines)
                total.update((1, a[0], b[0]) for a, b in zip(lines, lines[1:]))
                if part == 0:
                    total[2, lines[0][0], 0] += 1
        if total:
            yield batch(schema, *(list(c) for c in zip(*((*k, n) for k, n in total.items()), strict=True)))

    rows = raw.select("part", "roles", "pieces").mapInArrow(count, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    emit, trans, start = np.full((K, OBSERVATIONS), 0.01), np.ones((K, K)), np.ones(K)
    for r in rows.collect():  # at most states times observations
        (emit, trans, start)[r["kind"]][(r["a"], r["b"]) if r["kind"] < 2 else r["a"]] += r["n"]
    trans[:, ~_FIRST] *= np.arange(K)[:, None] // 2 == np.arange(K)[None, ~_FIRST] // 2  # only its own role goes on
    start = start * _FIRST
    with np.errstate(divide="ignore"):
        return {"emit": np.log(emit / emit.sum(axis=1, keepdims=True)), "trans": np.log(trans / trans.sum(axis=1, keepdims=True)), "start": np.log(start / start.sum())}


def _borders(raw: DataFrame, model: dict) -> DataFrame:
    """(conv_id, part, entry, end): the states around each part of the conversations of several parts."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in rows_of(batches):
            found = [part_table(model, [o for o, _, _ in observed("\n".join(t))]) for t in piece.column("pieces").to_pylist()]
            yield batch(_TABLE, piece.column("conv_id"), piece.column("part"), [t.ravel().tolist() for t in found])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        best = np.stack(pdf["best"].to_list()).reshape(-1, K, K)
        # before the first line, every state stands for the start
        reached = [np.zeros(K)]
        for i, table in enumerate(best):
            reached.append((reached[-1][:, None] + table).max(axis=0))
        end, borders = int(reached[-1].argmax()), []
        for i in range(len(best) - 1, -1, -1):
            entry = int((reached[i] + best[i][:, end]).argmax())
            borders.append((entry, end))
            end = entry
        entry, end = zip(*borders[::-1], strict=True)
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "part": pdf["part"].to_numpy(), "entry": entry, "end": end})

    found = raw.where("parts > 1").select("conv_id", "part", "pieces").mapInArrow(tables, "conv_id long, part long, best array<double>")
    return found.groupBy("conv_id").applyInPandas(combine, "conv_id long, part long, entry int, end int")


def parse(raw: DataFrame, model: dict) -> DataFrame:
    """Decode (conv_id, part, parts, pieces) rows: n_turns, roles and the rendered turns."""
    rows = raw.select("conv_id", "part", "parts", "pieces").join(_borders(raw, model), ["conv_id", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in rows_of(batches):
            found = []
            for part, pieces, entry, end in zip(*(piece.column(c).to_pylist() for c in ("part", "pieces", "entry", "end")), strict=True):
                lines = observed("\n".join(pieces))
                states = viterbi(model, [o for o, _, _ in lines], entry if part else None, end)[0] if lines else []
                found.append(turns_of(states, lines))
            yield batch(_OUT, piece.column("conv_id"), piece.column("part"), [len(t) for t in found], [" ".join(r for r, _ in t) for t in found], [render(t) for t in found])

    return rows.mapInArrow(run, "conv_id long, part long, n_turns long, roles string, rendered string")


def chat_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation part: conv_id, part, held_out, n_turns, roles, rendered.  The model learns
    from the conversations whose crc32(conv_id as text) mod 4 is not 2."""
    scratch = Scratch(conversations.sparkSession, "op2")
    raw = scratch.save(raw_parts(conversations), "parts")
    fold = crc_mod(F.col("conv_id"), 4) == 2
    return parse(raw, fit(raw.where(~fold))).withColumn("held_out", fold).select("conv_id", "part", "held_out", "n_turns", "roles", "rendered")
