"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks, then turns are rendered alike.

A state is a role and whether the line begins a turn or goes on with one. Lines are observed by speaker marker, place, length and form.
Start, transition and emission counts, those of markers too, come from transcripts whose roles are known. Transcripts are decoded by Viterbi in
blocks of rows: for a transcript of several blocks, each block's best scores between entry and exit states form a small max-plus matrix; these
are multiplied up a tree of bounded fan-in, the best states are handed down it, and each block is then decoded between its fixed ends. So no
transcript has to meet in one task whatever its length, and the result is that of decoding it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, small_batches, written

ROLES = ("system", "user", "assistant", "tool")
#: Fixed words that can stand as speaker markers, lower case, by the role they are written for. Who a marker stands for is learnt.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "benutzer", "utilisateur", "usuario"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "agent", "model", "assistent", "asistente"),
    "tool": ("tool", "function", "observation"),
}
_NUMBER = {name: k for k, name in enumerate((n for role in ROLES for n in MARKERS[role]), 1)}
_MARKER = re.compile(r"^[ \t]*+(?:<\|?|\[|#{1,4}[ \t]*+|\*{1,2})?+[ \t]*+(" + "|".join(sorted(_NUMBER, key=len, reverse=True)) + r")[ \t]*+(?:\|?>|\]|\*{1,2}(?=:))?(?:[ \t]*+:(?:\*{1,2})?|(?<=[>\]]))[ \t]*+", re.IGNORECASE)
#: Fixed ways to write a marker.
SPELLINGS = ("{}: ", "{}:", "[{}] ", "**{}:** ", "### {}: ", "<|{}|> ")

#: States: 2 * role for the first line of a turn, 2 * role + 1 for a later line.
STATES = 2 * len(ROLES)
#: Rows in a block of a transcript, and matrices that meet in one group of the tree.
BLOCK_ROWS, FAN = 256, 64
#: Values of each observation: marker (none or which), place (after a blank line of its row, other), words by size, form.
SIZES = {"marker": len(_NUMBER) + 1, "place": 2, "words": 8, "form": 5}


def observe(lines: list[str]) -> np.ndarray:
    """Observations of the lines of one row, a row a line in the order of SIZES."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    blank = False
    for i, line in enumerate(lines):
        found = _MARKER.match(line)
        body = line[found.end() :] if found else line
        stripped = body.strip()
        form = 1 if stripped.endswith("?") else 2 if re.match(r"[-*•]|\d+[.)]", stripped) else 3 if stripped[:3] == "```" or body.startswith("    ") else 4 if not stripped else 0
        out[i] = _NUMBER[found[1].lower()] if found else 0, int(blank), min(7, len(body.split()).bit_length()), form
        blank = not stripped
    return out


@dataclass
class Speakers:
    """Log probabilities: of the first state, from state to state, and of each observation in each state."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T if len(seen) else np.zeros((0, STATES))

    def matrix(self, seen: np.ndarray, first: bool = False) -> np.ndarray:
        """Best score from each state before the block to each state of its last line; first: whatever comes before, a transcript starts here."""
        total = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for i, row in enumerate(self.scores(seen)):
            total = (np.tile(self.start, (STATES, 1)) if first and i == 0 else (total[:, :, None] + self.move[None]).max(axis=1)) + row
        return total

    def decode(self, seen: np.ndarray, entry: int = -1, leave: int = -1) -> np.ndarray:
        """The likeliest states, after state `entry` (-1: at the start of a transcript) and ending in `leave` (-1: in any). Ties go to the smaller state."""
        emit = self.scores(seen)
        if not len(emit):
            return np.zeros(0, np.int64)
        best = (self.start if entry < 0 else self.move[entry]) + emit[0]
        back = np.zeros((len(emit), STATES), np.int64)
        for i in range(1, len(emit)):
            reach = best[:, None] + self.move
            back[i] = reach.argmax(axis=0)
            best = reach.max(axis=0) + emit[i]
        path = [int(best.argmax()) if leave < 0 else leave]
        for i in range(len(emit) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return np.array(path[::-1])


def fit(turns: DataFrame, fold: tuple[int, int] | None = (5, 0), smooth: float = 0.5) -> Speakers:
    """Counts over the turns(conv_id, turn, role, text) whose role is one of ROLES, a row a turn as a transcript spells it, markers and all.

    Conversations of the held-out fold (crc32 of conv_id as text, modulo) teach nothing. A conversation starts with its least turn, and a turn is
    followed by the one numbered next, found by an equality join, so no conversation is gathered. Null texts are empty; without turns all is even.
    """
    small_batches(turns.sparkSession)
    known = turns.where(F.col("conv_id").isNotNull() & F.lower("role").isin(*ROLES)).select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if fold:
        known = known.where(crc_mod(F.col("conv_id"), fold[0]) != fold[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = 2 * ROLES.index(role)
                lines = text.split("\n")
                for i, row in enumerate(observe(lines)):
                    for k, value in enumerate(row.tolist()):
                        key = (state + (i > 0), k, value)
                        counts[key] = counts.get(key, 0) + 1
                long = len(lines) - 1
                for key, n in (((state, -1, 0), int(long > 0)), ((state, -1, 1), int(long == 0)), ((state + 1, -1, 0), max(0, long - 1)), ((state + 1, -1, 1), int(long > 0))):
                    counts[key] = counts.get(key, 0) + n
        if counts:
            columns = list(zip(*((*k, n) for k, n in counts.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["state", "kind", "value", "n"])

    table = known.select("role", "text").mapInArrow(run, "state bigint, kind bigint, value bigint, n bigint").groupBy("state", "kind", "value").agg(F.sum("n").alias("n")).collect()
    # equal turns are counted before they meet, so that a number with many turns makes a row a role
    counted = written(known.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n")))
    after = counted.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("n").alias("m"))
    moves = counted.join(after, ["conv_id", "turn"]).groupBy("role", "next").agg(F.sum(F.col("n") * F.col("m")).alias("count")).collect()
    starts = known.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("x")).groupBy("x.role").count().collect()

    start = np.full(STATES, 1e-9)
    start[::2] = smooth
    for r in starts:
        start[2 * ROLES.index(r["role"])] += r["count"]
    follow = np.full((len(ROLES), len(ROLES)), smooth)
    for r in moves:
        follow[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
    follow /= follow.sum(axis=1, keepdims=True)
    emit = [np.full((STATES, n), smooth) for n in SIZES.values()]
    stay = np.full((STATES, 2), smooth)
    for r in table:
        (stay if r["kind"] < 0 else emit[r["kind"]])[r["state"], r["value"]] += r["n"]
    emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit]
    stay /= stay.sum(axis=1, keepdims=True)
    move = np.full((STATES, STATES), 1e-12)
    for a in range(STATES):
        move[a, a | 1] = stay[a, 0]
        move[a, ::2] = stay[a, 1] * follow[a // 2]
    return Speakers(np.log(start / start.sum()), np.log(move), emit)


def _seen(rows: list[str]) -> tuple[list[str], np.ndarray]:
    """Lines of a block's rows, and what is observed of them."""
    split = [text.split("\n") for text in rows]
    return [line for lines in split for line in lines], np.concatenate([observe(lines) for lines in split])


def _blocks(transcripts: DataFrame, block_rows: int) -> DataFrame:
    """(conv_id, block, rows ARRAY<STRING>): at most block_rows neighbouring rows of a transcript each; blocks of a transcript rise with its order.

    Rows are dealt in ranges of the whole order, which also splits conversations, repeated turns and repeated rows of any number. A row without
    conv_id is a block of its own.
    """
    kind = transcripts.schema["conv_id"].dataType.simpleString()
    rows = transcripts.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = ["conv_id", "turn", "text", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, held, out, size = TaskContext.get().partitionId() << 32, None, [], [], 0
        kind_of = pa.int64()

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind_of, pa.int64(), pa.list_(pa.string())), strict=True)], names=["conv_id", "block", "rows"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for conv, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv != now or conv is None or len(held) == block_rows):
                    out.append((now, block, held))
                    block, held = block + 1, []
                    if len(out) >= 512 or size > 4 << 20:
                        yield given()
                        out, size = [], 0
                now = conv
                held.append(text)
                size += len(text)
        if held:
            out.append((now, block, held))
        if out:
            yield given()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "text").mapInArrow(run, f"conv_id {kind}, block bigint, rows array<string>")


def _block_ends(blocks: DataFrame, model: Speakers, kind: str) -> DataFrame:
    """(conv_id, block, entry, leave): states before and at the end of each block of the transcripts in blocks(conv_id, block, rows, low), which have several each.

    Matrices are multiplied in groups of FAN, level by level, until one is left of each transcript; then states go down the same levels.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.matrix(_seen(rows)[1], first).ravel() for rows, first in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "n", "m"])

    place = F.row_number().over(W.partitionBy("conv_id").orderBy("block")) - 1
    numbered = written(blocks.select("conv_id", "block").withColumn("n", place.cast("long")))
    whole = blocks.join(numbered, ["conv_id", "block"]).select("conv_id", "n", "rows", (F.col("n") == 0).alias("first"))
    levels = [written(whole.mapInArrow(matrices, f"conv_id {kind}, n bigint, m array<double>"))]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in pdf.sort_values("n")["m"]:
            x = np.array(x).reshape(STATES, STATES)
            total = x if total is None else (total[:, :, None] + x[None]).max(axis=1)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "n": pdf["up"].iloc[:1], "m": [total.ravel()]})

    while not levels[-1].where("n > 0").isEmpty():
        levels.append(written(levels[-1].withColumn("up", F.expr(f"n div {FAN}")).groupBy("conv_id", "up").applyInPandas(up, f"conv_id {kind}, n bigint, m array<double>")))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        """States around each matrix of a group that lies between fixed states (entry -1: before the start; leave -1: any)."""
        pdf = pdf.sort_values("n")
        entry, leave = int(pdf["above_entry"].iloc[0]), int(pdf["above_leave"].iloc[0])
        m = [np.array(x).reshape(STATES, STATES) for x in pdf["m"]]
        best, back = m[0][max(entry, 0)], []
        for x in m[1:]:
            reach = best[:, None] + x
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0)
        ends = [int(best.argmax()) if leave < 0 else leave]
        for b in back[::-1]:
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "n": pdf["n"], "entry": [entry, *ends[:-1]], "leave": ends})

    fixed = levels[-1].select("conv_id", "n", F.lit(-1).alias("entry"), F.lit(-1).alias("leave"))
    for level in levels[::-1]:
        above = fixed.select("conv_id", F.col("n").alias("up"), F.col("entry").alias("above_entry"), F.col("leave").alias("above_leave"))
        if level is levels[-1]:
            grouped = level.withColumn("up", F.col("n")).join(above, ["conv_id", "up"])
        else:
            grouped = level.withColumn("up", F.expr(f"n div {FAN}")).join(above, ["conv_id", "up"])
        fixed = written(grouped.groupBy("conv_id", "up").applyInPandas(down, f"conv_id {kind}, n bigint, entry int, leave int"))
    return numbered.join(fixed, ["conv_id", "n"]).select("conv_id", "block", "entry", "leave")


_PIECE = {"place": pa.int64(), "role": pa.string(), "text": pa.string(), "continued": pa.bool_(), "last": pa.bool_(), "several": pa.bool_()}


def format_chat(transcripts: DataFrame, model: Speakers, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, block, place, role, text, rendered): the recovered turns of transcripts(conv_id, turn, text).

    The rows of a conversation, in order of turn (null first) and then text, are pieces of one transcript; only their lines count, and where
    a turn begins is recovered. block and place order a conversation's turns. text has the speaker marker cut off; rendered, the canonical form, is also without white space at its ends. Rows without conv_id are
    transcripts of their own; null and empty texts are one empty line; repeated rows repeat their lines. Turns do not depend on block_rows.
    Other columns play no part, whatever their names. An empty table gives an empty result.
    """
    small_batches(transcripts.sparkSession)
    kind = transcripts.schema["conv_id"].dataType.simpleString()
    blocks = written(_blocks(transcripts, block_rows))
    ends = blocks.where("conv_id is not null").groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    long = written(ends.where("low < high").select("conv_id"))
    fixed = _block_ends(blocks.join(long, "conv_id"), model, kind)
    placed = blocks.join(fixed, ["conv_id", "block"], "left").select("conv_id", "block", "rows", "entry", "leave")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, at, rows, entry, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, seen = _seen(rows)
                states = model.decode(seen, -1 if entry is None else entry, -1 if leave is None else leave)
                begins = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0]
                for n, (i, j) in enumerate(zip(begins, [*begins[1:], len(lines)], strict=True)):
                    head = _MARKER.match(lines[i]) if states[i] % 2 == 0 else None
                    text = "\n".join([lines[i][head.end() :] if head else lines[i], *lines[i + 1 : j]])
                    # the first line of a transcript begins a turn even if its state says otherwise
                    out.append((conv, at, n, ROLES[states[i] // 2], text, bool(states[i] % 2) and entry is not None and entry >= 0, j == len(lines), leave is not None))
            kinds = [batch.schema.field(0).type, pa.int64(), *_PIECE.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=["conv_id", "block", *_PIECE])

    found = written(placed.mapInArrow(run, f"conv_id {kind}, block bigint, place bigint, role string, text string, continued boolean, last boolean, several boolean"))
    # pieces at the borders of blocks: a turn that goes on in the next block is put together again
    border = F.col("several") & (F.col("last") | F.col("continued"))
    turn = F.sum((~F.col("continued")).cast("long")).over(W.partitionBy("conv_id").orderBy("block", "place"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "\n")
    joined = found.where(border).withColumn("turn", turn).groupBy("conv_id", "turn").agg(F.min(F.struct("block", "place", "role")).alias("x"), text.alias("text"))
    whole = joined.select("conv_id", "x.block", "x.place", "x.role", "text").unionByName(found.where(~border).select("conv_id", "block", "place", "role", "text"))
    return whole.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.btrim("text", F.lit(" \t\n\v\f\r")), F.lit("\n<|end|>")))


def transcripts(conversations: DataFrame, unmarked: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, marked): each turn as transcripts in the wild spell it.

    A text whose role is one of ROLES gets a marker of that role, one of MARKERS in one of SPELLINGS; `unmarked` percent of them get none. All by a
    hash of id, turn and text, so reruns agree.
    """
    name, text = F.lower("role"), F.coalesce("text", F.lit(""))
    h = lambda seed, n: F.pmod(F.xxhash64("conv_id", "turn", "text", F.lit(seed)), n if isinstance(n, Column) else F.lit(n)).cast("int")
    words = F.create_map(*[x for role in ROLES for x in (F.lit(role), F.array(*map(F.lit, MARKERS[role])))])[name]
    word = F.element_at(words, h(1, F.size(words)) + 1)
    word = F.when(h(2, 2) == 0, F.initcap(word)).otherwise(F.upper(word))
    spelt = [F.concat(F.lit(a), word, F.lit(b)) for a, b in (x.split("{}") for x in SPELLINGS)]
    marker = F.element_at(F.array(*spelt), h(3, len(SPELLINGS)) + 1)
    marked = name.isin(*ROLES) & (h(4, 100) >= unmarked)
    return conversations.select("conv_id", "turn", "role", F.when(marked, F.concat(marker, text)).otherwise(text).alias("text"), F.coalesce(marked, F.lit(False)).alias("marked"))
