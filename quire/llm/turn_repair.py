"""Structure repair of conversations: the cheapest edits after which roles read as system, then user and assistant in turn.

A state says what the last role was. Going backward over a conversation's turns, the cost to go from each state is the cheapest of the edits of
a turn plus the cost to go behind it; going forward from the start, the ASCII-least edit whose cost is tight is taken. Conversations lie
sorted over range partitions and are cut into pieces of bounded size, so one that holds a third of all rows is many pieces: each piece's
costs between any two states are a small matrix, these chain to the cost to go behind each piece, and each piece's walks from any state chain to the state it
starts in. Only the final hash of a conversation's repaired text is taken piece by piece in one task, in bounded memory, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, written

#: States: nothing yet, after the system's turn, after a user's, after an assistant's. What an inserted or changed turn leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Cost to go from each state behind the last turn: a user's turn, or a system's, lacks what must follow.
AT_END = (0, 10, 5, 0)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, CHANGE, CUT = 2, 5, 1, 5
FAR = 1 << 50
ROLES = {USER: "user", ASSISTANT: "assistant"}
_SPACE = r"\x20\x09-\x0D"

#: A turn: (first character of its role, fault).
Turn = tuple[str, int]


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role, if the form allows it."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def cost_before(turn: Turn, behind: Sequence[int]) -> tuple[int, ...]:
    """Cost to go from each state before a turn, inserts there included, by the cost to go behind it."""
    initial, fault = turn
    own = []
    for state in range(4):
        best = DELETE + behind[state]
        if fault in (FINE, TRUNCATED):
            extra = CUT * (fault == TRUNCATED)
            best = min(best, CHANGE + extra + behind[FOLLOWS[state]])
            after = _kept(state, initial)
            if after is not None:
                best = min(best, extra + behind[after])
        own.append(best)
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant


def costs(turns: Sequence[Turn], behind: Sequence[int]) -> list[Sequence[int]]:
    """Cost to go before each turn, and behind the last."""
    out: list[Sequence[int]] = [behind]
    for turn in reversed(turns):
        out.append(cost_before(turn, out[-1]))
    return out[::-1]


def matrix(turns: Sequence[Turn]) -> list[int]:
    """Least cost from each state before the turns to each state behind them, row by row."""
    columns = [costs(turns, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
    return [columns[end][q] for q in range(4) for end in range(4)]


def walk(turns: Sequence[Turn], behind: Sequence[int], state: int, last: bool = True) -> tuple[str, int, list[tuple[int, str | None]], int]:
    """Edits, their cost, what stands afterwards as (number of the turn or -1, new role or None), and the state at the end; last: whether the conversation ends here."""
    to_go, edits, out, total, i = costs(turns, behind), [], [], 0, 0
    while i < len(turns) or (last and to_go[i][state] > 0):
        now = to_go[i][state]
        initial, fault = turns[i] if i < len(turns) else ("", BLANK)
        extra, after = CUT * (fault == TRUNCATED), _kept(state, initial)
        if i < len(turns) and now == DELETE + to_go[i + 1][state]:
            edits.append("D")
            total += DELETE
            i += 1
        elif now == INSERT + to_go[i][FOLLOWS[state]]:
            edits.append("I")
            total += INSERT
            state = FOLLOWS[state]
            out.append((-1, ROLES[state]))
        elif after is not None and fault in (FINE, TRUNCATED) and now == extra + to_go[i + 1][after]:
            edits.append("K")
            total += extra
            state = after
            out.append((i, None))
            i += 1
        else:
            edits.append("R")
            total += CHANGE + extra
            state = FOLLOWS[state]
            out.append((i, ROLES[state]))
            i += 1
    return "".join(edits), total, out, state


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): turns damaged by the hash of conversation and turn; equal rows are one with their number. A null role or text is a space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("n"), kind.alias("kind")
    ).where("kind <> 0")
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, n) with fault, that of the first of n equal turns; the others are blank or duplicate."""
    said = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")]
    rows = written(rows.withColumns({"_a": said[0], "_b": said[1]}))  # both sides below come from one table, and a hot key can be split
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_a").alias("_x"), F.col("_b").alias("_y")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault: Column = F.when(blank, BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE).when(cut, TRUNCATED).otherwise(FINE)
    return rows.join(first, same).select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _initial(role: str) -> str:
    return role[:1]


def _turns(rows: list[dict]) -> tuple[list[Turn], list[dict]]:
    """Every turn of a piece, and the row it comes from."""
    turns, of = [], []
    for row in rows:
        later = BLANK if row["fault"] == BLANK else DUPLICATE
        turns += [(_initial(row["role"]), row["fault"]), *[(_initial(row["role"]), later)] * (row["n"] - 1)]
        of += [row] * row["n"]
    return turns, of


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _repaired(rows: list[dict], behind: Sequence[int], state: int, last: bool) -> tuple[int, str, bytes]:
    """Cost, edits and repaired text of a piece."""
    turns, of = _turns(rows)
    audit, cost, out, _ = walk(turns, behind, state, last)
    said = [f"{role if role else of[i]['role']}:{of[i]['text'] if i >= 0 else ''}" for i, role in out]
    return cost, audit, "\n".join(said).encode("utf-8", "surrogatepass")


_ROW = "struct<turn:bigint,role:string,text:string,n:bigint,fault:int>"
_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _pieces(rows: DataFrame, piece_rows: int, piece_chars: int, conv: str) -> DataFrame:
    """A row for each piece: its sums and borders, and its cost, audit and hash if the conversation surely lies in it alone, or else its rows."""
    schema = f"conv_id {conv}, part int, piece int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, a string, z string, low bigint, high bigint, cost bigint, audit string, sha string, rows array<{_ROW}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, began = TaskContext.get().partitionId(), 0, 0
        held: list[dict] = []
        ready: list[dict] = []

        def done(whole: bool) -> None:
            nonlocal piece
            turns, _ = _turns(held)
            numbers = [x["turn"] for x in held if x["turn"] is not None]
            out = {"conv_id": held[0]["conv_id"], "part": part, "piece": piece, "a": turns[0][0], "z": turns[-1][0], "low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers))}
            out |= {name: sum(f == fault for _, f in turns) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
            out["illegal"] = sum(not _legal(x[0], y[0]) for x, y in zip(turns, turns[1:], strict=False))
            if whole:
                cost, audit, text = _repaired(held, AT_END, START, True)
                out |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(text).hexdigest()}
            else:
                out |= {"rows": [{k: x[k] for k in ("turn", "role", "text", "n", "fault")} for x in held]}
            ready.append(out)
            piece += 1
            held.clear()

        names = [f.name for f in target]
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    done(began == piece and piece > 0)  # not the task's first, and in one piece
                    began, size = piece, 0
                elif held and (len(held) >= piece_rows or size >= piece_chars or row["n"] > piece_rows):
                    done(False)
                    size = 0
                held.append(row)
                size += len(row["text"])
            if len(ready) >= 256:
                yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in names} for x in ready], schema=target)
                ready.clear()
        if held:
            done(False)
        if ready:
            yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in names} for x in ready], schema=target)

    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fault", pa.int32())])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"part": pa.int32(), "piece": pa.int32(), "a": pa.string(), "z": pa.string(), "audit": pa.string(), "sha": pa.string(), "rows": pa.list_(row), "conv_id": to_arrow_type(rows.schema["conv_id"].dataType)}
    target = pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.int64())) for x in schema.split(f", rows array<{_ROW}>")[0].split(", ")] + [("rows", kinds["rows"])])
    order = ("conv_id", "turn", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.col("n").cast("bigint"), "fault").mapInArrow(run, schema)


def _mapped(rows: DataFrame, f, schema: str) -> DataFrame:
    """f, from a row to rows, over all rows; dictionaries on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = [x for row in batch.slice(k, 1).to_pylist() for x in f(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def _through_pieces(rest: DataFrame) -> DataFrame:
    """(part, piece, behind, state, last) for pieces of conversations that may have several: cost to go behind each and the state it starts in."""
    keys = "part int, piece int"

    def listed(rows: DataFrame, *more: str) -> DataFrame:  # one small struct a piece
        return rows.join(rest.select("part", "piece", "conv_id"), ["part", "piece"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", *more))).alias("pieces")).select("pieces")

    def backward(row: dict) -> Iterator[dict]:
        behind, last = list(AT_END), True
        for x in reversed(row["pieces"]):
            yield {"part": x["part"], "piece": x["piece"], "behind": behind, "last": last}
            behind, last = [min(x["m"][4 * q + end] + behind[end] for end in range(4)) for q in range(4)], False

    def forward(row: dict) -> Iterator[dict]:
        state = START
        for x in row["pieces"]:
            yield {"part": x["part"], "piece": x["piece"], "behind": x["behind"], "last": x["last"], "state": state}
            state = x["ends"][state]

    def ends(row: dict) -> Iterator[dict]:
        turns, _ = _turns(row["rows"])
        yield {"part": row["part"], "piece": row["piece"], "behind": row["behind"], "last": row["last"], "ends": [walk(turns, row["behind"], q, row["last"])[3] for q in range(4)]}

    matrices = written(_mapped(rest.select("part", "piece", "rows"), lambda row: [{"part": row["part"], "piece": row["piece"], "m": matrix(_turns(row["rows"])[0])}], f"{keys}, m array<bigint>"))
    behind = written(_mapped(listed(matrices, "m"), backward, f"{keys}, behind array<bigint>, last boolean"))
    ended = written(_mapped(rest.select("part", "piece", "rows").join(behind, ["part", "piece"]), ends, f"{keys}, behind array<bigint>, last boolean, ends array<int>"))
    return written(_mapped(listed(ended, "behind", "last", "ends"), forward, f"{keys}, behind array<bigint>, last boolean, state int"))


def _joined(rest: DataFrame, conv: str) -> DataFrame:
    """(conv_id, cost, audit, sha) of conversations that may have several pieces."""
    kind = rest.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out() -> pa.RecordBatch:
            cost, audits, sha, _ = now[1]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], arrow), pa.array([cost], pa.int64()), pa.array(["".join(audits)]), pa.array([sha.hexdigest()])], names=["conv_id", "cost", "audit", "sha"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if now is None or now[0] != row["conv_id"]:
                    if now:
                        yield out()
                    now = (row["conv_id"], [0, [], hashlib.sha256(), False])
                cost, audit, text = _repaired(row["rows"], row["behind"], row["state"], row["last"])
                sums = now[1]
                sums[0] += cost
                sums[1].append(audit)
                if text:
                    sums[2].update(b"\n" * sums[3] + text)
                    sums[3] = True
        if now:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    rows = rest.select("conv_id", "part", "piece", "rows").join(_through_pieces(rest), ["part", "piece"])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.mapInArrow(run, f"conv_id {conv}, cost bigint, audit string, sha string")


def repair(turns: DataFrame, piece_rows: int = 4096, piece_chars: int = 4 << 20) -> DataFrame:
    """One row for each conv_id of turns(conv_id, turn, role, text), already damaged or not: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    turns may hold `n`, how often a row occurs; other columns are ignored. Turns are in order of (turn, role, text), nulls first; a null conv_id is a conversation of its own, a null
    role or text is a space. piece_rows and piece_chars bound what a task holds of a conversation and change no result.
    """
    small_batches(turns.sparkSession)
    conv = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("bigint"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.col("n").cast("bigint") if "n" in turns.columns else F.lit(1).cast("bigint").alias("n"))
    pieces = written(_pieces(_marked(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))), piece_rows, piece_chars, conv))
    rest = written(pieces.where("rows is not null").select("conv_id", "part", "piece", "rows"))
    edits = pieces.where("rows is null").select("conv_id", "cost", "audit", "sha").unionByName(_joined(rest, conv))
    edits = edits.withColumnRenamed("conv_id", "_conv")
    border = F.struct("part", "piece", "a", "z", "low", "high")
    sums = pieces.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(border)).alias("borders"))
    meets = lambda test: F.expr(f"size(filter(zip_with(slice(borders, 1, size(borders) - 1), slice(borders, 2, size(borders)), (x, y) -> {test}), t -> t))")
    illegal = F.col("illegal") + meets("concat(x.z, y.a) NOT IN ('su', 'ua', 'au')")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + meets("coalesce(x.high = y.low, false)"), F.lit(0))
    sums = sums.select("conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("bigint").alias("illegal"))
    return sums.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """repair of the damaged turns, with a row of zeros for each conversation of which nothing is left."""
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    longs = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
