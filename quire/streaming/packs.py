"""The life of knowledge packs: one state machine, as windows over a log and as a stateful stream over its files.

A pack is created as a draft, activated, and archived; a rollback archives it too. Archived packs stay archived. Every operation of a log gives one row
that says what it found and left, and whether it was accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an operation makes of each status that it accepts.
MOVES = {
    "create": {"none": "draft"},
    "activate": {"draft": "active", "active": "active"},
    "archive": {"draft": "archived", "active": "archived"},
    "rollback": {"draft": "archived", "active": "archived"},
}
HISTORY = "pack_id bigint, seq bigint, op string, before string, after string, accepted boolean"


def history(log: DataFrame) -> DataFrame:
    """(pack_id, seq, op, before, after, accepted) of log(pack_id, ts, seq, op), each pack's operations in order of (ts, seq). Unknown operations are rejected.

    Three running maxima over one window: once created a pack stays created, once archived it stays archived, so no fold is needed; rows of a null pack are left out.
    """
    order = W.partitionBy("pack_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.max(c).over(order), F.lit(False))
    op = F.col("op")
    rows = log.where("pack_id is not null").withColumn("made", seen(op == "create"))
    rows = rows.withColumn("shut", seen(F.col("made") & op.isin("archive", "rollback")))
    rows = rows.withColumn("on", seen(F.col("made") & ~F.col("shut") & (op == "activate")))
    before = F.when(F.col("shut"), "archived").when(F.col("on"), "active").when(F.col("made"), "draft").otherwise("none")
    after = F.coalesce(*[F.when((op == o) & (F.col("before") == b), a) for o, moves in MOVES.items() for b, a in moves.items()])
    told = rows.withColumn("before", before).withColumn("after", after)
    return told.select("pack_id", "seq", "op", "before", F.coalesce("after", "before").alias("after"), F.col("after").isNotNull().alias("accepted"))


def history_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same of a stream of log(pack_id, ts, seq, op) whose rows may come out of order by `late` at most.

    A pack's operations wait in its state until the watermark has passed them and are then played in order, so files in any order within the delay, and restarts from a checkpoint,
    give the rows of the batch. Rows that come later than the watermark are dropped. State is what waits, and one status, for each pack.
    """
    state = "status string, ts array<bigint>, seq array<bigint>, op array<string>"

    def play(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, ts, seq, op = held.get if held.exists else ("none", [], [], [])
        waiting = list(zip(ts, seq, op, strict=True))
        for batch in batches:
            waiting += list(zip((batch["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), batch["seq"].tolist(), batch["op"].tolist(), strict=True))
        waiting.sort(key=lambda x: x[:2])
        passed = held.getCurrentWatermarkMs()
        out = []
        while waiting and waiting[0][0] <= passed:
            _, n, what = waiting.pop(0)
            after = MOVES.get(what, {}).get(status)
            out.append((key[0], n, what, status, after or status, after is not None))
            status = after or status
        held.update((status, *([x[k] for x in waiting] for k in range(3))))
        if waiting:
            held.setTimeoutTimestamp(max(waiting[0][0], passed + 1))
        yield pd.DataFrame(out, columns=["pack_id", "seq", "op", "before", "after", "accepted"])

    rows = log.where("pack_id is not null").withWatermark("ts", late).select("pack_id", "ts", "seq", "op")
    return rows.groupBy("pack_id").applyInPandasWithState(play, HISTORY, state, "append", GroupStateTimeout.EventTimeTimeout)
