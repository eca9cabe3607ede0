"""Connected components of an edge table by least labels and pointer jumping, all in Spark."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.sources.shared import released


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of `edges(a, b)`: label is the least node of its component.

    Each round takes the least label among the neighbours, then the label's own label, so a chain of
    length n needs about log2(n) rounds. Rows in flight stay in proportion to the edges; nothing is collected
    but a count of changes. An empty edge table gives an empty result. With `rounds`, labels are those after so many rounds at most: each is
    then some node of its component, so equal labels still mean one component, but one component may hold several labels.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    before = labels
    for turn in count(1):  # labels only fall, so this ends
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = written(low.join(up, F.col("low") == F.col("at")).select("node", "old", F.least("low", "up").alias("label")))
        released(before)
        before, labels = jumped, jumped.select("node", "label")
        if turn == rounds or jumped.where("label <> old").isEmpty():
            released(both)
            return labels
