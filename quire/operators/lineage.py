"""Lineage as tables of nodes and edges: checks and breadth-first reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import written


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", src, kind, dst), 256), 1, 16)


def edges(*parts: DataFrame) -> DataFrame:
    """(edge_id, src, kind, dst): the union of parts(src, kind, dst); repeated edges count once."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("edge_id"), "src", "kind", "dst").dropDuplicates(["edge_id"])


def broken(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    known = nodes.select("node")
    lost = rows.join(known, F.col("src") == F.col("node"), "left_anti")
    return lost.unionByName(rows.join(known, F.col("dst") == F.col("node"), "left_anti")).distinct()


def reach(rows: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within `depth` steps along src -> dst from start(root, node), each at its least depth. One join a step, on the frontier only."""
    seen = written(start.select("root", "node", F.lit(0).alias("depth")))
    front = seen
    for k in range(1, depth + 1):
        near = front.join(rows.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), F.col("node") == F.col("_s")).select("root", F.col("_d").alias("node")).distinct()
        front = written(near.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: Kinds of nodes whose coverage a report holds against a least share; the other kinds are only counted.
LEAST_COVERAGE = {"field": 0.9, "chunk": 0.9, "artifact": 0.95}


def graph_totals(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(graph, kind, n, linked, orphans, broken_edges) of nodes(graph, node, kind) and rows(graph, src, dst): for each kind of each graph how many nodes there are, how many an unbroken edge touches,
    and how many no edge touches at all; broken_edges, of which an end is no node of the graph, are counted once a graph, under the kind `edge`. Nodes meet edges by equality of (graph, node).
    """
    known = nodes.select("graph", "node", "kind").dropDuplicates(["graph", "node"])
    ids = known.select("graph", "node")
    edges_ = rows.select("graph", "src", "dst").distinct()
    marked = edges_.join(ids.withColumnRenamed("node", "src").withColumn("s", F.lit(True)), ["graph", "src"], "left").join(ids.withColumnRenamed("node", "dst").withColumn("d", F.lit(True)), ["graph", "dst"], "left")
    marked = marked.withColumn("fine", F.col("s").isNotNull() & F.col("d").isNotNull())
    ends = marked.select("graph", F.explode(F.array("src", "dst")).alias("node"), "fine").groupBy("graph", "node").agg(F.bool_or("fine").alias("fine"))
    by_kind = known.join(ends, ["graph", "node"], "left").groupBy("graph", "kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("fine", F.lit(False))).alias("linked"), F.count_if(F.col("fine").isNull()).alias("orphans"), F.lit(0).cast("long").alias("broken_edges"))
    by_edge = marked.groupBy("graph").agg(F.lit("edge").alias("kind"), F.count("*").alias("n"), F.count_if("fine").alias("linked"), F.lit(0).cast("long").alias("orphans"), F.count_if(~F.col("fine")).alias("broken_edges"))
    return by_kind.unionByName(by_edge)


def report(totals: DataFrame, least: dict[str, float] = LEAST_COVERAGE) -> DataFrame:
    """(graphs, <kind>_coverage ..., orphans, broken_edges, status), one row over graph_totals: coverage is the share of linked nodes of a kind, 1 where there are none; passed if every coverage reaches its least and no edge is broken."""
    share = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("linked"))) / F.nullif(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)), F.lit(1.0))
    sums = totals.agg(F.count_distinct("graph").alias("graphs"), *[F.round(share(k), 6).alias(f"{k}_coverage") for k in least], F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"), F.coalesce(F.sum("broken_edges"), F.lit(0)).alias("broken_edges"))
    fine = F.col("broken_edges") == 0
    for k, x in least.items():
        fine &= F.col(f"{k}_coverage") >= x
    return sums.withColumn("status", F.when(fine, "passed").otherwise("failed"))
