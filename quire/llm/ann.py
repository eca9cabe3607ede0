"""Approximate nearest neighbours by cosine: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and every row is filed in a leaf. A query walks the tree through one priority queue, nearest centre
first, so it meets leaves in order of promise. How many leaves it visits at least is calibrated: the exact neighbours of a sample of queries,
found by brute force over all rows, must lie in the visited leaves for the wanted share. A query whose leaves hold too few candidates goes on
through its queue. Leaves are searched in blocks of bounded size; a leaf is copied only as often as its own queries fill such blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import least_by_hash, small_batches, written

#: Rows of a leaf, and queries, that meet in one task's block; queries whose products stand in memory at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 4096, 16_384, 512


def usable(column: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    x = lambda v: v.cast("double")
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return column.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda v: x(v) != 0)


@dataclass
class Tree:
    """Centres of all nodes; the children of each inner node; the leaf number of each leaf (-1: inner)."""

    centre: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, by the nearest centre at every level."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = self.children[node]
                at[rows] = kids[_distances(x[rows], self.centre[kids]).argmin(axis=1)]

    def best_bins(self, q: np.ndarray, least: int, held: np.ndarray | None = None, want: int = 0) -> list[int]:
        """The leaves that best-bin-first search visits: `least` of them, and on until they hold `want` of held (a count a leaf)."""
        queue, found, got = [(0.0, 0)], [], 0
        while queue and (len(found) < least or got < want):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                got += int(held[found[-1]]) if held is not None else 0
                continue
            kids = self.children[node]
            for d, kid in zip(_distances(q[None], self.centre[kids])[0].tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (d, kid))
        return found


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * x @ c.T


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_tree(x: np.ndarray, branch: int = 8, leaf_rows: int = 64, rounds: int = 12, seed: int = 1) -> Tree:
    """Splits unit vectors by k-means until a node has leaf_rows rows or fewer distinct ones than branches. No vectors: one leaf."""
    r = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 else 0
    centres, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(width)], [np.empty(0, np.int64)], [-1]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        own = np.unique(x[rows], axis=0) if len(rows) > leaf_rows else x[:0]
        if len(own) < 2 * branch:
            leaf[node] = max(leaf) + 1
            continue
        c = own[r.choice(len(own), branch, replace=False)]
        for _ in range(rounds):
            near = _distances(x[rows], c).argmin(axis=1)
            c = np.stack([x[rows][near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(branch)])
        near = _distances(x[rows], c).argmin(axis=1)
        kids = [k for k in range(branch) if (near == k).any()]
        if len(kids) < 2:
            leaf[node] = max(leaf) + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(kids))
        for k in kids:
            todo.append((len(centres), rows[near == k]))
            centres.append(c[k])
            children.append(np.empty(0, np.int64))
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of x for each query as (query_id, vec_id, score): a fast product picks, an exact one in a fixed order scores."""
    ids, first = np.unique(ids, return_index=True)  # an id repeated with its vector is one candidate; ties then go to the smaller id
    x = x[first]
    if len(q) > AT_ONCE:
        found = [_best(q_id[i : i + AT_ONCE], q[i : i + AT_ONCE], ids, x, k) for i in range(0, len(q), AT_ONCE)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))
    uq, ux = _unit(q), _unit(x)
    near = uq @ ux.T
    near[q_id[:, None] == ids[None]] = -2
    take = min(k, near.shape[1])
    least = -np.partition(-near, take - 1, axis=1)[:, take - 1] - 1e-9
    out = []
    for i in range(len(q)):
        at = np.flatnonzero((near[i] >= least[i]) & (near[i] > -1.5))
        dot, size = (x[at] * q[i]).sum(axis=1), np.sqrt((x[at] * x[at]).sum(axis=1)) * np.sqrt((q[i] * q[i]).sum())
        with np.errstate(all="ignore"):
            score = dot / size
        odd = ~np.isfinite(score) | (size < 1e-150)  # squares that leave the range of doubles
        score[odd] = (ux[at][odd] * uq[i]).sum(axis=1)
        order = np.argsort(-score, kind="stable")[:k]
        out.append((np.full(len(order), q_id[i]), ids[at][order], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


_FOUND = "query_id bigint, vec_id bigint, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of what all blocks found; each block gives a query k rows at most."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The exact k nearest of vectors(vec_id, v) to a bounded list of queries, in one pass over all rows in blocks."""
    q_id, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(q_id, q, np.asarray(batch.column(0)), _matrix(batch.column(1)), k)], names=["query_id", "vec_id", "score"])

    return _top(vectors.select("vec_id", "v").mapInArrow(run, _FOUND), k)


def nearest(table: DataFrame, query: Column, k: int = 5, recall: float = 0.95, sample_rows: int = 16_384, most_sample_rows: int = 131_072, calibration_queries: int = 256, branch: int = 8, leaf_rows: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score, leaves): the k nearest of table(vec_id, embedding) to each of its rows where `query` holds.

    Nearness is the cosine in double precision; a query's own id is no candidate; ties go to the smaller vec_id. Vectors that are not usable,
    have no id, or differ in length from most others take no part. An id repeated with one vector is one candidate. The tree is fitted
    on a quarter of the rows, sample_rows at least and most_sample_rows at most, those least by a hash of vec_id; every row is filed. leaves: how many leaves each query
    visits at least, the least number with which the calibration queries (least by hash) reach `recall` against brute force over all rows.
    A query goes on until its leaves hold k other ids. With fewer candidates than k, all return; without queries, or from an empty table, none.
    Other columns of the table play no part, whatever their names.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), query.alias("asks"))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (widths["n"] if widths else 0))
    count = table.count()
    sampled = least_by_hash(rows, F.xxhash64("vec_id"), min(max(count // 4, sample_rows), most_sample_rows), count, "vec_id")
    tree = _fitted(sampled, widths["n"] if widths else 1, branch, leaf_rows)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            leaf = tree.file(_unit(x)) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "asks", "leaf"])

    filed = written(rows.mapInArrow(file, "vec_id bigint, v array<double>, asks boolean, leaf int"))
    asked = written(filed.where("asks").groupBy("vec_id").agg(F.max("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v"))
    few = [(r["query_id"], np.array(r["v"])) for r in least_by_hash(asked, F.xxhash64("query_id"), calibration_queries, asked.count(), "query_id").collect()]
    leaves = _calibrated(tree, filed, few, k, recall)
    # an id filed in several leaves counts in one; a row a leaf comes to the driver, bounded by the sample
    homes = filed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()
    held, parts = np.zeros(max(tree.leaves, 1), np.int64), np.ones(max(tree.leaves, 1), np.int64)
    for r in homes:
        held[r["leaf"]] = r["count"]
    for r in filed.groupBy("leaf").count().collect():
        parts[r["leaf"]] = -(-r["count"] // BLOCK_ROWS)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1))
            bins = [tree.best_bins(v, leaves, held, k + 1) for v in (_unit(q) if len(q) else q)]
            at = pa.array(np.repeat(np.arange(len(q)), [len(b) for b in bins]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for b in bins for x in b], pa.int32())], names=["query_id", "v", "leaf"])

    visits = written(asked.mapInArrow(visit, "query_id bigint, v array<double>, leaf int"))
    groups = np.zeros(len(parts), np.int64)
    for r in visits.groupBy("leaf").count().collect():
        groups[r["leaf"]] = -(-r["count"] // BLOCK_QUERIES)
    plan = F.broadcast(spark.createDataFrame([(i, int(p), int(g)) for i, (p, g) in enumerate(zip(parts, groups, strict=True))], "leaf int, parts int, groups int"))
    # a large leaf is dealt over parts by the place of the row in the written table; a query goes to all parts of its leaves
    left = filed.withColumn("place", F.monotonically_increasing_id()).join(plan.where("groups > 0"), "leaf")
    left = left.select("vec_id", "v", "leaf", F.expr("cast(pmod(place, parts) as int)").alias("part"), F.explode(F.expr("sequence(0, groups - 1)")).alias("group"))
    right = visits.join(plan, "leaf").select("query_id", "v", "leaf", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(query_id), groups) as int)").alias("group"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = _best(b["query_id"].to_numpy(np.int64), np.stack(b["v"]), a["vec_id"].to_numpy(np.int64), np.stack(a["v"]), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    key = ["leaf", "part", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, _FOUND)
    return _top(found, k).withColumn("leaves", F.lit(int(leaves)))


def _fitted(sampled: DataFrame, width: int, branch: int, leaf_rows: int) -> Tree:
    """The tree of a bounded sample, whose vectors come to the driver as single floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_unit(_matrix(batch.column(0))).astype("<f4").tobytes() if len(batch) else b""])], names=["x"])

    found = b"".join(r["x"] for r in sampled.select("v").mapInArrow(run, "x binary").collect())
    return fit_tree(np.frombuffer(found, "<f4").reshape(-1, width).astype(float), branch, leaf_rows)


def _calibrated(tree: Tree, filed: DataFrame, few: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """How many leaves the walk must visit for `recall` of the exact neighbours of a bounded list of queries."""
    if not few:
        return tree.leaves
    exact = brute_force(filed, few, k)
    homes = filed.select("vec_id", "leaf").join(F.broadcast(exact), "vec_id").select("query_id", "vec_id", "leaf").distinct().collect()
    visits = {i: {leaf: n for n, leaf in enumerate(tree.best_bins(_unit(v[None])[0], tree.leaves), 1)} for i, v in few}
    needed: dict[tuple[int, int], int] = {}
    for r in homes:
        key = (r["query_id"], r["vec_id"])
        needed[key] = min(needed.get(key, tree.leaves), visits[r["query_id"]][r["leaf"]])
    return sorted(needed.values())[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves
