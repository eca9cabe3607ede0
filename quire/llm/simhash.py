"""SimHash near-duplicates: fingerprints, exact linking by pigeonhole blocks, components.

Two 64-bit fingerprints that differ in at most k bits agree on at least b - k of b blocks, whichever b is taken. So every
choice of b - k blocks is a join key; pairs that share a key are verified by Hamming distance. The number of blocks follows the
number of distinct fingerprints so that keys are about as many as fingerprints; each choice is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried, raw_texts, restored, small_batches, written
from quire.llm.components import components

_digest = partial(xxhash.xxh64_digest, seed=42)


def fingerprint(raw: bytes, shingle: int = 4) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; zero for a text without words."""
    words = raw.lower().split()  # of bytes: A-Z only, and exactly the white space of common.SPACE
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.frombuffer(b"".join(map(_digest, shingles)), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, *others: str) -> DataFrame:
    """(doc_id, fp BIGINT, others), a row for each row of docs. Null and empty texts have fingerprint zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *others])

    taken = docs.select("doc_id", "text", *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema if f.name != "text")
    return taken.mapInArrow(run, schema.replace(",", ", fp bigint,", 1) if others else f"{schema}, fp bigint")


def masks(n_blocks: int, k: int) -> list[int]:
    """Signed 64-bit masks of every choice of n_blocks - k blocks."""
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(c) for c in combinations(blocks, n_blocks - k)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def block_count(n: int, k: int) -> int:
    """The least number of blocks whose keys have at least as many values as there are fingerprints."""
    return next(b for b in range(k + 1, 65) if 64 * (b - k) // b >= min(n, 1 << 40).bit_length())


def _links_in_runs(key: np.ndarray, fp: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys: (member, root of its part in the run)."""
    starts = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    two = starts[sizes == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= k]
    left, right = [node[two]], [node[two + 1]]
    for s, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        f, rest = fp[s : s + m], np.arange(m)
        while len(rest) > 1:  # breadth first; who is reached leaves the pool, so a dense group costs few scans
            root, front, rest = rest[0], [rest[0]], rest[1:]
            while front and len(rest):
                near = np.bitwise_count(f[rest] ^ f[front.pop()]) <= k
                hit, rest = rest[near], rest[~near]
                front.extend(hit)
                left.append(np.full(len(hit), node[s + root]))
                right.append(node[s + hit])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, k: int = 4, n_blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly those of distinct(fp, node) which a chain of distances of at most k connects."""
    small_batches(distinct.sparkSession)
    n_blocks = n_blocks or block_count(distinct.count(), k)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(n_blocks, k))])
    keyed = distinct.select(F.explode(keys).alias("x"), "fp", "node").select("x.part", "x.key", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 2), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]

        def out(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) > 1:
                a, b = _links_in_runs(key, fp, node, k)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            part, key, fp, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            waiting.append([np.stack([part.astype(np.int64), key], axis=1), fp.view(np.uint64), node])
            if sum(len(x[1]) for x in waiting) < max(1 << 16, len(held[1])):
                continue
            key, fp, node = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
            waiting = []
            last = np.flatnonzero(np.any(key != key[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = [key[cut:], fp[cut:], node[cut:]]
            yield from out(key[:cut], fp[:cut], node[:cut])
        yield from out(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))

    return keyed.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of docs; component_id is the least doc_id that links reach.

    Copies share a fingerprint and are folded before linking, so a group of any size is one row there. Null and empty texts have
    fingerprint zero and link like others. A row with a null doc_id links too but names no component; where no row of a component
    has an id, component_id is null. Repeated rows each return. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, shingle))
    return prints.join(_component_of(prints, k).withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def _component_of(prints: DataFrame, k: int) -> DataFrame:
    """(fp, component_id) for each fingerprint of prints(doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp", F.col("fp").alias("node")), k))
    part = written(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    smallest = part.groupBy("label").agg(F.min("least").alias("component_id"))
    return part.join(smallest, "label").select("fp", "component_id")


def one_of_each(docs: DataFrame, k: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: the least by doc_id (null last), then by a hash of the text."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_text"))
    prints = written(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), shingle, "_text"))
    labelled = prints.join(_component_of(prints, k).withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"))
    # of rows without any id, each fingerprint is a group of its own
    first = labelled.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(row).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_keep_id"), F.col("x._text").alias("_keep_text"))
    marked = carried(docs, "doc_id", "text").withColumn("_text", F.xxhash64("text"))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text") == F.col("_keep_text")), "left_semi")
    return restored(kept.dropDuplicates(["doc_id", "_text"]), docs, ("doc_id", "text"))
