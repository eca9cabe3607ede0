"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often two tokens end together.

Each text is encoded once by both vocabularies. Where tokens of both end at one byte, a group ends and its last tokens are linked. A linked pair is
one int64 key, the second vocabulary's id above the first's. Tasks count their own keys with np.unique; these partial counts are
sorted globally by range and equal neighbours are added up into sorted shards, files in the shared folder. Lookups map the shards into memory
and search them, so workers of one machine share the pages they touch. Where the shared folder is no path that workers can map, keys and counts are joined.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import chunks, packed, raw_texts, small_batches, unpacked, written
from quire.llm.subwords import bytes_of_ids, ordinary_ids
from quire.sources.shared import shared_dir

PIECES = "piece_bpe_32k"
#: The first vocabulary's ids are below this: a key is b * SHIFT + a.
SHIFT = 1 << 16
#: Distinct keys that a task holds before it counts them together.
HELD = 1 << 21


@cache
def _pieces(folder: str | None = None):
    """The second tokenizer and the bytes of its ids."""
    import public_tokenizers
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}.model" if folder else public_tokenizers.path(f"{PIECES}.model"))
    table = [bytes([int(found.id_to_piece(i)[3:-1], 16)]) if found.is_byte(i) else found.id_to_piece(i).replace("▁", " ").encode() for i in range(found.get_piece_size())]
    return found, table


@cache
def _spelt(folder: str | None = None) -> tuple[list[bytes], int, int]:
    """How ids read in a list of groups: those of the first vocabulary inside and at the end of their part, then the second's; with both sizes."""
    a, b = len(bytes_of_ids(folder)), len(_pieces(folder)[1])
    return [b"%d%s" % (i, end) for n, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for end in ends for i in range(n)], a, b


@cache
def _sizes(folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in table], np.int64) for table in (bytes_of_ids(folder), _pieces(folder)[1]))


def aligned(text: str, b: list[int], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of a text by both vocabularies, and the places of the last token of each group in either; None if their bytes are not those of a space and the text. b: its ids by the second."""
    if not text:
        return None
    raw, table = b" " + text.encode(), _pieces(folder)[1]
    a = ordinary_ids(" " + text, folder)
    if b"".join(map(table.__getitem__, b)) != raw or b"".join(map(bytes_of_ids(folder).__getitem__, a.tolist())) != raw:
        return None
    b = np.array(b, np.int64)
    first, second = _sizes(folder)
    ends, others = np.cumsum(first[a]), np.cumsum(second[b])
    common = np.intersect1d(ends, others, assume_unique=True)
    return a.astype(np.int64), b, np.searchsorted(ends, common), np.searchsorted(others, common)


def groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, folder: str | None = None) -> bytes:
    """'a1,a2|b1;a3|b2,b3': the ids of each group in order."""
    spelt, n_a, n_b = _spelt(folder)
    out = np.empty(len(a) + len(b), np.int64)
    of_a, of_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 1
    out[np.arange(len(a)) + np.r_[0, last_b + 1][of_a]] = a + n_a * ends_a
    out[np.arange(len(b)) + (last_a + 1)[of_b]] = 2 * n_a + b + n_b * ends_b
    return b"".join(map(spelt.__getitem__, out.tolist()))[:-1]


def align(docs: DataFrame, folder: str | None = None, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs), a row for each row of docs; with keep_groups also `groups`, the text that is hashed.

    pairs: the document's linked pairs and how often it has each, packed. A text that is null or empty, or whose tokens do not
    spell a space and the text, has no tokens: zeros and empty strings. folder holds the vocabulary files.
    """
    small_batches(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _pieces(folder)[0]
        for whole in batches:
            for low, high in chunks(whole, raw_texts(whole.column(1)), 1 << 20):
                batch = whole.slice(low, high - low)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                rows = []
                for text, b in zip(texts, encoder.encode(texts, num_threads=1), strict=True):
                    found = aligned(text, b, folder)
                    if found is None:
                        rows.append((0, 0, 0, "", packed(np.empty(0, np.int64), np.empty(0, np.int64)), ""))
                        continue
                    a, b, last_a, last_b = found
                    said = groups(a, b, last_a, last_b, folder)
                    key, times = np.unique(b[last_b] * SHIFT + a[last_a], return_counts=True)
                    rows.append((len(a), len(b), len(last_a), hashlib.sha256(said).hexdigest(), packed(np.diff(key, prepend=0), times), said.decode() if keep_groups else ""))
                n_a, n_b, n, sha, pairs, said = zip(*rows, strict=True)
                columns = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)] + [pa.array(sha), pa.array(pairs, pa.binary()), *([pa.array(said)] if keep_groups else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", *(["groups"] if keep_groups else [])]
    schema = f"doc_id {ids}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary" + ", groups string" * keep_groups
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, times = unpacked(raw, "i8", "i8")
    return np.cumsum(gaps), times


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the numbers of each."""
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, back, np.concatenate(times))
    return key, out


def _batch(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key[low : low + (1 << 16)]), pa.array(n[low : low + (1 << 16)])], names=["key", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, n), sorted by ranges of key: how often each pair is linked in all rows of align. Equal keys meet in one task with one partial count a task of theirs at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, size = [], [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                key, n = _pairs(raw)
                keys.append(key)
                times.append(n)
                size += len(key)
                if size > HELD:
                    key, n = _summed(keys, times)
                    if len(key) > HELD // 2:
                        yield from _batch(key, n)
                        key, n = key[:0], n[:0]
                    keys, times, size = [key], [n], len(key)
        if size:
            yield from _batch(*_summed(keys, times))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of a batch may go on in the next
        for batch in batches:
            key, n = (batch.column(k).to_numpy() for k in (0, 1))
            if held:
                key, n = np.r_[held[0], key], np.r_[held[1], n]
            if not len(key):
                continue
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums = np.add.reduceat(n, heads)
            held = (int(key[-1]), int(sums[-1]))
            yield from _batch(key[heads[:-1]], sums[:-1])
        if held:
            yield from _batch(np.array([held[0]], np.int64), np.array([held[1]], np.int64))

    parts = found.select("pairs").mapInArrow(partial, "key bigint, n bigint")
    return parts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(total, "key bigint, n bigint")


def mapped_dir(spark: SparkSession) -> str | None:
    """The shared folder as a path that workers can open, or None."""
    at = urlparse(shared_dir(spark))
    return at.path if at.scheme in ("", "file") else None


def _shards(counts: DataFrame, folder: str) -> list[dict]:
    """Writes each range of counts(key, n) as one sorted file: (path, first key, ids and bests, the highest count of each second id in it), in order.

    What comes to the driver is a row a range and, in all, a number for each id of the second vocabulary and for each range.
    """
    top = f"{folder}/pairs-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches]
        whole = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
        if not whole.shape[1]:
            return
        os.makedirs(top, exist_ok=True)
        path, own = f"{top}/{TaskContext.get().partitionId()}.npy", f"{top}/.{uuid.uuid4().hex}.npy"
        np.save(own, whole)
        os.replace(own, path)  # whole at once, and the same again if the task is
        ids = whole[0] // SHIFT
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        best = packed(ids[heads], np.maximum.reduceat(whole[1], heads))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(whole[0, 0])], pa.int64()), pa.array([best], pa.binary())], names=["path", "first", "best"])

    return sorted((r.asDict() for r in counts.mapInArrow(write, "path string, first bigint, best binary").collect()), key=lambda r: r["first"])


def _looked_up(found: DataFrame, shards: list[dict], names: list[str]) -> DataFrame:
    """found with n_best and count_sum, by the mapped shards."""
    best = np.zeros(SHIFT, np.int64)
    for x in shards:
        ids, most = unpacked(x.pop("best"), "i8", "i8")
        np.maximum.at(best, ids, most)
    firsts, paths = np.array([x["first"] for x in shards], np.int64), [x["path"] for x in shards]
    known = found.sparkSession.sparkContext.broadcast((best, firsts, paths))  # a number an id and two a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, firsts, paths = known.value
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            own = [_pairs(x) for x in batch.column(batch.schema.get_field_index("pairs")).to_pylist()]
            sizes = np.array([len(k) for k, _ in own], np.int64)
            keys, times = (np.concatenate([x[j] for x in own]) if own else np.empty(0, np.int64) for j in (0, 1))
            order = np.argsort(keys, kind="stable")
            counts, asked = np.empty(len(keys), np.int64), keys[order]
            cuts = [*np.searchsorted(asked, firsts).tolist(), len(asked)]
            for s, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if low < high:
                    if s not in maps:
                        maps[s] = np.load(paths[s], mmap_mode="r")
                    counts[order[low:high]] = maps[s][1, np.searchsorted(maps[s][0], asked[low:high])]
            row = np.repeat(np.arange(len(own)), sizes)
            sums, hits = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            np.add.at(sums, row, counts * times)
            np.add.at(hits, row, times * (counts == best[keys // SHIFT]))
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"n_best": pa.array(hits), "count_sum": pa.array(sums)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names), "n_best bigint, count_sum bigint"])
    return found.select(*names, "pairs").mapInArrow(run, schema)


def _by_join(found: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """The same where shards cannot be mapped: keys of all documents meet their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, times = _pairs(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key), pa.array(times)], names=["row", "key", "times"])

    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    best = counts.groupBy(F.shiftright("key", 16).alias("b")).agg(F.max("n").alias("best"))
    rated = written(counts.join(F.broadcast(best), F.shiftright("key", 16) == F.col("b")).select("key", "n", "best"))  # a row for each id of the second vocabulary
    pairs = found.select("row", "pairs").mapInArrow(run, "row bigint, key bigint, times bigint")
    sums = pairs.join(rated, "key").groupBy("row").agg(F.sum(F.col("times") * (F.col("n") == F.col("best")).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.join(sums, "row", "left").select(*names, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")))


def cross_alignment(docs: DataFrame, folder: str | None = None, keep_groups: bool = False, mapped: bool | None = None) -> DataFrame:
    """align with n_best and count_sum: over a document's links, how many have their second id's highest count, ties included, and the sum of counts.

    mapped: whether counts are looked up in mapped shards, by default where the shared folder can be; neither way changes a result.
    """
    found = written(align(docs, folder, keep_groups))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if keep_groups else [])]
    counts, at = pair_counts(found), mapped_dir(docs.sparkSession)
    if at if mapped is None else mapped:
        return _looked_up(found, _shards(counts, at), names)
    return _by_join(found, written(counts), names)
