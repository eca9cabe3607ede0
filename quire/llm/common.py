"""What the corpus operators share: reading, cutting lineage, stable row keys and bounded label samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import written

#: One run of the white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: Arrow batches stay this small, so that a worker holds a few MB of text whatever the length of the documents.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of Python tasks by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def held_out(column: Column, n: int, remainder: int) -> Column:
    """Whether a row is kept from training; a null id never is."""
    return F.coalesce(crc_mod(column, n) == remainder, F.lit(False))


def least_by_hash(rows: DataFrame, key: Column, limit: int, count: int, *ties: Column | str) -> DataFrame:
    """At most `limit` rows, the least by key, a 64-bit hash; count: the rows there are, about.

    Of many rows only a share goes to the sort, twice what is wanted to begin with, so that what one task or the driver gets does not grow with
    the partitions. Where keys repeat, that share may hold too few rows; it is then raised until it holds enough, or all.
    """
    share = 2 * limit / max(count, 1)
    while share < 0.5:
        some = rows.where(key < F.lit(int(2**64 * share) - 2**63))
        if some.limit(limit).count() >= limit:
            return some.orderBy(key, *ties).limit(limit)
        share *= 8
    return rows.orderBy(key, *ties).limit(limit)


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """docs with the columns `names` (those it has) and all others in one struct, `rest`, so that an operator's columns cannot clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*[c for c in names if c in docs.columns], (F.struct(*others) if others else F.struct(F.lit(None).cast("boolean").alias("none"))).alias("rest"))


def restored(rows: DataFrame, docs: DataFrame, names: tuple[str, ...], *added: str) -> DataFrame:
    """The columns of docs again, of rows that began as carried(docs, *names); the columns `added` come last, in place of those of docs of that name."""
    return rows.select(*[F.col(c) if c in names else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def label_sample(labels: DataFrame, label: str, n: int, remainder: int, limit: int) -> DataFrame:
    """At most `limit` labelled ids outside the held-out fold, the smallest by hash: (doc_id, label). Ids with labels that disagree are left out."""
    one = written(
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), n, remainder))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most")
    )
    return least_by_hash(one.select("doc_id", F.col("label").cast("int")), F.xxhash64("doc_id"), limit, one.count(), "doc_id")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, n: int, remainder: int, limit: int) -> DataFrame:
    """The sampled labels with their texts, one row for an id: (doc_id, text, label), written. The broadcast side has `limit` rows at most."""
    sample = written(label_sample(labels, label, n, remainder, limit).coalesce(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return written(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each a process: making them costs more than a small parcel."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each after its length."""
    return _zstd()[0].compress(b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in arrays))


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of packed, by their kinds."""
    raw, at, out = _zstd()[1].decompress(raw), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little") * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


def chunks(batch: pa.RecordBatch, raw: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each (one row at least)."""
    start, total = 0, 0
    for i, x in enumerate(raw):
        if i > start and total + len(x) > limit:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(raw):
        yield start, len(raw)
