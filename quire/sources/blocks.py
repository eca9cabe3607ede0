"""Documents as rows of blocks: the line model of the `documents` table, with types, levels, sections and title paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def block_type(text: Column, pos: Column) -> Column:
    """table, list, key_value, heading or paragraph, by the form and place of a line."""
    return (
        F.when(F.trim(text) == "", "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(r"^([-*]|[0-9]+[.)]) "), "list")
        .when(text.rlike(r"^[^:|]{2,40}: .+"), "key_value")
        .when(((pos == 0) & (F.length(text) <= 80)) | (F.length(text) <= 16), "heading")
        .otherwise("paragraph")
    )


def heading_level(kind: Column, pos: Column, text: Column) -> Column:
    """1 for an opening heading, 2 for a later one of ten characters or more, 3 for a shorter one; null if no heading."""
    return F.when(kind == "heading", F.when(pos == 0, 1).when(F.length(text) >= 10, 2).otherwise(3))


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, block_id, type, level, text): a row for each line; pos is the order that everything else relies on."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    typed = lines.withColumn("type", block_type(F.col("text"), F.col("pos")))
    return typed.select("doc_id", "pos", F.format_string("b%04d", F.col("pos") + 1).alias("block_id"), "type", heading_level(F.col("type"), F.col("pos"), F.col("text")).alias("level"), "text")


def _paths(heads: list[dict]) -> list[str]:
    """The path at each heading: its text behind the path before it, cut to level - 1 parts."""
    out, path = [], []
    for head in heads:
        path = [*path[: head["level"] - 1], head["text"]]
        out.append(" > ".join(path))
    return out


def title_path_arrays(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, pos ARRAY<INT>, title_path ARRAY<STRING>), a row for each document with a text: its headings and the path after each; further columns go along.

    At each heading, the path after it is pushed on the path cut to level - 1 parts. One pass over each document's headings in Arrow batches: no shuffle, linear, and exact where levels are skipped.
    """
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), i.alias("pos"), heading_level(block_type(t, i), i, t).alias("level")))
    heads = documents.where("text is not null").select("doc_id", F.filter(lines, lambda x: x["level"].isNotNull()).alias("heads"), *more)
    kept = [f for f in heads.schema if f.name != "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            pos = [[h["pos"] for h in x] for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(pos, pa.list_(pa.int32())), pa.array([_paths(x) for x in rows], pa.list_(pa.string()))], names=[*(f.name for f in kept), "pos", "title_path"])

    return heads.mapInArrow(run, StructType([*kept, StructField("pos", ArrayType(IntegerType())), StructField("title_path", ArrayType(StringType()))]))


def title_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, title_path): the path of titles at each heading; null texts have none."""
    return title_path_arrays(documents).select("doc_id", F.explode(F.arrays_zip("pos", "title_path")).alias("x")).select("doc_id", "x.pos", "x.title_path")


def sections(rows: DataFrame) -> DataFrame:
    """blocks with `section`: how many headings stand at or before them in their document."""
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum((F.col("type") == "heading").cast("int")).over(order))
