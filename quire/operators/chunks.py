"""Chunking strategies over blocks, tags, keywords and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.functions import text as t
from quire.sources.blocks import block_type, heading_level


def source_block_aware(blocks: DataFrame) -> DataFrame:
    """One chunk for each block that is not empty."""
    return blocks.where("type <> 'empty'").select("doc_id", F.col("block_id").alias("chunk_id"), F.col("pos").alias("chunk_index"), "type", "text", t.estimate_tokens(F.col("text")).alias("token_count"), t.text_hash(F.col("text")).alias("text_hash"))


def _lines() -> Column:
    """A document's lines with what packing needs, in one array."""
    cjk = lambda x: F.length(x) - F.length(F.regexp_replace(x, t.CJK, ""))
    one = lambda x, i: F.struct(i.alias("pos"), x.alias("text"), block_type(x, i).alias("type"), heading_level(block_type(x, i), i, x).alias("level"), cjk(x).alias("cjk"), (F.length(x) - cjk(x)).alias("other"))
    return F.filter(F.transform(F.split("text", "\n"), one), lambda x: x["type"] != "empty")


def _numbers(kinds: list[str], cjk: list[int], other: list[int], max_tokens: int, with_headings: bool) -> list[int]:
    """Chunk number of each of a document's lines, -1 for a heading that is dropped, in one pass.

    A unit that would exceed the budget, a heading, and a protected block start a new chunk; nothing joins a protected block. A dropped heading
    closes the chunk before it and opens none. Each join costs two characters.
    """
    out, chunk, held, rest, closed = [], -1, 0, 0, True
    for kind, c, o in zip(kinds, cjk, other, strict=True):
        heading, protected = kind == "heading", kind in ("table", "list")
        if heading and not with_headings:
            out.append(-1)
            closed = True
            continue
        joined = max(1, int((held + c) / 1.5 + (rest + o + 2) / 4))
        if closed or protected or heading or joined > max_tokens:
            chunk, held, rest = chunk + 1, c, o
        else:
            held, rest = held + c, rest + o + 2
        closed = protected
        out.append(chunk)
    return out


def _numbered(documents: DataFrame, max_tokens: int, with_headings: bool) -> DataFrame:
    """(doc_id, chunk, x) with a row for each line that is not empty: x is the line, chunk its chunk's number. Linear in the lines, in Arrow batches without a shuffle."""
    rows = documents.where("text is not null").select("doc_id", _lines().alias("lines"))
    longs = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten(), column.offsets.to_pylist()
            kinds, cjk, other = (flat.field(n).to_pylist() for n in ("type", "cjk", "other"))
            ends = [e - ends[0] for e in ends]
            found = [_numbers(kinds[i:j], cjk[i:j], other[i:j], max_tokens, with_headings) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, longs)], names=["doc_id", "lines", "chunks"])

    packed = rows.mapInArrow(run, StructType([*rows.schema, StructField("chunks", ArrayType(IntegerType()))]))
    return packed.select("doc_id", F.explode(F.arrays_zip("lines", "chunks")).alias("z")).select("doc_id", F.col("z.chunks").alias("chunk"), F.col("z.lines").alias("x"))


def _gathered(lines: DataFrame) -> DataFrame:
    """Chunks of numbered lines."""
    rows = lines.where("chunk >= 0").select("doc_id", F.col("chunk").alias("chunk_index"), "x.pos", "x.text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    packed = rows.groupBy("doc_id", "chunk_index").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_blocks"), text.alias("text"))
    return packed.select("doc_id", "chunk_index", "first_pos", "n_blocks", t.estimate_tokens(F.col("text")).alias("token_count"), t.text_hash(F.col("text")).alias("text_hash"))


def greedy(documents: DataFrame, max_tokens: int, with_headings: bool) -> DataFrame:
    """(doc_id, chunk_index, first_pos, n_blocks, token_count, text_hash): greedy packing of each document's lines to a budget of tokens. Null texts have no chunks."""
    return _gathered(_numbered(documents, max_tokens, with_headings))


def parent_child(documents: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, parent_index, chunk_index, first_pos, token_count): children of packing without headings under the last level-1 heading at or before them, counted from 0.

    One pass over the lines: a chunk's parent is the number of level-1 headings up to its first line.
    """
    order = W.partitionBy("doc_id").orderBy("x.pos")
    lines = _numbered(documents, max_tokens, False).withColumn("heads", F.sum((F.col("x.level") == 1).cast("int")).over(order))
    pick = lines.where("chunk >= 0").groupBy("doc_id", F.col("chunk").alias("chunk_index")).agg(F.min("x.pos").alias("first_pos"), F.min("heads").alias("heads"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.pos", "x.text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return pick.select("doc_id", F.greatest(F.lit(0), F.coalesce("heads", F.lit(0)) - 1).cast("int").alias("parent_index"), "chunk_index", "first_pos", t.estimate_tokens(F.col("text")).alias("token_count"))


def tagged(blocks: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """blocks with the sorted names of the rules that hold."""
    return blocks.withColumn("tags", F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))))


def keywords(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, word, n, rank): each document's k most frequent keywords; ties go to the smaller word.

    Words are counted within the row, as lengths of runs of the sorted words, so only documents of one id that are several rows would have to meet; here a row is a document. No shuffle.
    """
    words = documents.select("doc_id", F.explode(F.array(F.array_sort(t.keyword_tokens(F.col("text"))))).alias("w"))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2)))
    runs = words.where(F.size("w") > 0).select("doc_id", "w", F.explode(F.array(starts)).alias("s"))
    count = lambda i, k: F.coalesce(F.get("s", k + 1), F.size("w") + 1) - i
    best = F.slice(F.array_sort(F.transform("s", lambda i, k: F.struct((-count(i, k)).alias("down"), F.get("w", i - 1).alias("word")))), 1, k)
    return runs.select("doc_id", F.posexplode(best).alias("at", "x")).select("doc_id", "x.word", (-F.col("x.down")).cast("long").alias("n"), (F.col("at") + 1).alias("rank"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown, n_blocks): blocks rendered in order."""
    text, kind = F.col("text"), F.col("type")
    one = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(kind == "list", F.concat(F.lit("- "), F.regexp_replace(text, r"^([-*]|[0-9]+[.)]) ", "")))
        .when(kind == "table", F.concat(F.lit("| "), text, F.lit(" |")))
        .otherwise(text)
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("md")))), lambda x: x["md"])
    return blocks.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("markdown"), F.count("*").alias("n_blocks"))


def _windows(text: str, max_tokens: int) -> list[str]:
    """Sentences packed greedily to max_tokens; a longer sentence is cut where it fills one."""
    cjk = lambda x: sum("\u4e00" <= c <= "\u9fff" for c in x)
    size = lambda x: cjk(x) / 1.5 + (len(x) - cjk(x)) / 4
    out, now, filled = [], [], 0.0
    for sentence in re.findall(r"[^。！？!?.\n]*[。！？!?.\n]+|[^。！？!?.\n]+", text):
        pieces, start, held = [], 0, 0.0
        for i, c in enumerate(sentence):
            held += 1 / 1.5 if "\u4e00" <= c <= "\u9fff" else 0.25
            if held > max_tokens:
                pieces.append(sentence[start:i])
                start, held = i, 1 / 1.5 if "\u4e00" <= c <= "\u9fff" else 0.25
        for piece in [*pieces, sentence[start:]]:
            n = size(piece)
            if now and filled + n > max_tokens:
                out.append("".join(now))
                now, filled = [], 0.0
            now.append(piece)
            filled += n
    return [*out, "".join(now)] if now else out


def fixed_window(documents: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, chunk_index, text, token_count, n_sources): all of a document's filled lines as one text, packed by sentences; each chunk is of all those lines.

    Linear in the text, a document at a time, in Arrow batches without a shuffle.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ids = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, piece, n) for d, text, n in zip(batch["doc_id"], batch["all"], batch["n"], strict=True) for k, piece in enumerate(_windows(text, max_tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "n_sources"])

    joined = documents.where("text is not null").select("doc_id", F.array_join(lines, "\n\n").alias("all"), F.size(lines).alias("n"))
    packed = joined.mapInPandas(run, f"doc_id {ids}, chunk_index int, text string, n_sources int")
    return packed.select("doc_id", "chunk_index", "text", t.estimate_tokens(F.col("text")).alias("token_count"), "n_sources")


#: Fixed projections of a chunk for retrieval: with its title path, with its keywords, with words added to tables and lists.
PROJECTIONS = {"flat_blocks": (False, False, False), "heading_aware": (True, False, False), "keyword_enriched": (True, True, False), "table_protected": (True, False, True), "hybrid": (True, True, True)}
#: Fixed words that are added.
BOOST = " table list structured rows"


def projected(rows: DataFrame) -> DataFrame:
    """rows(type, text, title, keywords, ...) once for each projection: strategy, and title, keywords and text as it shows them."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), *[F.lit(x).alias(n) for n, x in zip(("_title", "_words", "_boost"), v, strict=True)]) for k, v in PROJECTIONS.items()]))
    shown = rows.withColumn("_p", each).select("*", "_p.*").drop("_p")
    shown = shown.withColumns({"title": F.when(F.col("_title"), F.col("title")), "keywords": F.when(F.col("_words"), F.col("keywords")).otherwise(F.array().cast("array<string>")), "text": F.when(F.col("_boost") & F.col("type").isin("table", "list"), F.concat("text", F.lit(BOOST))).otherwise(F.col("text"))})
    return shown.drop("_title", "_words", "_boost")
