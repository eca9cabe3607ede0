"""Chunks of a provider against the blocks they claim to come from: every fault as a row, coverage by intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import normalize_spaces
from quire.sources.shared import written

#: Stands between the blocks of a chunk's source.
GAP = "\n\n"
#: Place of a text that is its whole source, where no other chunk names one of its blocks.
WHOLE = (1 << 31) - 1


def _sources(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each block that a chunk names, in the chunk's order, with the block's place in the chunk's normalised source."""
    named = chunks.select("doc_id", "chunk_id", F.col("text").alias("said"), F.posexplode("source_block_ids").alias("k", "block_id"))
    rows = named.join(blocks.select("doc_id", "block_id", "type", "text").hint("merge"), ["doc_id", "block_id"], "left")
    return rows.withColumn("known", F.col("type").isNotNull())


def chunk_faults(chunks: DataFrame, blocks: DataFrame, entities: DataFrame, protected: tuple[str, ...] = ("table", "list"), exclusions: DataFrame | None = None, rules: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, code, chunk_id, block_id): everything that is wrong with chunks(doc_id, chunk_id, text, source_block_ids, entity_ids, parent_id) of blocks(doc_id, block_id, type, text).

    Codes: chunks_empty (a document without chunks), chunk_text_empty, unknown_source_block, text_not_derivable (a chunk's text is no part of its blocks'), unknown_entity (not in entities(doc_id, entity_id)),
    parent_missing, block_missing and protected_block_missing (no chunk names a block that has text, or is of a protected type), protected_block_changed (no chunk holds a protected block
    whole), text_gap (characters of a named block that no chunk covers) and text_overlap (characters that several chunks cover). Texts are compared with white space folded.
    A chunk covers of its blocks what its text covers of their joined text, at its first place there. exclusions(doc_id, block_id, rule) say which blocks need no chunk: each must name one
    of `rules` (else unknown_exclusion_rule) and no protected block (else protected_block_exclusion), which stays as needed as before.
    """
    none = F.lit(None).cast("string")
    fault = lambda rows, code, chunk=none, block=none: rows.select("doc_id", F.lit(code).alias("code"), chunk.alias("chunk_id"), block.alias("block_id"))
    c, b = F.col("chunk_id"), F.col("block_id")
    # written, as each kind of fault reads them again; joined by sorting, as Spark would judge them by their compressed files and broadcast them through the driver
    chunks, blocks = written(chunks), written(blocks.select("doc_id", "block_id", "type", "text"))
    folded = blocks.withColumn("n", normalize_spaces(F.coalesce("text", F.lit(""))))
    has_text = F.col("n") != ""
    sources = written(_sources(chunks, blocks).withColumn("n", normalize_spaces(F.coalesce("text", F.lit("")))))
    parts = F.filter(F.array_sort(F.collect_list(F.struct("k", "n", "block_id"))), lambda x: x["n"] != "")
    whole = sources.groupBy("doc_id", "chunk_id").agg(F.first("said").alias("said"), parts.alias("parts"))
    whole = whole.withColumns({"source": F.array_join(F.transform("parts", lambda x: x["n"]), " "), "n": normalize_spaces(F.coalesce("said", F.lit("")))})
    whole = whole.withColumn("at", F.instr("source", F.col("n")) - 1)
    found = [
        fault(blocks.select("doc_id").distinct().join(chunks.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti"), "chunks_empty"),
        fault(chunks.where(normalize_spaces(F.coalesce("text", F.lit(""))) == ""), "chunk_text_empty", c),
        fault(sources.where("not known"), "unknown_source_block", c, b),
        fault(whole.where("n <> '' and at < 0"), "text_not_derivable", c),
        fault(chunks.where((F.size("source_block_ids") == 0) & (normalize_spaces(F.coalesce("text", F.lit(""))) != "")), "text_not_derivable", c),
        fault(chunks.select("doc_id", "chunk_id", F.explode("entity_ids").alias("entity_id")).join(entities.select("doc_id", "entity_id").hint("merge"), ["doc_id", "entity_id"], "left_anti").distinct(), "unknown_entity", c),
        fault(chunks.where("parent_id is not null").join(chunks.select("doc_id", F.col("chunk_id").alias("parent_id")).hint("merge"), ["doc_id", "parent_id"], "left_anti"), "parent_missing", c),
    ]
    held = sources.where("known").select("doc_id", "block_id").distinct()
    lost = folded.join(held.hint("merge"), ["doc_id", "block_id"], "left_anti").join(chunks.select("doc_id").hint("merge"), "doc_id", "left_semi")
    kept = F.col("type").isin(*protected)
    if exclusions is not None:
        named = exclusions.select("doc_id", "block_id", F.col("rule").isin(*rules).alias("fine")).join(blocks.select("doc_id", "block_id", "type").hint("merge"), ["doc_id", "block_id"])
        found += [fault(named.where(~F.coalesce("fine", F.lit(False))).distinct(), "unknown_exclusion_rule", block=b), fault(named.where(kept).select("doc_id", "block_id").distinct(), "protected_block_exclusion", block=b)]
        lost = lost.join(named.where(F.col("fine") & ~kept).select("doc_id", "block_id").hint("merge"), ["doc_id", "block_id"], "left_anti")
    found += [fault(lost.where(has_text & ~kept), "block_missing", block=b), fault(lost.where(kept), "protected_block_missing", block=b)]
    alone = F.size("source_block_ids") == 1
    intact = sources.where("known").join(chunks.select("doc_id", "chunk_id", alone.alias("alone")).hint("merge"), ["doc_id", "chunk_id"]).where(kept)
    intact = intact.groupBy("doc_id", "block_id").agg(F.bool_or(F.when(F.col("alone"), F.col("said") == F.col("text")).otherwise(F.contains("said", F.col("text")))).alias("fine"))
    found.append(fault(intact.where("not coalesce(fine, false)"), "protected_block_changed", block=b))
    # each block's interval in its chunk's source, cut to what the chunk's text covers
    starts = F.transform("parts", lambda x, i: F.struct(x["block_id"].alias("block_id"), F.length(x["n"]).alias("size"), (F.length(F.array_join(F.transform(F.slice("parts", F.lit(1), i), lambda y: y["n"]), " ")) + F.when(i > 0, 1).otherwise(0)).alias("low")))
    spans = whole.where("n <> '' and at >= 0").select("doc_id", "chunk_id", "at", F.length("n").alias("size_said"), F.explode(starts).alias("x"))
    low, high = F.greatest(F.lit(0), F.col("at") - F.col("x.low")), F.least(F.col("x.size"), F.col("at") + F.col("size_said") - F.col("x.low"))
    covered = spans.select("doc_id", F.col("x.block_id").alias("block_id"), "chunk_id", F.col("x.size").alias("size"), low.alias("low"), high.alias("high")).where("low < high")
    order = W.partitionBy("doc_id", "block_id").orderBy("low", "high", "chunk_id")
    reach: Column = F.coalesce(F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seen = covered.withColumn("reach", reach)
    ends = seen.groupBy("doc_id", "block_id").agg((F.bool_or(F.col("low") > F.col("reach")) | (F.max("high") < F.max("size"))).alias("gap"), F.bool_or(F.col("low") < F.col("reach")).alias("overlap"))
    found += [fault(ends.where("gap"), "text_gap", block=b), fault(ends.where("overlap"), "text_overlap", block=b)]
    return reduce(DataFrame.unionByName, found)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further or other columns, exploded from an array of one, so that they are made once a document and not written out into all that uses them."""
    every = [c.alias(name) for name, c in ({name: F.col(name) for name in rows.columns} | columns).items()]
    return rows.select(F.explode(F.array(F.struct(*every))).alias("d")).select("d.*")


def _spans(chunk: Column) -> Column:
    """What a chunk(chunk_id, n, at, parts ARRAY<STRUCT<block_id, n>>) covers of its blocks: intervals of their texts, cut to what its text n covers from `at` on."""
    step = lambda old, p: F.struct((old["low"] + F.length(p["n"]) + 1).alias("low"), F.array_append(old["parts"], F.struct(p["block_id"].alias("block_id"), F.length(p["n"]).alias("size"), old["low"].alias("low"))).alias("parts"))
    placed = F.aggregate(chunk["parts"], F.struct(F.lit(0).alias("low"), F.array().cast("array<struct<block_id:string,size:int,low:int>>").alias("parts")), step, lambda end: end["parts"])
    low, high = lambda p: F.greatest(F.lit(0), chunk["at"] - p["low"]), lambda p: F.least(p["size"], chunk["at"] + F.length(chunk["n"]) - p["low"])
    span = lambda p: F.struct(p["block_id"].alias("block_id"), low(p).alias("low"), high(p).alias("high"), chunk["chunk_id"].alias("chunk_id"), p["size"].alias("size"))
    return F.filter(F.transform(placed, span), lambda x: x["low"] < x["high"])


def _reached(spans: Column, block_id: Column) -> Column:
    """(block_id, gap, overlap) of a block by its intervals in order: where one begins beyond or before what those before it reach, and whether the last reaches the end."""
    first = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("size"), F.lit(False).alias("gap"), F.lit(False).alias("overlap"))
    step = lambda old, x: F.struct(F.greatest(old["reach"], x["high"]).alias("reach"), x["size"].alias("size"), (old["gap"] | (x["low"] > old["reach"])).alias("gap"), (old["overlap"] | (x["low"] < old["reach"])).alias("overlap"))
    last = lambda end: F.struct(block_id.alias("block_id"), (end["gap"] | (end["reach"] < end["size"])).alias("gap"), end["overlap"].alias("overlap"))
    return F.aggregate(F.filter(spans, lambda x: x["block_id"] == block_id), first, step, last)


def whole_chunk_faults(docs: DataFrame, protected: tuple[str, ...] = ("table", "list"), rules: tuple[str, ...] = ()) -> DataFrame:
    """The same of docs(doc_id, blocks ARRAY<STRUCT<block_id, type, text>>, chunks ARRAY<STRUCT<chunk_id, text, source_block_ids, entity_ids, parent_id>>, entities ARRAY<STRING>,
    exclusions ARRAY<STRUCT<block_id, rule>>), a row for each document with ids of its own for its blocks and chunks: no join and no shuffle, and nothing is written in between."""
    fold = lambda c: normalize_spaces(F.coalesce(c, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    number = lambda b: F.array_position("ids", b).cast("int")
    block = lambda b: F.get("blocks", number(b) - 1)

    typed = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("block_id"), yes(b["type"].isin(*protected)).alias("kept"), b["text"].alias("text"), fold(b["text"]).alias("n")))
    rows = once(docs, ids=F.transform("blocks", lambda b: b["block_id"]), blocks=typed)
    parts = lambda c: F.filter(F.transform(c["source_block_ids"], block), lambda b: b["n"] != "")
    rows = once(rows, chunks=F.transform("chunks", lambda c: c.withField("n", fold(c["text"])).withField("parts", parts(c))), named=F.flatten(F.transform("chunks", lambda c: c["source_block_ids"])))
    rows = once(rows, sources=F.transform("chunks", lambda c: F.array_join(c["parts"]["n"], " ")), repeated=F.size(F.array_distinct("named")) < F.size("named"))
    # a chunk that says all of blocks that no other names covers each once and whole: only others' intervals are looked at
    at = lambda n, source: F.when(n == "", None).when(n == source, F.when(F.col("repeated"), 0).otherwise(WHOLE)).otherwise(F.instr(source, n) - 1)
    rows = once(rows, chunks=F.transform("chunks", lambda c, i: c.withField("at", at(c["n"], F.get("sources", i)))))
    rule = lambda x: F.struct(x["block_id"].alias("block_id"), yes(x["rule"].isin(*rules)).alias("fine"), block(x["block_id"])["kept"].alias("kept"))
    excluded = F.transform(F.filter("exclusions", lambda x: yes(F.array_contains("ids", x["block_id"]))), rule)
    rows = once(rows, exclusions=excluded, spans=F.array_sort(F.flatten(F.transform(F.filter("chunks", lambda c: (c["at"] >= 0) & (c["at"] < WHOLE)), _spans))))
    needless = F.transform(F.filter("exclusions", lambda x: x["fine"] & ~x["kept"]), lambda x: x["block_id"])
    lost = F.filter("blocks", lambda b: ~yes(F.array_contains("named", b["block_id"])) & ~F.array_contains("needless", b["block_id"]))
    rows = once(rows, needless=needless, ends=F.transform(F.array_distinct(F.transform("spans", lambda x: x["block_id"])), lambda b: _reached(F.col("spans"), b)))
    rows = once(rows, lost=F.when(F.size("chunks") > 0, lost).otherwise(F.array()), held=F.filter("blocks", lambda b: b["kept"] & F.array_contains("named", b["block_id"])))

    def whole(b: Column) -> Column:
        fits = lambda c: F.when(F.size(c["source_block_ids"]) == 1, c["text"] == b["text"]).otherwise(F.contains(c["text"], b["text"]))
        return yes(F.exists("chunks", lambda c: F.array_contains(c["source_block_ids"], b["block_id"]) & fits(c)))

    none = F.lit(None).cast("string")
    faults = lambda code, x, chunk=lambda _: none, block=lambda _: none: F.transform(x, lambda y: F.struct(F.lit(code).alias("code"), chunk(y).alias("chunk_id"), block(y).alias("block_id")))
    of_chunks = lambda code, test: faults(code, F.filter("chunks", test), chunk=lambda c: c["chunk_id"])
    of_blocks = lambda code, x, test: faults(code, F.filter(x, test), block=lambda b: b["block_id"])
    unknown = lambda c: faults("unknown_source_block", F.filter(c["source_block_ids"], lambda b: ~yes(F.array_contains("ids", b))), chunk=lambda _: c["chunk_id"], block=lambda b: b)
    strange = lambda c: faults("unknown_entity", F.array_distinct(F.filter(c["entity_ids"], lambda e: ~yes(F.array_contains("entities", e)))), chunk=lambda _: c["chunk_id"])
    found = F.concat(
        F.when((F.size("chunks") == 0) & (F.size("blocks") > 0), faults("chunks_empty", F.array(F.lit(0)))).otherwise(F.array()),
        of_chunks("chunk_text_empty", lambda c: c["n"] == ""),
        F.flatten(F.transform("chunks", unknown)),
        of_chunks("text_not_derivable", lambda c: c["at"] < 0),
        F.flatten(F.transform("chunks", strange)),
        of_chunks("parent_missing", lambda c: c["parent_id"].isNotNull() & ~F.array_contains(F.transform("chunks", lambda x: x["chunk_id"]), c["parent_id"])),
        of_blocks("unknown_exclusion_rule", F.array_distinct("exclusions"), lambda x: ~x["fine"]),
        of_blocks("protected_block_exclusion", F.array_distinct(F.transform("exclusions", lambda x: F.struct(x["block_id"].alias("block_id"), x["kept"].alias("kept")))), lambda x: x["kept"]),
        of_blocks("block_missing", "lost", lambda b: (b["n"] != "") & ~b["kept"]),
        of_blocks("protected_block_missing", "lost", lambda b: b["kept"]),
        of_blocks("protected_block_changed", "held", lambda b: ~whole(b)),
        of_blocks("text_gap", "ends", lambda b: b["gap"]),
        of_blocks("text_overlap", "ends", lambda b: b["overlap"]),
    )
    # an outer explosion: before an inner one Spark tests the array's size, and makes it twice for that
    return rows.select("doc_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")
