"""Extractive summaries under a budget, and whether a summary is faithful to its source."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import UNICODE_SPACE, normalize_spaces
from quire.sources.blocks import block_type

#: What ends a sentence of a document, forms of labelled lines, and of dates, amounts, organisations and numbers in tables.
MARKS = "。！？.!?"
NUMBERED_LINE = r"^[\x09-\x0D\x20]*[0-9]+[.、][\x09-\x0D\x20]*[^:：]+[：:]"
FILLED_LINE = r"^[\x09-\x0D\x20]*[^:：]{1,20}[：:][\x09-\x0D\x20]*[^\x09-\x0D\x20]"
EMPTY_LINE = r"^[\x09-\x0D\x20]*[^:：]{1,20}[：:][\x09-\x0D\x20]*$"
SHORT_SENTENCE = r"[^。！？!?；;\n.]+[。！？!?；;.]*"
DATES = "[0-9]{4}[-年][0-9]{1,2}(?:[-月][0-9]{1,2}日?)?|[0-9]{4}年"
AMOUNTS = r"[0-9]+(?:\.[0-9]+)?[\x09-\x0D\x20]*(?:万?元|亿元|%|万元)"
ORGANISATIONS = "[\\x{4e00}-\\x{9fff}]{2,24}(?:政府|委员会|办公室|管理局|财政局|公司|中心|学校|学院|医院|机构)"
NUMBERS = r"[0-9]+(?:\.[0-9]+)?[\x09-\x0D\x20]*(?:亿元|万元|元|%|年|月|日|个|项|家|人|次|套|台)?"
_number, _digits = re.compile(NUMBERS), re.compile(r"([0-9]+(?:\.[0-9]+)?)[\x09-\x0D\x20]*")
#: A summary is over-long beyond this share of its source; a number belongs to a label at most so many characters before it.
RATIO, REACH = 0.7, 80


def sentences(line: Column) -> Column:
    """The sentences of one line, each with the marks that end it; white space is normalised and none is blank."""
    parts = F.regexp_extract_all(normalize_spaces(line), F.lit(f"[^{MARKS}]*[{MARKS}]|[^{MARKS}]+"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.ltrim(x)), lambda x: x != "")


def _within(parts: Column, limit: int) -> Column:
    """Parts joined by line ends up to the first that would go beyond the limit."""

    def step(acc: Column, x: Column) -> Column:
        longer = F.when(acc["n"] == 0, x).otherwise(F.concat(acc["text"], F.lit("\n"), x))
        stop = acc["done"] | (F.length(longer) > limit)
        return F.struct(F.when(stop, acc["text"]).otherwise(longer).alias("text"), (acc["n"] + F.when(stop, 0).otherwise(1)).alias("n"), stop.alias("done"))

    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(parts, zero, step, lambda acc: acc["text"])


def chunk_summaries(rows: DataFrame, text: Column, limit: int = 120) -> DataFrame:
    """rows(key, ...) as (key, summary): the chunk summary of each text. Rows are dealt over the tasks of a shuffle first, as a small file of many rows is one task."""
    key = rows.columns[0]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    # each step exploded from an array of one, so that no expression is written out twice
    once = lambda df, c, name: df.select("*", F.explode(F.array(c)).alias(name))
    made = once(dealt.select(key, text.alias("_text")), F.struct(F.col("_text").alias("text"), normalize_spaces(F.col("_text")).alias("cleaned"), F.split("_text", r"\r\n|\r|\n").alias("lines")), "_t")
    made = once(made.select(key, "_t"), _parts_of(*(F.col(f"_t.{k}") for k in ("cleaned", "lines"))), "_p")
    return made.select(key, _chosen_part(F.col("_t.cleaned"), F.col("_p"), limit).alias("summary"))


def _parts_of(cleaned: Column, lines: Column) -> Column:
    """Numbered and filled labelled lines, how many labels stand empty, and sentences."""
    rows = lambda form: F.filter(F.transform(F.filter(lines, lambda x: x.rlike(form)), normalize_spaces), lambda x: x != "")
    said = F.filter(F.transform(F.regexp_extract_all(cleaned, F.lit(SHORT_SENTENCE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.array_distinct(rows(NUMBERED_LINE)).alias("numbered"), rows(FILLED_LINE).alias("filled"), F.size(F.filter(lines, lambda x: x.rlike(EMPTY_LINE))).alias("empty"), said.alias("said"))


def _chosen_part(cleaned: Column, p: Column, limit: int) -> Column:
    numbered, filled, said = _within(p["numbered"], limit), _within(p["filled"], min(limit, 48)), p["said"]
    metadata = (p["empty"] >= 3) & (F.size(p["filled"]) >= 2) & (filled != "")
    first = F.when((F.length(F.get(said, F.lit(0))) < 20) & (F.size(said) > 1), F.concat(F.get(said, F.lit(0)), F.get(said, F.lit(1)))).otherwise(F.get(said, F.lit(0)))
    cut = F.concat(F.rtrim(F.substring(cleaned, 1, limit)), F.when(F.length(cleaned) > limit, "...").otherwise(""))
    return F.when(cleaned == "", "").when(numbered != "", numbered).when(metadata, filled).when(F.length(first) <= limit, first).otherwise(cut)


def chunk_summary(c: Column, limit: int = 120) -> Column:
    """A chunk's summary: its numbered labelled lines, else its filled labels if three or more stand empty, else its first sentence (and the second after a short one), else its beginning."""
    cleaned, lines = normalize_spaces(c), F.split(c, r"\r\n|\r|\n")
    return _chosen_part(cleaned, _parts_of(cleaned, lines), limit)


def _candidates(lines: Column) -> Column:
    """Sentences to choose from lines(pos, heading, text) in order: the first of each section, or all where there is no heading."""
    cut = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["heading"].alias("heading"), F.when(x["heading"], F.array().cast("array<string>")).otherwise(sentences(x["text"])).alias("s")))
    return F.filter(cut, lambda x: x["heading"] | (F.size(x["s"]) > 0))


def _chosen(filled: Column) -> Column:
    first = F.filter(F.transform(filled, lambda x, i: F.struct(F.get(x["s"], F.lit(0)).alias("s"), x["pos"].alias("pos"), (~x["heading"] & ((i == 0) | F.get(filled, i - 1)["heading"])).alias("own"))), lambda x: x["own"])
    every = F.flatten(F.transform(filled, lambda x: F.transform(x["s"], lambda s: F.struct(s.alias("s"), x["pos"].alias("pos"), F.lit(True).alias("own")))))
    return F.when(F.exists(filled, lambda x: x["heading"]), first).otherwise(every)


def _summary(found: Column, max_sentences: int, max_chars: int) -> Column:
    """A fold over candidate sentences: text so far, what it holds, and whether it is closed. Its state is bounded by the budgets."""
    zero = F.struct(F.array().cast("array<struct<s:string,pos:int>>").alias("out"), F.lit(0).alias("size"), F.lit(False).alias("done"), F.lit(False).alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        n, left = F.size(acc["out"]), max_chars - acc["size"] - F.size(acc["out"])
        known = F.exists(acc["out"], lambda y: y["s"] == x["s"])
        full = (n >= max_sentences) | (left <= 0) | ((F.length(x["s"]) > left) & (n > 0))
        done = acc["done"] | (~known & full)
        s = F.when(F.length(x["s"]) > left, F.rtrim(F.substring(x["s"], F.lit(1), left))).otherwise(x["s"])
        take = ~done & ~known
        return F.struct(F.when(take, F.concat(acc["out"], F.array(F.struct(s.alias("s"), x["pos"].cast("int").alias("pos"))))).otherwise(acc["out"]).alias("out"), (acc["size"] + F.when(take, F.length(s)).otherwise(0)).alias("size"), done.alias("done"), (acc["cut"] | (take & (F.length(x["s"]) > left))).alias("cut"))

    return F.aggregate(found, zero, step)


def _summarised(rows: DataFrame, max_sentences: int, max_chars: int, *more: str) -> DataFrame:
    """(doc_id, summary, n_sentences, positions, truncated) of rows(doc_id, lines); the columns `more` go along. Each step is exploded from an array of one, so that no expression is written out twice."""
    rows = rows.select("doc_id", *more, F.explode(F.array(_candidates(F.col("lines")))).alias("filled"))
    rows = rows.select("doc_id", *more, F.explode(F.array(_summary(_chosen(F.col("filled")), max_sentences, max_chars))).alias("x"))
    join = lambda f: F.transform("x.out", lambda y: y[f])
    return rows.select("doc_id", F.array_join(join("s"), "\n").alias("summary"), F.size("x.out").alias("n_sentences"), F.array_join(join("pos").cast("array<string>"), ",").alias("positions"), F.col("x.cut").alias("truncated"), *more)


def document_summaries(documents: DataFrame, max_sentences: int = 5, max_chars: int = 500) -> DataFrame:
    """(doc_id, summary, n_sentences, positions, truncated): sentences of each document's lines in order, the first of every section, or all where there is no heading.

    A sentence that is in already is left out; the summary ends before the first that goes beyond either budget, line ends counted. Only the first sentence may be cut.
    positions are the lines that the sentences stand in. A null text gives an empty summary. No shuffle.
    """
    line = lambda x, i: F.struct(i.alias("pos"), (block_type(x, i) == "heading").alias("heading"), x.alias("text"))
    return _summarised(documents.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line).alias("lines")), max_sentences, max_chars)


def block_summaries(blocks: DataFrame, max_sentences: int = 5, max_chars: int = 500) -> DataFrame:
    """The same of blocks(doc_id, pos, type, text)."""
    lines = F.array_sort(F.collect_list(F.struct("pos", (F.col("type") == "heading").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))))
    return _summarised(blocks.groupBy("doc_id").agg(lines.alias("lines")), max_sentences, max_chars)


def whole_summaries(docs: DataFrame, max_sentences: int = 5, max_chars: int = 500, *more: str) -> DataFrame:
    """The same of docs(doc_id, blocks ARRAY<STRUCT<pos, type, text>>), blocks in order; the columns `more` go along. No shuffle."""
    line = lambda b: F.struct(b["pos"].alias("pos"), (b["type"] == "heading").alias("heading"), F.coalesce(b["text"], F.lit("")).alias("text"))
    return _summarised(docs.select("doc_id", F.transform("blocks", line).alias("lines"), *more), max_sentences, max_chars, *more)


def _new(form: str, summary: Column, source: Column) -> Column:
    """Sorted distinct matches of a form in the summary that the source lacks."""
    found = F.transform(F.regexp_extract_all(summary, F.lit(form), F.lit(0)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.contains(source, x))))


def faithfulness(rows: DataFrame, wrong_numbers: DataFrame | None = None) -> DataFrame:
    """(doc_id, empty, missing, forbidden, new_dates, new_amounts, new_organisations, wrong_numbers, overlong, passed) of rows(doc_id, summary, source, must ARRAY<STRING>, must_not ARRAY<STRING>).

    missing and forbidden are words of must that the summary lacks and of must_not that it holds; wrong_numbers come from table_numbers(doc_id, violations).
    A null summary or source is empty, null word lists too.
    """
    s, source = F.coalesce("summary", F.lit("")), F.coalesce("source", F.lit(""))
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = rows.select("doc_id", s.alias("s"), source.alias("source"), words("must").alias("must"), words("must_not").alias("must_not"))
    if wrong_numbers is None:
        rows = rows.withColumn("wrong", F.array().cast("array<string>"))
    else:
        rows = rows.join(wrong_numbers.select("doc_id", F.col("violations").alias("wrong")), "doc_id", "left").withColumn("wrong", words("wrong"))
    checks = {
        "missing": F.filter("must", lambda x: ~F.contains("s", x)), "forbidden": F.array_sort(F.array_distinct(F.filter("must_not", lambda x: F.contains("s", x)))),
        "new_dates": _new(DATES, F.col("s"), F.col("source")), "new_amounts": _new(AMOUNTS, F.col("s"), F.col("source")), "new_organisations": _new(ORGANISATIONS, F.col("s"), F.col("source")), "wrong_numbers": F.col("wrong"),
    }
    overlong = F.length("s") > F.greatest(F.lit(1), F.floor(F.length("source") * RATIO))
    out = rows.select("doc_id", (F.col("s") == "").alias("empty"), *[c.alias(k) for k, c in checks.items()], overlong.alias("overlong"))
    failed = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in checks], F.col("empty") | F.col("overlong"))
    return out.select("doc_id", "empty", *[F.array_join(k, "|").alias(k) for k in checks], "overlong", (~failed).alias("passed"))


def _values(text: str) -> Iterator[tuple[int, str, tuple[float, str]]]:
    """Place, text and (number, unit) of each number of a text."""
    for m in _number.finditer(text):
        n = m[0].strip(" ")
        digits = _digits.match(n)
        yield m.start(), m[0], (float(digits[1]), n[digits.end() :])


def _marks(summary: str, labels: Iterable[str | None]) -> list[tuple[int, int, str]]:
    """(place, length, label) of each place of each label, in order, the longest last where they begin together. Null and empty labels stand nowhere."""
    found = []
    for x in filter(None, labels):
        at = summary.find(x)
        while at >= 0:
            found.append((at, len(x), x))
            at = summary.find(x, at + len(x))
    return sorted(found)


def _violations(summary: str, cells: Iterable[tuple[str | None, str | None, str | None]], reach: int) -> list[str]:
    """Wrong numbers of one summary, by the cells (row, col, text) of its table."""
    of_cell, of_row, cols = defaultdict(set), defaultdict(set), {}
    for row, col, text in cells:
        for _, _, value in _values(text or ""):
            of_cell[row, col].add(value)
            of_row[row].add(value)
            cols[col] = True
    rows, columns, wrong = _marks(summary, of_row), _marks(summary, cols), set()
    i = j = 0
    for at, n, value in _values(summary):
        while i < len(rows) and rows[i][0] <= at:
            i += 1
        while j < len(columns) and columns[j][0] <= at:
            j += 1
        if not i:
            continue
        begin, length, row = rows[i - 1]
        col, end, allowed = None, begin + length, of_row[row]
        if j and columns[j - 1][0] >= begin:
            last = columns[j - 1]
            if at < last[0] + last[1]:
                continue
            if (row, last[2]) in of_cell:
                col, end, allowed = last[2], last[0] + last[1], of_cell[row, last[2]]
        if at - end <= reach and value not in allowed:
            wrong.add(row + ("" if col is None else f"/{col}") + ":" + n.strip(" "))
    return sorted(wrong, key=str.encode)


def whole_table_numbers(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """table_numbers of docs(doc_id, summary, cells ARRAY<STRUCT<row, col, cell>>), a row for each document with its whole table: nothing is moved or joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            cells = list(zip(*(x.to_pylist() for x in column.flatten().flatten()), strict=True))
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            found = [_violations(x, cells[i:j], reach) for x, i, j in zip(batch.column(1).to_pylist(), [0, *ends], ends, strict=False)]
            keep = pa.array([bool(x) for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "violations"]).filter(keep)

    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where("doc_id is not null and summary is not null and cells is not null")
    return some.select("doc_id", "summary", F.transform("cells", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), x["cell"].alias("cell"))).alias("cells")).mapInArrow(run, f"doc_id {kind}, violations array<string>")


def table_numbers(cells: DataFrame, summaries: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, violations ARRAY<STRING>): numbers of summaries(doc_id, summary) that are not in the cell they speak of, by cells(doc_id, row, col, cell).

    A number belongs to the nearest row label before it (the longest of those that begin at one place), and to the nearest column label between that and the number if that row
    has numbers in that column, else to the row as a whole; it is wrong if they hold no such number with its unit, and without a label within `reach` characters it is not judged.
    A document's cells meet in one row beside its summary; labels and numbers are then one walk along the summary.
    """
    tables = cells.where("cell is not null").groupBy("doc_id").agg(F.collect_list(F.struct("row", "col", "cell")).alias("cells"))
    return whole_table_numbers(summaries.join(tables, "doc_id"), reach)
