"""The date of a meeting: candidates scored by their context, partial dates completed from the blocks before, the best one a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.rules import S, compact
from quire.operators.runs import trimmed

#: Labels that name a meeting's date, labels that forbid one, and words of a meeting's opening.
LABELS = ("会议日期", "会议时间", "召开日期", "召开时间")
FORBIDDEN = ("发布日期", "发布时间", "成文日期", "印发日期", "网页抓取时间", "retrieved_at")
OPENINGS = ("会议于", "会议召开", "主持召开", "会议研究", "会议听取", "会议审议", "会议原则同意", "研究审议", "会议纪要")
GOVERNMENT = ("召开", "主持", "研究", "审议", "听取")
_N = "[二〇○零一二三四五六七八九十]"
_Q = "[一二三四五六七八九十]{1,3}"
NUMERALS = f"{_N}{S}{_N}{S}{_N}{S}{_N}{S}年{S}{_Q}{S}月{S}{_Q}{S}日"
#: Forms of a date, tried in this order.
FORMS = (
    f"[0-9]{S}[0-9]{S}[0-9]{S}[0-9]{S}年{S}[0-9]{{1,2}}{S}月{S}[0-9]{{1,2}}{S}日",
    f"[0-9]{{4}}{S}[年/-]{S}[0-9]{{1,2}}{S}[月/-]{S}[0-9]{{1,2}}{S}日?",
    NUMERALS,
    f"[0-9]{{1,2}}{S}月{S}[0-9]{{1,2}}{S}日",
)
STANDALONE = f"^[（(]?{S}{NUMERALS}{S}[）)]?$"


def numeral_year(c: Column, century: str = "20") -> Column:
    """The year of a date in numerals, as digits; null if it is not of the century (a pattern)."""
    digits = F.translate(F.substring_index(F.regexp_replace(compact(c), r"^[（(]", ""), "年", 1), "零〇○一二三四五六七八九十", "000123456789")
    return F.when(digits.rlike(f"^{century}[0-9]{{2}}$"), digits)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def meeting_dates(blocks: DataFrame, century: str = "20") -> DataFrame:
    """(doc_id, pos, score, raw, value, name, confidence, evidence, flag), a row for each block of blocks(doc_id, pos, text) that dates its meeting.

    A block counts if it names a date with a label or stands in a meeting's opening, or is a date in numerals by itself, and holds no forbidden
    label. A date without a year takes that of the nearest full date that is one of the three blocks before by itself.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    rows = blocks.select("doc_id", "pos", trimmed(F.coalesce("text", F.lit(""))).alias("t"))
    plain = F.regexp_extract("t", rf"^[（(]?{S}({century}[0-9]{{2}}){S}年{S}[0-9]{{1,2}}{S}月{S}[0-9]{{1,2}}{S}日{S}[）)]?$", 1)
    dated = F.when(F.col("t").rlike(STANDALONE), F.struct(numeral_year(F.col("t"), century).alias("year"))).when(plain != "", F.struct(plain.alias("year")))
    rows = rows.withColumn("dated", dated)
    rows = rows.withColumns({"near": F.coalesce(*[F.lag("dated", k).over(order) for k in (1, 2, 3)])["year"], "place": F.row_number().over(order)})
    t = F.col("t")
    explicit, generic, opening = _any(t, LABELS), t.rlike(r"(?:^|[\x09-\x0D\x20\x{3000}])日期" + S + "[:：]"), _any(t, OPENINGS)
    alone = t.rlike(STANDALONE)
    matches = [F.nullif(F.regexp_extract(t, form, 0), F.lit("")) for form in FORMS]
    first = F.coalesce(*matches)
    raw = F.when(explicit | generic | opening, trimmed(first)).when(alone, trimmed(matches[2]))
    own_form = alone & (~(explicit | generic | opening) | (matches[0].isNull() & matches[1].isNull()))
    found = rows.where((t != "") & ~_any(t, FORBIDDEN)).withColumns({"raw": raw, "alone": own_form}).where("raw is not null")
    partial = ~F.contains(F.col("raw"), F.lit("年")) & ~F.col("raw").rlike("^[0-9]{4}[-/]")
    month, day = (F.regexp_extract("raw", f"^([0-9]{{1,2}}){S}月{S}([0-9]{{1,2}}){S}日", k).try_cast("int") for k in (1, 2))
    inherits = partial & F.col("near").isNotNull() & month.isNotNull()
    value = F.when(inherits, F.concat("near", F.lit("年"), month, F.lit("月"), day, F.lit("日"))).otherwise(compact(F.col("raw")))
    host = F.contains(t, F.lit("主持召开"))
    score = F.when(F.col("alone"), 6).when(explicit, 5).when(host, 4).when(opening, 3).otherwise(2)
    sure = F.when(inherits, 0.78).when(partial & F.col("near").isNull(), 0.65).when(F.col("alone"), 0.82).when(explicit | host, 0.9).when(generic, 0.8).otherwise(0.75)
    evidence = F.when(F.col("alone"), "standalone_meeting_date").when(explicit, "explicit_meeting_date").when(generic, "generic_labeled_meeting_date").otherwise("meeting_opening_date")
    flag = F.when(partial & ~inherits, "medium_risk_partial_date").otherwise("")
    squeezed = compact(t)
    government = squeezed.rlike("第[0-9]+届.*?第[0-9]+次") & F.contains(squeezed, F.lit("会议")) & _any(squeezed, GOVERNMENT)
    name = F.when(F.contains(t, F.lit("等事项")) & (F.col("place") == 1), "opening sentence").when(government, "meeting sentence").when(partial, F.col("raw")).otherwise(value)
    return found.select("doc_id", "pos", score.alias("score"), "raw", value.alias("value"), name.alias("name"), sure.alias("confidence"), evidence.alias("evidence"), flag.alias("flag"))


def best_meeting_date(blocks: DataFrame, century: str = "20") -> DataFrame:
    """meeting_dates, of each document the row with the highest score, then the earliest."""
    rows = meeting_dates(blocks, century)
    rest = [c for c in rows.columns if c not in ("doc_id", "pos", "score")]
    best = rows.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"), *rest)).alias("x"))
    return best.select("doc_id", (-F.col("x.back")).alias("pos"), *[F.col(f"x.{c}").alias(c) for c in ("score", *rest)])
