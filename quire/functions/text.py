"""Scalar functions of the document model, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python and the reference model see it, spelled out so that every engine agrees.
UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{4e00}-\x{9fff}]"
#: Markers of wrongly decoded text.
MOJIBAKE = ("\ufffd", "锛", "鐢", "鏃", "鍙", "绫", "鈥", "\ue57d", "\ue185", "鏈", "鍔", "鏉", "鑱", "娓", "呭")
#: Fixed words left out of keywords.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "are", "was", "not", "you", "all", "but", "can", "from", "has", "have")


def normalize_name(c: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(c), r"[\s_\-]+", "")


def sanitize(c: Column) -> Column:
    """A name of ASCII letters, digits, underscores and CJK; `source` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_\x{4e00}-\x{9fff}]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("source"))


def normalize_spaces(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, UNICODE_SPACE + "+", " "))


def estimate_tokens(c: Column) -> Column:
    """0 for an empty text, else at least 1: CJK characters by 1.5 to a token, others by 4."""
    cjk = F.length(c) - F.length(F.regexp_replace(c, CJK, ""))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(cjk / 1.5 + (F.length(c) - cjk) / 4).cast("int")))


def sentences(c: Column) -> Column:
    """Pieces that end in sentence marks or at a line's end."""
    return F.regexp_extract_all(c, F.lit(r"[^。！？!?\n.]+[。！？!?.]*"), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """Lower-case Latin words of three characters or more, and CJK runs of 2 to 8, without stop words."""
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,8}"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*STOPWORDS))


def infer_type(c: Column) -> Column:
    """boolean, number, date or string, by the form of a text value."""
    return (
        F.when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"), "date")
        .when(c.rlike(r"^[¥￥$]?-?[0-9][0-9,]*(\.[0-9]+)?元?$"), "number")
        .otherwise("string")
    )


def value_shape(c: Column) -> Column:
    """The coarse form of a text value."""
    return (
        F.when(c.isNull(), "null")
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(c.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"), "date_like")
        .when(c.rlike(r"^[A-Za-z0-9_-]+$"), "alphanumeric_text")
        .otherwise("text")
    )


def normalize_date(c: Column) -> Column:
    """An ISO date from year, month and day with any of the usual marks; null if the calendar has no such day."""
    part = lambda k: F.regexp_extract(c, r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?", k)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.date_format(F.try_to_date(F.when(part(1) != "", iso), "yyyy-MM-dd"), "yyyy-MM-dd")


def normalize_number(c: Column) -> Column:
    """A double from a text with thousands marks and currency signs; null if there is none."""
    return F.regexp_replace(c, r"[,\s￥¥元]", "").try_cast("double")


def normalize_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "1"), F.lit(True)).when(low.isin("false", "no", "0"), F.lit(False))


def count_of(c: Column, term: str) -> Column:
    """Times that a term occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def mojibake_ratio(c: Column) -> Column:
    """Markers of wrong decoding by characters; 0 for an empty text."""
    hits = reduce(lambda a, b: a + b, [count_of(c, m) for m in MOJIBAKE])
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(hits / F.length(c))


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def confidence_tier(c: Column, high: float = 0.9, medium: float = 0.7) -> Column:
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def safe_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def substring_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of low to high characters of a text."""
    # a match at each character looks ahead over the run: one pass a length, where cutting each run out counts characters from the beginning again
    one = lambda n: F.coalesce(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(low, high + 1)])
