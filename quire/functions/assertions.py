"""Predicates over values and JSON paths: output assertions, type coercion and schema checks, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Assertion:
    """A named predicate over a JSON path; optional ones are skipped where the path is missing."""

    name: str
    path: str
    operator: str
    argument: object = None
    optional: bool = False


def json_at(payload: Column, path: str) -> Column:
    """The value at a path of `.key` and `[i]` steps of a VARIANT; null if it is missing."""
    return F.try_variant_get(payload, path, "variant")


#: Fixed groups of variant types by the name that an assertion gives.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}


def predicate(payload: Column, a: Assertion) -> Column:
    """Whether the assertion holds of a VARIANT, parsed once for all assertions; null where the path is missing.

    type_is is strict: a boolean is no number. regex_match takes a pattern, or (pattern, mode) with mode search, match or fullmatch.
    number_range takes (low, high) or (low, high, with_low, with_high). Lengths hold for values of their type only, paths where both resolve.
    Formats are Java's.
    """
    value = json_at(payload, a.path)
    kind = F.schema_of_variant(value)
    is_a = lambda name: F.coalesce(sum(kind.startswith(x).cast("int") for x in _TYPES.get(name, (name,))) > 0, F.lit(False))
    text = F.when(is_a("string") | is_a("number") | is_a("boolean"), F.try_variant_get(payload, a.path, "string"))
    number = F.when(is_a("number"), F.try_variant_get(payload, a.path, "double"))
    whole = F.to_json(value)
    formats = lambda: (a.argument,) if isinstance(a.argument, str) else a.argument

    def in_range() -> Column:
        low, high, with_low, with_high = (*a.argument, True, True)[:4] if len(a.argument) < 4 else a.argument
        return ((number >= low) if with_low else (number > low)) & ((number <= high) if with_high else (number < high))

    def matches() -> Column:
        pattern, mode = (a.argument, "search") if isinstance(a.argument, str) else a.argument
        return text.rlike({"search": pattern, "match": rf"\A(?:{pattern})", "fullmatch": rf"\A(?:{pattern})\z"}[mode])

    def array_size() -> Column:
        return F.when(is_a("array"), F.size(F.try_variant_get(payload, a.path, "array<variant>")))

    found = {
        "exists": lambda: F.lit(True),
        "non_empty": lambda: ~F.is_variant_null(value) & ~F.coalesce(F.trim(text) == "", F.lit(False)) & ~F.coalesce(whole.isin("[]", "{}"), F.lit(False)),
        "type_is": lambda: is_a(str(a.argument)),
        "date_format": lambda: F.coalesce(*[F.try_to_date(text, f) for f in formats()]).isNotNull(),
        "datetime_format": lambda: F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats()]).isNotNull(),
        "regex_match": matches,
        "enum_allowed": lambda: text.isin(*a.argument),
        "number_range": in_range,
        "text_length": lambda: is_a("string") & (F.length(text) >= a.argument[0]) & (F.length(text) <= a.argument[1]),
        "array_length": lambda: (array_size() >= a.argument[0]) & (array_size() <= a.argument[1]),
        "url_like": lambda: is_a("string") & text.rlike(r"\A(?i:https?)://[^/?#\s]+"),
        "equal_to_path": lambda: whole == F.to_json(json_at(payload, str(a.argument))),
        "not_equal_to_path": lambda: whole != F.to_json(json_at(payload, str(a.argument))),
    }[a.operator]()
    return F.when(value.isNotNull(), F.coalesce(found, F.lit(False)))


def outcome(payload: Column, a: Assertion, parsed: bool = False) -> Column:
    """passed, failed, missing or skipped, of JSON text, or of a VARIANT if it is parsed."""
    held = predicate(payload if parsed else F.try_parse_json(payload), a)
    return F.when(held.isNull(), "skipped" if a.optional else "missing").when(held, "passed").otherwise("failed")


def coerced(value: Column, kind: str) -> Column:
    """A text value as a target type, null where it cannot be."""
    from quire.functions import text as t

    return {
        "string": lambda: value,
        "text": lambda: value,
        "number": lambda: t.normalize_number(value),
        "boolean": lambda: t.normalize_boolean(value),
        "date": lambda: t.normalize_date(value),
        "array[string]": lambda: F.filter(F.transform(F.split(value, r"[、,，;；\n]"), lambda x: F.trim(x)), lambda x: x != ""),
    }[kind]()
