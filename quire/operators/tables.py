"""Operators over plain tables: rule chains, schema issues, long form, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t


def transformed(df: DataFrame, rules: list[dict]) -> DataFrame:
    """df after the rules in order; each sees what those before it made."""
    for r in rules:
        source = r["source"]
        c = F.col(source) if isinstance(source, str) else None
        made = {
            "trim": lambda: F.trim(c),
            "upper": lambda: F.upper(c),
            "lower": lambda: F.lower(c),
            "rename": lambda: c,
            "merge": lambda: F.concat_ws(r["with"], *r["source"]),
            "split": lambda: F.get(F.split(c, r["by"]), r["index"]),
            "default": lambda: F.coalesce(c, F.lit(r["value"])),
            "null_if": lambda: F.nullif(c, F.lit(r["value"])),
            "enum_map": lambda: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in r["map"].items() for x in kv]), c), c),
            "normalize_number": lambda: t.normalize_number(c.cast("string")),
            "normalize_date": lambda: t.normalize_date(c.cast("string")),
            "normalize_boolean": lambda: t.normalize_boolean(c.cast("string")),
        }
        if r["operation"] not in made:
            raise ValueError(f"unsupported operation {r['operation']}")
        df = df.withColumn(r["target"], made[r["operation"]]())
    return df


def issues(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """df with `issue`: a row for each failed constraint `kind:field`; rows without issues give none."""
    found: list[Column] = []
    for name, rules in schema.items():
        c = F.col(name)
        tests = {
            "required": lambda v, c=c: c.isNull() & F.lit(v),
            "pattern": lambda v, c=c: ~c.rlike(f"^(?:{v})$"),
            "minimum": lambda v, c=c: c < v,
            "maximum": lambda v, c=c: c > v,
            "enum": lambda v, c=c: ~c.isin(*v),
            "max_length": lambda v, c=c: F.length(c) > v,
        }
        found += [F.when(tests[kind](v), F.lit(f"{kind}:{name}")) for kind, v in rules.items()]
    return df.withColumn("issue", F.explode(F.array_compact(F.array(*found))))


def long_form(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): a row for each field, values as text."""
    return df.unpivot(key, [F.col(f).cast("string").alias(f) for f in fields], "field", "value")


def redacted(payload: Column, keys: tuple[str, ...]) -> Column:
    """JSON text with the text and number values of sensitive keys masked, wherever the keys stand."""
    return F.regexp_replace(payload, r'("(?i:' + "|".join(keys) + r')"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false|null)', '$1"[REDACTED]"')
