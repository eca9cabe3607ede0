"""JSON lines as rows: what each line holds, and which lines are at fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines without the blank ones, with `row` (VARIANT, null if at fault) and `error` (null if fine): every line must be one JSON object."""
    # in a list of two, because the parser itself stops after the first value and does not see what follows it
    pair = F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("\n,0]")))
    value = F.when(F.to_json(pair).endswith(",0]") & F.try_variant_get(pair, "$[2]", "variant").isNull() & F.try_variant_get(pair, "$[1]", "variant").isNotNull(), F.try_variant_get(pair, "$[0]", "variant"))
    error = F.when(value.isNull(), "broken").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    return lines.where(F.trim(F.regexp_replace(line, r"[\t\r]", " ")) != "").withColumn("error", error).withColumn("row", F.when(F.col("error").isNull(), value))


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, row, error) of the text files at a path."""
    return checked(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))
