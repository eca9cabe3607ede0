"""JSON trees as rows: nested sections in reading order, values by path, and how two trees differ. A loop goes down one level a turn and ends at the first empty one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import written


def _children(rows: DataFrame, inside: Column) -> DataFrame:
    """rows with (pos, key, value): a row for each member of the container `inside`; none if it is null or no container."""
    spark = rows.sparkSession
    return rows.withColumn("_in", inside).where("_in is not null").lateralJoin(spark.tvf.variant_explode(F.col("_in").outer())).drop("_in")


def _levels(first: DataFrame, deeper: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The first level and all below it, each written before the next is made, so that a plan never holds more than one."""
    found, level = [], written(first)
    while not level.isEmpty():
        found.append(level)
        level = written(deeper(level))
    return found or [level]


def _text(v: Column, path: str) -> Column:
    """The string at a path of a VARIANT, null if it is empty or no string."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def section_blocks(payloads: DataFrame, sections: str = "$.document.sections", base: str = "payload.document.sections") -> DataFrame:
    """(id, pos, block_id, type, level, text, rows, external_path) of payloads(id, payload): each tree of sections in reading order, at any depth.

    A section gives a heading (its `heading`, else its `title`), its paragraphs, its tables (`rows` as JSON) and then its children. What is no object, no text or no list
    of rows is passed over; payloads that are null or no JSON have no rows. Each level of all documents is one step in Spark, however deep any one of them is.
    """
    tree = payloads.select("id", F.try_variant_get(F.try_parse_json("payload"), sections, "variant").alias("v"))
    below = F.array().cast("array<int>")

    def numbered(rows: DataFrame) -> DataFrame:
        """Members of the list `v` as sections: their place in reading order and their path."""
        each = _children(rows, F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v"))).drop("v").where(F.schema_of_variant("value").startswith("OBJECT"))
        return each.select("id", F.concat("order", F.array("pos")).alias("order"), (F.col("level") + 1).alias("level"), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path"), F.col("value").alias("section"))

    def children(level: DataFrame) -> DataFrame:
        inside = F.try_variant_get("section", "$.children", "variant")
        return numbered(level.select("id", F.concat("order", F.array(F.lit(3))).alias("order"), "level", F.concat("path", F.lit(".children")).alias("path"), inside.alias("v")))

    levels = _levels(numbered(tree.select("id", below.alias("order"), F.lit(0).alias("level"), F.lit(base).alias("path"), "v")), children)
    every = reduce(DataFrame.unionByName, levels)
    none = F.lit(None).cast("string")
    heads = every.select("id", F.concat("order", F.array(F.lit(0))).alias("order"), F.lit("heading").alias("type"), "level", F.coalesce(_text(F.col("section"), "$.heading"), _text(F.col("section"), "$.title")).alias("text"), none.alias("rows"), "path").where("text is not null")

    def listed(name: str, place: int) -> DataFrame:
        lists = F.try_variant_get("section", f"$.{name}", "variant")
        rows = _children(every, F.when(F.schema_of_variant(lists).startswith("ARRAY"), lists))
        return rows.withColumns({"order": F.concat("order", F.array(F.lit(place), F.col("pos"))), "path": F.concat("path", F.lit(f".{name}["), F.col("pos").cast("string"), F.lit("]"))})

    said = listed("paragraphs", 1).select("id", "order", F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), _text(F.col("value"), "$").alias("text"), none.alias("rows"), "path").where("text is not null")
    kind = F.schema_of_variant("value")
    cells = F.when(kind.startswith("OBJECT"), F.try_variant_get("value", "$.rows", "variant")).otherwise(F.col("value"))
    tables = listed("tables", 2).withColumn("cells", cells).where(F.schema_of_variant("cells").startswith("ARRAY"))
    tables = tables.select("id", "order", F.lit("table").alias("type"), F.lit(None).cast("int").alias("level"), none.alias("text"), F.to_json("cells").alias("rows"), "path")
    # one document's blocks in order: as many as its tree has nodes
    members = F.array_sort(F.collect_list(F.struct("order", "type", "level", "text", "rows", "path")))
    placed = heads.unionByName(said).unionByName(tables).groupBy("id").agg(members.alias("m")).select("id", F.posexplode("m").alias("pos", "x"))
    return placed.select("id", "pos", F.format_string("b%03d", F.col("pos") + 1).alias("block_id"), "x.type", "x.level", "x.text", "x.rows", F.col("x.path").alias("external_path"))


def _kind(v: Column) -> Column:
    of = F.schema_of_variant(v)
    return F.when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").otherwise("number")


def tree_values(trees: DataFrame, ignored: tuple[str, ...] = (), keep_json: bool = False) -> DataFrame:
    """(id, path, kind, value) of trees(id, payload): a row for each node of each JSON tree, its path like $.a[0].b; the value of an object, a list or a null is null. With keep_json also `json`, the node as it stands.

    Members under one of the keys `ignored` are left out with all below them. Payloads that are null or no JSON give no rows.
    """
    first = trees.select("id", F.try_parse_json("payload").alias("v")).where("v is not null").select("id", F.lit("$").alias("path"), _kind(F.col("v")).alias("kind"), "v")

    def deeper(level: DataFrame) -> DataFrame:
        rows = _children(level.where("kind in ('object', 'array')").select("id", "path", "v"), F.col("v")).drop("v")
        kept = rows.where(F.col("key").isNull() | ~F.coalesce("key", F.lit("")).isin(*ignored)) if ignored else rows
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key"))
        return kept.select("id", path.alias("path"), _kind(F.col("value")).alias("kind"), F.col("value").alias("v"))

    every = reduce(DataFrame.unionByName, _levels(first, deeper))
    return every.select("id", "path", "kind", F.when(F.col("kind").isin("string", "number", "boolean"), F.try_variant_get("v", "$", "string")).alias("value"), *([F.to_json("v").alias("json")] if keep_json else []))


def tree_differences(left: DataFrame, right: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, change, left_value, right_value, other_path): where the trees of left(id, payload) and right(id, payload) of one id differ.

    change: `retyped` and `changed` at a path that both have; `lost` and `added` where one has it; `moved` for a value that is lost at one path and added at one other and nowhere else
    in that id, with the path it went to. Nodes are compared by an equality join on (id, path).
    """
    a, b = tree_values(left, ignored), tree_values(right, ignored)
    both = a.select("id", "path", F.col("kind").alias("lk"), F.col("value").alias("lv")).join(b.select("id", "path", F.col("kind").alias("rk"), F.col("value").alias("rv")), ["id", "path"], "full")
    change = F.when(F.col("rk").isNull(), "lost").when(F.col("lk").isNull(), "added").when(F.col("lk") != F.col("rk"), "retyped").when(~F.col("lv").eqNullSafe(F.col("rv")), "changed")
    found = written(both.withColumn("change", change).where("change is not null"))
    value = [F.coalesce("lk", "rk").alias("kind"), F.coalesce("lv", "rv").alias("value")]
    ends = found.where("change in ('lost', 'added') and coalesce(lv, rv) is not null").select("id", *value, "change", "path")
    pairs = ends.groupBy("id", "kind", "value").agg(F.count_if(F.col("change") == "lost").alias("n_lost"), F.count_if(F.col("change") == "added").alias("n_added"), F.max(F.when(F.col("change") == "lost", F.col("path"))).alias("path"), F.max(F.when(F.col("change") == "added", F.col("path"))).alias("to"))
    moved = pairs.where("n_lost = 1 and n_added = 1").select("id", "path", "to")
    gone = moved.select("id", F.explode(F.array("path", "to")).alias("path"), F.col("path").alias("from"), "to")
    marked = found.join(gone, ["id", "path"], "left").where("to is null or path = from")
    return marked.select("id", "path", F.when(F.col("to").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), F.col("lv").alias("left_value"), F.col("rv").alias("right_value"), F.col("to").alias("other_path"))
