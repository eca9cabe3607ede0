"""Rows of configurations, tasks and evaluations: hints, joins of rules, documents and tasks as rows, predictions, gold scores and gold faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import safe_ratio
from quire.sources import blocks as b

#: Where a payload may name its schema, the first place first.
HINTS = ("$.schema_hint", "$.document_type", "$.document.schema_hint", "$.document.document_type")


def route_hint(payload: Column, known: tuple[str, ...]) -> Column:
    """The first known schema id among a JSON payload's hints; null without one."""
    v = F.try_parse_json(payload)
    hints = F.array(*[F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string")) for p in HINTS])
    return F.get(F.filter(hints, lambda x: x.isin(*known)), F.lit(0))


def block_title_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, title_path): for each line that is not blank, the path of titles it stands under; empty before the first heading. One pass over each document's lines, no shuffle."""
    marks = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), (F.trim(x) != "").alias("on")))
    rows = b.title_path_arrays(documents, marks.alias("lines"))
    filled = lambda low, high: F.filter(F.slice("lines", low + 1, high - low), lambda x: x["on"])
    ends = F.concat(F.slice("pos", 2, F.greatest(F.size("pos"), F.lit(1))), F.array(F.size("lines")))
    under = F.flatten(F.transform(F.arrays_zip(F.col("pos").alias("low"), ends.alias("high"), F.col("title_path").alias("path")), lambda s: F.transform(filled(s["low"], s["high"]), lambda x: F.struct(x["pos"].alias("pos"), s["path"].alias("title_path")))))
    before = F.transform(filled(F.lit(0), F.coalesce(F.get("pos", F.lit(0)), F.size("lines"))), lambda x: F.struct(x["pos"].alias("pos"), F.lit("").alias("title_path")))
    found = rows.select("doc_id", F.explode(F.concat(before, F.when(F.size("pos") > 0, under).otherwise(F.array().cast("array<struct<pos:int,title_path:string>>")))).alias("x"))
    return found.select("doc_id", "x.pos", "x.title_path")


def mapped_fields(mappings: DataFrame, fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(mapping columns, type, operations): mappings(doc_id, field_id, ...) whose field stands in fields(field_id, type), with the operations of rules(operation, place, targets ARRAY<STRING>) for it, in order of place."""
    each = rules.select("operation", "place", F.explode("targets").alias("field_id"))
    ops = each.groupBy("field_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "operation"))), lambda x: x["operation"]).alias("operations"))
    return mappings.join(fields.select("field_id", "type"), "field_id").join(ops, "field_id", "left").withColumn("operations", F.coalesce("operations", F.array().cast("array<string>")))


def document_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, uir_version, source_hash, n_blocks, first_block, last_block, block_types): each document with the ids and kinds of its blocks; a null text has one empty block."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    kinds = F.array_sort(F.array_distinct(F.transform(lines, lambda x, i: b.block_type(x, i))))
    return documents.select("doc_id", F.lit("1.0").alias("uir_version"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("source_hash"), F.size(lines).alias("n_blocks"), F.lit("b0001").alias("first_block"), F.format_string("b%04d", F.size(lines)).alias("last_block"), F.array_join(kinds, ",").alias("block_types"))


def new_tasks(requests: DataFrame, documents: DataFrame, secret: str = "(?i)(key|token|secret|password)") -> DataFrame:
    """(task_id, doc_id, input_hash, options): tasks of requests(request_id, doc_id, options MAP<STRING, STRING>) whose document is there; values of options that look secret are hidden."""
    held = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_hash"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("options"), lambda x: F.concat(x["key"], F.lit("="), F.when(x["key"].rlike(secret), "***").otherwise(F.coalesce(x["value"], F.lit("")))))), ";")
    return requests.join(held, "doc_id").select(F.concat(F.lit("task_"), F.col("request_id").cast("string")).alias("task_id"), "doc_id", "input_hash", shown.alias("options"))


def predictions(mappings: DataFrame, reviews: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, field_id, source_path, outcome): accepted rows of mappings(doc_id, field_id, source_path), those under review of reviews (same columns), and an abstention for every one of fields(doc_id, field_id) with neither."""
    said = mappings.select("doc_id", "field_id", "source_path").withColumn("outcome", F.lit("accepted")).unionByName(reviews.select("doc_id", "field_id", "source_path").withColumn("outcome", F.lit("review")))
    silent = fields.select("doc_id", "field_id").join(said.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti")
    return said.unionByName(silent.select("doc_id", "field_id", F.lit(None).cast("string").alias("source_path"), F.lit("abstained").alias("outcome")))


def gold_scores(gold: DataFrame, actual: DataFrame, forbidden: DataFrame) -> DataFrame:
    """A row for each doc_id of gold(doc_id, kind, source, target): how many expected mappings (kind `mapping`) were accepted, how many expected reviews (`review`) are under review, what is missing, and forbidden pairs that were accepted.

    actual(doc_id, status, source, target), status `accepted` or `review`; forbidden(source, target). A gold row counts once, however many rows match it.
    """
    want = gold.select("doc_id", "kind", "source", "target").withColumn("status", F.when(F.col("kind") == "mapping", "accepted").otherwise("review"))
    hit = want.join(actual.select("doc_id", "status", "source", "target").distinct().withColumn("hit", F.lit(1)), ["doc_id", "status", "source", "target"], "left")
    count = lambda c: F.count_if(c)
    sums = hit.groupBy("doc_id").agg(count(F.col("kind") == "mapping").alias("gold_mappings"), count(F.col("kind") == "review").alias("gold_reviews"), count((F.col("kind") == "mapping") & F.col("hit").isNotNull()).alias("accepted_correct"), count((F.col("kind") == "review") & F.col("hit").isNotNull()).alias("review_correct"))
    bad = actual.where("status = 'accepted'").join(forbidden.select("source", "target").distinct(), ["source", "target"]).groupBy("doc_id").agg(F.count_distinct("source", "target").alias("violations"))
    signals = F.col("gold_mappings") + F.col("gold_reviews")
    rows = sums.join(bad, "doc_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
    ratio = lambda a, n: F.round(safe_ratio(a.cast("double"), n), 6)
    return rows.withColumns({"missing": F.col("gold_mappings") - F.col("accepted_correct"), "auto_recall": ratio(F.col("accepted_correct"), signals), "assisted_recall": ratio(F.col("accepted_correct") + F.col("review_correct"), signals)})


def gold_faults(gold: DataFrame, blocks: DataFrame, least_rows: int) -> DataFrame:
    """(fault, n) of gold(doc_id, block_id, value): rows of unknown documents or blocks by blocks(doc_id, block_id), rows without a value, repeated rows, and 1 for fewer than least_rows rows; only faults that occur."""
    docs = blocks.select("doc_id").distinct()
    known = gold.join(docs, "doc_id", "left_semi")
    parts = [
        gold.join(docs, "doc_id", "left_anti").select(F.lit("unknown_document").alias("fault"), F.lit(1).alias("k")),
        known.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti").select(F.lit("unknown_block").alias("fault"), F.lit(1).alias("k")),
        gold.where(F.trim(F.coalesce("value", F.lit(""))) == "").select(F.lit("empty_value").alias("fault"), F.lit(1).alias("k")),
        gold.groupBy("doc_id", "block_id", "value").count().where("count > 1").select(F.lit("repeated_row").alias("fault"), (F.col("count") - 1).alias("k")),
        gold.agg(F.count("*").alias("n")).where(F.col("n") < least_rows).select(F.lit("too_few_rows").alias("fault"), F.lit(1).alias("k")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("fault").agg(F.sum("k").cast("long").alias("n"))


def named_block_candidates(blocks: DataFrame) -> DataFrame:
    """(doc_id, source_path, source_name, value): a candidate for each of blocks(doc_id, block_id, text, attributes) whose attributes, a JSON object, name a field; the value is its text, trimmed."""
    name = F.try_variant_get(F.try_parse_json("attributes"), "$.field_name", "string")
    rows = blocks.select("doc_id", "block_id", "text", F.trim(name).alias("source_name")).where((F.col("source_name") != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return rows.select("doc_id", F.concat(F.lit("$.blocks."), "block_id", F.lit(".text")).alias("source_path"), "source_name", F.trim("text").alias("value"))


def target_descriptors(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """(field_id, type, aliases, allowed, constraints): fields(field_id, type, aliases ARRAY<STRING>, constraints MAP<STRING, STRING>) with all their names of either table, sorted and once each, and `enum` apart from the other constraints.

    aliases(field_id, alias) are those of rules. An enumeration is a text with bars between its values.
    """
    more = aliases.groupBy("field_id").agg(F.collect_set("alias").alias("more"))
    rows = fields.join(more, "field_id", "left")
    none = F.array().cast("array<string>")
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("aliases", none), F.coalesce("more", none)), lambda a: F.coalesce(F.trim(a), F.lit("")) != "")))
    rest = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("constraints", lambda k, _: k != "enum")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return rows.select("field_id", "type", names.alias("aliases"), F.coalesce(F.split(F.col("constraints")["enum"], r"\|"), none).alias("allowed"), F.coalesce(rest, F.lit("")).alias("constraints"))


def template_draft(labels: DataFrame, least: int = 2) -> DataFrame:
    """(field_id, alias, support): alias rules from labels(doc_id, field_id, label): each label that `least` documents or more give a field, and that no other field has as often."""
    counts = labels.where(F.trim(F.coalesce("label", F.lit(""))) != "").groupBy("field_id", F.trim("label").alias("alias")).agg(F.count_distinct("doc_id").alias("support")).where(F.col("support") >= least)
    most = counts.groupBy("alias").agg(F.max("support").alias("top"), F.max_by("field_id", "support").alias("best"), F.count("*").alias("n"))
    tied = counts.join(most, "alias").groupBy("alias").agg(F.count_if(F.col("support") == F.col("top")).alias("firsts"))
    return counts.join(most, "alias").join(tied, "alias").where((F.col("support") == F.col("top")) & (F.col("firsts") == 1)).select("field_id", "alias", "support")


def draft_risks(rules: DataFrame, targets: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(rule_id, risk) of rules(rule_id, source, target, evidence, pattern): missing_evidence, unknown_target (not in targets(target)), forbidden_pair (in forbidden(source, target)), overbroad_pattern (it matches an empty text or a stranger's)."""
    broad = F.regexp_like(F.lit(""), F.col("pattern")) | F.regexp_like(F.lit("§ stranger 0 §"), F.col("pattern"))
    told = lambda rows, risk: rows.select("rule_id", F.lit(risk).alias("risk"))
    parts = [
        told(rules.where(F.coalesce("evidence", F.lit(0)) <= 0), "missing_evidence"),
        told(rules.join(targets.select("target"), "target", "left_anti"), "unknown_target"),
        told(rules.join(forbidden.select("source", "target").distinct(), ["source", "target"], "left_semi"), "forbidden_pair"),
        told(rules.where("pattern is not null").where(broad), "overbroad_pattern"),
    ]
    return reduce(DataFrame.unionByName, parts)
