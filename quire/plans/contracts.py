"""Queries over configurations, tasks and evaluations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import contracts as c
from quire.plans.content import BLOCKS
from quire.plans.registry import query, table
from quire.sources import blocks as b

_KNOWN = ("policy_doc", "meeting_doc", "general_doc")
_HINTED = """'{"schema_hint": ' || CASE o_orderkey % 4 WHEN 0 THEN '"policy_doc"' WHEN 1 THEN '7' ELSE '"other"' END || ', "document_type": ' || CASE WHEN o_orderkey % 3 = 0 THEN '"meeting_doc"' ELSE 'null' END || ', "document": {"document_type": "' || CASE WHEN o_orderkey % 5 < 3 THEN 'general_doc' ELSE 'none' END || '"}}'"""


@query(
    f"""WITH p AS (SELECT o_orderkey, {_HINTED} AS j FROM orders), h AS (SELECT o_orderkey, list_filter([CASE WHEN json_type(j, '$.schema_hint') = 'VARCHAR' THEN j ->> '$.schema_hint' END, j ->> '$.document_type', j ->> '$.document.schema_hint', j ->> '$.document.document_type'], lambda x: x IN ('policy_doc', 'meeting_doc', 'general_doc')) AS hints FROM p)
    SELECT o_orderkey, hints[1] AS hint FROM h"""
)
def s16_route_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known schema that an order's payload hints at."""
    return table(spark, sf_dir, "orders").select("o_orderkey", c.route_hint(F.expr(_HINTED), _KNOWN).alias("hint"))


@query(BLOCKS + "SELECT doc_id, '1.0' AS uir_version, 'sha256:' || sha256(string_agg(text, chr(10) ORDER BY pos)) AS source_hash, CAST(count(*) AS INTEGER) AS n_blocks, min(block_id) AS first_block, printf('b%04d', count(*)) AS last_block, array_to_string(list_sort(list_distinct(list(type))), ',') AS block_types FROM blocks GROUP BY doc_id")
def s19_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows with the ids and kinds of their blocks."""
    return c.document_rows(table(spark, sf_dir, "documents"))


@query("SELECT 'task_' || event_id AS task_id, doc_id, sha256(text) AS input_hash, 'api_key=***;kind=' || event_type || ';note=' AS options FROM events JOIN documents ON doc_id = event_id % 1500")
def s21_new_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks for events whose document is there, with secret options hidden."""
    options = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("api_key"), F.col("user_id").cast("string"), F.lit("note"), F.lit(None).cast("string"))
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 1500).alias("doc_id"), options.alias("options"))
    return c.new_tasks(requests, table(spark, sf_dir, "documents"))


#: Fields of a schema with their types, and the operations of rules on them.
_FIELDS = (("f0", "string"), ("f1", "number"), ("f2", "date"), ("f3", "enum"))
_OPERATIONS = (("trim", 1, ["f0", "f1", "f9"]), ("normalize_number", 2, ["f1"]), ("rename", 0, ["f1", "f3"]))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, 'f' || (l_partkey % 6) AS field_id, CASE l_partkey % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'date' ELSE 'enum' END AS type, CASE l_partkey % 6 WHEN 0 THEN 'trim' WHEN 1 THEN 'rename,trim,normalize_number' WHEN 3 THEN 'rename' ELSE '' END AS operations FROM lineitem WHERE l_partkey % 6 < 4")
def j05_mapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of order lines to fields of a schema, each with the operations of the rules that name its field."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("f"), (F.col("l_partkey") % 6).cast("string")).alias("field_id"))
    found = c.mapped_fields(rows, spark.createDataFrame(_FIELDS, "field_id string, type string"), spark.createDataFrame(_OPERATIONS, "operation string, place int, targets array<string>"))
    return found.select("doc_id", "line", "field_id", "type", F.array_join("operations", ",").alias("operations"))


_LINE = "l_orderkey AS doc_id, 's' || l_linenumber AS source_path"


@query(
    f"""WITH s AS (SELECT {_LINE}, 'f' || (l_partkey % 4) AS field_id, l_linestatus AS st FROM lineitem WHERE l_returnflag <> 'A'), a AS (SELECT doc_id, field_id, source_path, 'accepted' AS outcome FROM s WHERE st = 'F' UNION ALL SELECT doc_id, field_id, source_path, 'review' FROM s WHERE st <> 'F')
    SELECT * FROM a UNION ALL SELECT o_orderkey, f, NULL, 'abstained' FROM orders, (VALUES ('f0'), ('f1')) v(f) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = o_orderkey AND a.field_id = f)"""
)
def m23_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mapping says of each field: accepted, under review or nothing."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").selectExpr("l_orderkey AS doc_id", "concat('s', l_linenumber) AS source_path", "concat('f', l_partkey % 4) AS field_id", "l_linestatus")
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("field_id"))
    return c.predictions(line.where("l_linestatus = 'F'"), line.where("l_linestatus <> 'F'"), fields)


@query(
    """WITH g AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'N' THEN 'review' ELSE 'mapping' END AS kind, l_linenumber AS source, l_partkey % 5 AS target FROM lineitem), x AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'review' END AS status, l_linenumber AS source, (l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) % 5 AS target FROM lineitem),
    h AS (SELECT g.*, EXISTS (SELECT 1 FROM x WHERE x.doc_id = g.doc_id AND x.source = g.source AND x.target = g.target AND x.status = CASE WHEN kind = 'mapping' THEN 'accepted' ELSE 'review' END) AS hit FROM g),
    s AS (SELECT doc_id, count(*) FILTER (kind = 'mapping') AS gold_mappings, count(*) FILTER (kind = 'review') AS gold_reviews, count(*) FILTER (kind = 'mapping' AND hit) AS accepted_correct, count(*) FILTER (kind = 'review' AND hit) AS review_correct FROM h GROUP BY doc_id),
    b AS (SELECT doc_id, count(DISTINCT (source, target)) AS violations FROM x WHERE status = 'accepted' AND (source, target) IN ((2, 4), (3, 0)) GROUP BY doc_id)
    SELECT s.*, coalesce(violations, 0) AS violations, gold_mappings - accepted_correct AS missing, round(accepted_correct / CAST(gold_mappings + gold_reviews AS DOUBLE), 6) AS auto_recall, round((accepted_correct + review_correct) / CAST(gold_mappings + gold_reviews AS DOUBLE), 6) AS assisted_recall FROM s LEFT JOIN b USING (doc_id)"""
)
def g11_gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected mappings and reviews of each order that were met, missed or broke a prohibition."""
    line = table(spark, sf_dir, "lineitem")
    gold = line.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", "review").otherwise("mapping").alias("kind"), F.col("l_linenumber").cast("long").alias("source"), (F.col("l_partkey") % 5).alias("target"))
    moved = (F.col("l_partkey") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)) % 5
    actual = line.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("review").alias("status"), F.col("l_linenumber").cast("long").alias("source"), moved.alias("target"))
    return c.gold_scores(gold, actual, spark.createDataFrame([(2, 4), (3, 0)], "source long, target long"))


@query(
    BLOCKS
    + """, g AS (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 10000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'b9999' ELSE 'b0001' END AS block_id, CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN ' ' ELSE 'v' END AS value FROM (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 11 = 0)),
    f AS (SELECT 'unknown_document' AS fault, count(*) AS n FROM g WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unknown_block', count(*) FROM g WHERE doc_id IN (SELECT doc_id FROM documents) AND (doc_id, block_id) NOT IN (SELECT (doc_id, block_id) FROM blocks)
      UNION ALL SELECT 'empty_value', count(*) FROM g WHERE trim(value) = '' UNION ALL SELECT 'repeated_row', count(*) - count(DISTINCT (doc_id, block_id, value)) FROM g UNION ALL SELECT 'too_few_rows', CASE WHEN count(*) < 1000000 THEN 1 ELSE 0 END FROM g)
    SELECT fault, CAST(n AS BIGINT) AS n FROM f WHERE n > 0"""
)
def e10_gold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with gold rows made of the labels: unknown documents and blocks, empty and repeated values, too few rows."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.unionByName(labels.where("doc_id % 11 = 0"))
    d = F.col("doc_id")
    gold = rows.select((d + F.when(d % 50 == 0, 10_000_000).otherwise(0)).alias("doc_id"), F.when(d % 7 == 0, "b9999").otherwise("b0001").alias("block_id"), F.when((F.col("quality") == 0) & (d % 3 == 0), " ").otherwise("v").alias("value"))
    return c.gold_faults(gold, b.blocks(table(spark, sf_dir, "documents")), 1_000_000)


@query("SELECT o_orderkey AS doc_id, '$.blocks.b0002.text' AS source_path, CASE WHEN o_orderkey % 3 = 0 THEN 'priority' ELSE 'rank' END AS source_name, o_orderpriority AS value FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0")
def p03_named_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from blocks whose attributes name a field."""
    k = F.col("o_orderkey")
    attributes = F.when(k % 4 == 1, '{"field_name": " "}').when(k % 3 == 0, '{"field_name": "priority", "x": 1}').otherwise('{"field_name": " rank"}')
    named = F.struct(F.lit("b0002").alias("block_id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("text"), attributes.alias("attributes"))
    plain = F.struct(F.lit("b0001").alias("block_id"), F.lit("Order").alias("text"), F.lit(None).cast("string").alias("attributes"))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(F.array(plain, named)).alias("x")).select("doc_id", "x.*")
    return c.named_block_candidates(rows)


@query(
    """WITH f AS (SELECT n_nationkey, 'f' || n_nationkey AS field_id, CASE WHEN n_nationkey % 2 = 0 THEN 'enum' ELSE 'string' END AS type, n_name FROM nation), s AS (SELECT DISTINCT s_nationkey, 'S' || (s_suppkey % 7) AS alias FROM supplier),
    a AS (SELECT field_id, list_sort(list_distinct(list_concat([n_name, 'name'], coalesce((SELECT list(alias) FROM s WHERE s_nationkey = n_nationkey), [])))) AS aliases FROM f)
    SELECT field_id, type, array_to_string(aliases, ',') AS aliases, CASE WHEN type = 'enum' THEN 'a,b' ELSE '' END AS allowed, 'max=' || n_nationkey || ';min=0' AS constraints FROM f JOIN a USING (field_id)"""
)
def m22_target_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields made of nations with all their names, of suppliers as rules, and enumerations apart from other constraints."""
    k = F.col("n_nationkey")
    limits = F.create_map(F.lit("min"), F.lit("0"), F.lit("max"), k.cast("string"))
    enum = F.when(k % 2 == 0, F.map_concat(limits, F.create_map(F.lit("enum"), F.lit("a|b")))).otherwise(limits)
    fields = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), k.cast("string")).alias("field_id"), F.when(k % 2 == 0, "enum").otherwise("string").alias("type"), F.array(F.col("n_name"), F.lit("name"), F.lit(" "), F.col("n_name")).alias("aliases"), enum.alias("constraints"))
    rules = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("field_id"), F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("alias"))
    found = c.target_descriptors(fields, rules)
    return found.select("field_id", "type", F.array_join("aliases", ",").alias("aliases"), F.array_join("allowed", ",").alias("allowed"), "constraints")


@query(
    """WITH l AS (SELECT p_partkey, 'f' || (p_size % 6) AS field_id, p_name AS label FROM part), s AS (SELECT field_id, label AS alias, count(DISTINCT p_partkey) AS support FROM l GROUP BY ALL HAVING count(DISTINCT p_partkey) >= 2), t AS (SELECT *, max(support) OVER (PARTITION BY alias) AS top FROM s)
    SELECT field_id, alias, support FROM t WHERE support = top QUALIFY count(*) OVER (PARTITION BY alias) = 1"""
)
def d03_template_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias rules from what parts of a size are called, where one size has a name most often."""
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("f"), (F.col("p_size") % 6).cast("string")).alias("field_id"), F.concat(F.lit(" "), "p_name").alias("label"))
    return c.template_draft(labels)


_PATTERNS = "CASE p_partkey % 6 WHEN 0 THEN '.*' WHEN 1 THEN '^.+$' WHEN 2 THEN NULL ELSE '^' || p_name || '[0-9]+$' END"


@query(
    f"""WITH r AS (SELECT p_partkey AS rule_id, p_brand AS source, 't' || (p_size % 12) AS target, p_partkey % 4 AS evidence, {_PATTERNS} AS pattern FROM part)
    SELECT rule_id, 'missing_evidence' AS risk FROM r WHERE evidence = 0 UNION ALL SELECT rule_id, 'unknown_target' FROM r WHERE target IN ('t10', 't11') UNION ALL SELECT rule_id, 'forbidden_pair' FROM r WHERE source = 'Brand#1' AND target IN ('t3', 't4') UNION ALL SELECT rule_id, 'overbroad_pattern' FROM r WHERE pattern IN ('.*', '^.+$')"""
)
def d04_draft_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of rules made of parts: no evidence, unknown targets, forbidden pairs, patterns that match anything."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("source"), F.concat(F.lit("t"), (F.col("p_size") % 12).cast("string")).alias("target"), (F.col("p_partkey") % 4).alias("evidence"), F.expr(_PATTERNS).alias("pattern"))
    known = spark.createDataFrame([(f"t{k}",) for k in range(10)], "target string")
    return c.draft_risks(rules, known, spark.createDataFrame([("Brand#1", "t3"), ("Brand#1", "t4")], "source string, target string"))
