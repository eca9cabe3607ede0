"""Queries over input lines, labels, table rows, retrieval projections and strategy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import canonical
from quire.functions import text as t
from quire.operators import chunks
from quire.plans.content import BLOCKS
from quire.plans.registry import query, table
from quire.sources import blocks as b
from quire.sources import jsonl


@query("SELECT event_id, event_id % 10 <> 1 AND event_id % 10 <> 2 AS fine, CASE event_id % 10 WHEN 1 THEN 'not an object' WHEN 2 THEN 'broken' END AS error, CASE WHEN event_id % 10 > 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 10 <> 0")
def s02_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank, broken and other than object lines among them."""
    n = F.col("event_id") % 10
    lines = table(spark, sf_dir, "events").select("event_id", F.when(n == 0, " \t").when(n == 1, "[1, 2]").when(n == 2, F.concat("props", F.lit("]"))).otherwise(F.col("props")).alias("line"))
    return jsonl.checked(lines).select("event_id", F.col("error").isNull().alias("fine"), "error", F.try_variant_get("row", "$.k", "bigint").alias("k"))


@query("""SELECT event_id, '{"a":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"text":"x\\ny"}' AS body, sha256('{"a":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"text":"x\\ny"}') AS hash FROM events""")
def f45_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical JSON without operational keys, and its hash."""
    payload = F.concat(F.lit('{"text": "x\\r\\ny", "task_id": 7, "a": '), F.regexp_replace("props", r"\}$", ', "duration": 3}'), F.lit("}"))
    body = canonical.canonical_json(payload, canonical.OPERATIONAL_KEYS)
    return table(spark, sf_dir, "events").select("event_id", body.alias("body")).withColumn("hash", F.sha2("body", 256))


@query("SELECT p_partkey, 'Part' || CAST(p_size AS VARCHAR) || 'no' AS label FROM part")
def f03_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels in full-width forms with marks, folded."""
    written = F.concat(F.lit("Ｐａｒｔ（"), F.col("p_size"), F.lit("） - _no："))
    return table(spark, sf_dir, "part").select("p_partkey", canonical.normalize_label(written).alias("label"))


@query("SELECT l_orderkey AS doc_id, '$.blocks.' || l_orderkey || '.rows.' || (n - 1) AS source_path, l_returnflag AS source_name, CAST(l_linenumber AS VARCHAR) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE l_returnflag <> 'N'")
def p02_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from table rows whose field is a string, with orders as tables and their lines as rows."""
    field = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", field.alias("field"))
    tables = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    each = tables.select("doc_id", F.posexplode("rows").alias("i", "x")).where("x.field is not null")
    return each.select("doc_id", F.concat(F.lit("$.blocks."), "doc_id", F.lit(".rows."), "i").alias("source_path"), F.col("x.field").alias("source_name"), F.col("x.l_linenumber").cast("string").alias("sample"))


#: Labels of a profile by target.
PROFILE = {"state": ("Status", "状态"), "urgency": ("Priority",), "owner": ("Clerk",)}


@query("SELECT o_orderkey AS doc_id, unnest(['state', 'urgency']) AS target_id, unnest(['Status', 'Priority']) AS label, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders")
def x03_profile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values after a profile's labels, up to the end of the line or a mark; each label is tried in the block's own row."""
    text = F.concat(F.lit("Status： "), "o_orderstatus", F.lit("；Priority:"), "o_orderpriority", F.lit("\nend。"))
    tries = [F.struct(F.lit(k).alias("target_id"), F.lit(x).alias("label"), F.trim(F.regexp_extract("text", x + r"[ \t]*[:：][ \t]*([^\n。；;]+)", 1)).alias("value")) for k, v in PROFILE.items() for x in v]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.explode(F.filter(F.array(*tries), lambda x: x["value"] != "")).alias("x")).select("doc_id", "x.*")


@query(
    """WITH p AS (SELECT * FROM (VALUES ('flat_blocks', false, false, false), ('heading_aware', true, false, false), ('keyword_enriched', true, true, false), ('table_protected', true, false, true), ('hybrid', true, true, true)) AS v(strategy, title, words, boost))
    SELECT strategy, p_container AS type, CAST(count(CASE WHEN title THEN 1 END) AS BIGINT) AS titled, CAST(sum(CASE WHEN words THEN 1 ELSE 0 END) AS BIGINT) AS with_keywords, CAST(sum(length(p_name) + CASE WHEN boost AND p_container IN ('table', 'list') THEN 27 ELSE 0 END) AS BIGINT) AS n_chars
    FROM (SELECT p_name, CASE p_size % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'list' ELSE 'paragraph' END AS p_container FROM part), p GROUP BY ALL"""
)
def p19_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as five retrieval strategies show them, parts being the chunks."""
    kind = F.when(F.col("p_size") % 3 == 0, "table").when(F.col("p_size") % 3 == 1, "list").otherwise("paragraph")
    rows = table(spark, sf_dir, "part").select(kind.alias("type"), F.col("p_name").alias("text"), F.col("p_brand").alias("title"), F.array("p_brand").alias("keywords"))
    shown = chunks.projected(rows).groupBy("strategy", "type")
    return shown.agg(F.count("title").alias("titled"), F.sum(F.size("keywords").cast("long")).alias("with_keywords"), F.sum(F.length("text").cast("long")).alias("n_chars"))


_ROUTES = "WITH c AS (SELECT l_orderkey, l_returnflag AS schema_id, max(l_discount) AS confidence FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, schema_id) AS k FROM c), e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS expected FROM orders), s AS (SELECT o_orderkey, any_value(expected) AS expected, bool_or(k = 1 AND schema_id = expected) AS top1, bool_or(k <= 2 AND schema_id = expected) AS top2, bool_or(k = 1 AND schema_id <> expected AND confidence >= 0.05) AS unsafe, bool_or(k = 1 AND confidence < 0.05) AS review FROM r JOIN e ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order as a routed document: candidate schemas are its flags, the best discount their confidence."""
    known = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("schema_id")).agg(F.max("l_discount").alias("confidence"))
    ranked = known.groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("down"), "schema_id"))), 1, 2).alias("best"))
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A").alias("expected"))
    rows = ranked.join(expected, F.col("l_orderkey") == F.col("o_orderkey"))
    first = F.col("best")[0]
    top1, sure = first["schema_id"] == F.col("expected"), -first["down"] >= 0.05
    return rows.select("o_orderkey", "expected", top1.alias("top1"), F.exists("best", lambda x: x["schema_id"] == F.col("expected")).alias("top2"), (~top1 & sure).alias("unsafe"), (~sure).alias("review"))


@query(_ROUTES + " SELECT * FROM s")
def e07_route_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each routed document against its expected schema; unsafe is wrong and not up for review."""
    return _routes(spark, sf_dir)


@query(_ROUTES + " SELECT expected, count(*) AS n, round(avg(top1::INT), 4) AS top1_accuracy, round(avg(top2::INT), 4) AS top2_accuracy, count(*) FILTER (unsafe) AS unsafe_count, count(*) FILTER (review) AS review_count FROM s GROUP BY expected")
def g20_router_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the first and of the first two routes, and what is unsafe or up for review, by expected schema."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    return _routes(spark, sf_dir).groupBy("expected").agg(F.count("*").alias("n"), share("top1").alias("top1_accuracy"), share("top2").alias("top2_accuracy"), F.count_if("unsafe").alias("unsafe_count"), F.count_if("review").alias("review_count"))


@query(
    BLOCKS
    + """, s AS (SELECT doc_id, pos, text, type, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM blocks WHERE type <> 'empty'),
    c AS (SELECT 'source_block' AS strategy, 1 AS n_blocks, CAST(type = 'heading' AS INTEGER) AS titled, text FROM s UNION ALL SELECT 'section', count(*), max(CAST(type = 'heading' AS INTEGER)), string_agg(text, chr(10) ORDER BY pos) FROM s GROUP BY doc_id, section),
    m AS (SELECT strategy, count(*) AS n_chunks, round(avg(n_blocks), 4) AS blocks_a_chunk, round(avg(titled), 4) AS titled_share, round(1 - count(DISTINCT sha256(text)) / count(*), 4) AS duplicate_share FROM c GROUP BY strategy)
    SELECT *, row_number() OVER (ORDER BY titled_share DESC, duplicate_share, strategy) AS place FROM m"""
)
def g14_strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways of chunking the corpus compared and ranked. Two strategies give two rows to the last window."""
    rows = b.sections(b.blocks(table(spark, sf_dir, "documents")).where("type <> 'empty'"))
    titled = (F.col("type") == "heading").cast("int")
    one = rows.select(F.lit("source_block").alias("strategy"), F.lit(1).cast("long").alias("n_blocks"), titled.alias("titled"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    two = rows.groupBy("doc_id", "section").agg(F.lit("section").alias("strategy"), F.count("*").alias("n_blocks"), F.max(titled).alias("titled"), joined.alias("text")).drop("doc_id", "section")
    rounded = lambda c: F.round(c, 4)
    both = one.unionByName(two).withColumn("h", F.sha2("text", 256)).groupBy("strategy", "h").agg(F.count("*").alias("n"), F.sum("n_blocks").alias("blocks"), F.sum("titled").alias("titled"))
    found = both.groupBy("strategy").agg(F.sum("n").alias("n_chunks"), rounded(F.sum("blocks") / F.sum("n")).alias("blocks_a_chunk"), rounded(F.sum("titled") / F.sum("n")).alias("titled_share"), rounded(1 - F.count("*") / F.sum("n")).alias("duplicate_share"))
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("titled_share"), "duplicate_share", "strategy")))


@query(BLOCKS + ", k AS (SELECT doc_id, block_id, type, text, count(*) FILTER (type = 'heading') OVER (PARTITION BY doc_id ORDER BY pos) AS heads FROM blocks) SELECT doc_id, block_id, unnest(list_filter([CASE WHEN type = 'empty' THEN 'empty_text' END, CASE WHEN heads = 0 THEN 'missing_title' END, CASE WHEN length(text) > 4000 THEN 'overlong' END], lambda x: x IS NOT NULL)) AS issue FROM k")
def t08_chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of chunks, a row each."""
    issues = {"empty_text": F.col("type") == "empty", "missing_title": F.col("section") == 0, "overlong": F.length("text") > 4000}
    rows = b.sections(b.blocks(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "block_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in issues.items()]))).alias("issue"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size % 6 + 1 WHEN p_size % 4 = 1 THEN p_size % 6 + 1 WHEN p_size % 4 = 2 THEN 1 END AS level FROM part")
def f52_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first valid level among several attributes, numbers or words such as h2; a heading without any is of level 1, other types have none."""
    n, kind = F.col("p_size") % 6 + 1, F.col("p_size") % 4
    attributes = [F.when(kind == 0, F.concat(F.lit("h"), n)).when(kind == 1, F.lit("deep")), F.when(kind == 1, n.cast("string"))]
    level = F.coalesce(*[F.regexp_extract(a, r"\A[hH]?([1-6])\z", 1).try_cast("int") for a in attributes])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(level, F.when(kind == 2, 1)).alias("level"))


@query()
def c01_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text packed by sentences to a token budget; tests hold its properties."""
    return chunks.fixed_window(table(spark, sf_dir, "documents"), 256).select("doc_id", "chunk_index", "token_count", "n_sources", t.text_hash(F.col("text")).alias("text_hash"))
