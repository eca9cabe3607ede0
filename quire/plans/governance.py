"""Queries over records: lineage, reviews, knowledge packs, catalogues, set comparisons, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import lineage, states
from quire.plans.registry import query, table
from quire.streaming import events as stream
from quire.streaming import packs

_EDGES = """edges AS (SELECT 'region:' || n_regionkey AS src, 'contains' AS kind, 'nation:' || n_nationkey AS dst FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'contains', 'customer:' || c_custkey FROM customer UNION SELECT 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey FROM orders)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, a, src, kind, b, dst: table(spark, sf_dir, name).select(F.concat(F.lit(f"{a}:"), src).alias("src"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{b}:"), dst).alias("dst"))
    return lineage.edges(part("nation", "region", "n_regionkey", "contains", "nation", "n_nationkey"), part("customer", "nation", "c_nationkey", "contains", "customer", "c_custkey"), part("orders", "customer", "o_custkey", "placed", "order", "o_orderkey"))


@query(f"WITH {_EDGES} SELECT substr(sha256(src || '|' || kind || '|' || dst), 1, 16) AS edge_id, src, kind, dst FROM edges")
def l01_lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of several kinds, each once, with content ids."""
    return _edges(spark, sf_dir)


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, dst, depth + 1 FROM walk JOIN edges ON node = src WHERE depth < 8) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY root, node")
def l02_lineage_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below each region within eight steps, at least depth."""
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("root")).withColumn("node", F.col("root"))
    return lineage.reach(lineage.written(_edges(spark, sf_dir).select("src", "dst")), start, 8)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def j17_broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which an end is no node among customers in credit."""
    good = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return table(spark, sf_dir, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT count(DISTINCT l_orderkey) AS traced, (SELECT count(*) FROM orders) AS total, round(count(DISTINCT l_orderkey) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 4) AS coverage FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def g06_lineage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have a traced part."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("part", F.lit(True))
    counts = table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left").agg(F.count("part").alias("traced"), F.count("*").alias("total"))
    return counts.select("traced", "total", F.round(F.col("traced") / F.col("total"), 4).alias("coverage"))


@query("SELECT o_orderpriority AS scope, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'P') AS rejected, round(count(*) FILTER (o_orderstatus <> 'O') / CAST(count(*) AS DOUBLE), 4) AS resolution_rate FROM orders GROUP BY 1")
def g23_review_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by status and how many are settled; orders stand for reviews."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scope")).agg(F.count_if(s == "O").alias("pending"), F.count_if(s == "F").alias("approved"), F.count_if(s == "P").alias("rejected"), F.round(F.count_if(s != "O") / F.count("*"), 4).alias("resolution_rate"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1 AS same_scope FROM orders WHERE o_orderstatus = 'O'")
def j18_same_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other pending reviews of one scope, counted by an aggregate and a join instead of all pairs."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    sizes = pending.groupBy("o_custkey", "o_orderpriority").agg((F.count("*") - 1).alias("same_scope"))
    return pending.join(sizes, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "same_scope")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) = 1 AND bool_and(o_totalprice < 400000) AS may_batch, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def r03_batch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pending reviews of a customer may be approved together."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(((F.count_distinct("o_orderpriority") == 1) & F.bool_and(F.col("o_totalprice") < 400000)).alias("may_batch"), F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS at, count(*) AS changes FROM events GROUP BY user_id")
def r02_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each subject from appended changes."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("at"), F.count("*").alias("changes"))


@query("WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT before, event_type AS after, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY ALL")
def r08_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between states."""
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).where("before is not null").groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase') ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def o02_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty audit rows, newest first (paging)."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).orderBy(F.desc("event_id")).offset(100).limit(50).select("event_id", "user_id", "event_type")


_PAIRS = "pairs AS (SELECT p_brand AS target, unnest(string_split(p_name, ' ')) AS alias, p_type FROM part)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), F.explode(F.split("p_name", " ")).alias("alias"), "p_type")


@query(f"WITH {_PAIRS} SELECT target, alias, count(*) AS support_count FROM pairs GROUP BY ALL")
def g24_alias_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an alias stands for a target."""
    return _pairs(spark, sf_dir).groupBy("target", "alias").agg(F.count("*").alias("support_count"))


@query(f"WITH {_PAIRS} SELECT target, list_sort(list(DISTINCT alias)) AS aliases FROM pairs GROUP BY target")
def g25_knowledge_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of aliases."""
    return states.packs(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT alias, count(DISTINCT target) AS targets FROM pairs GROUP BY alias HAVING count(DISTINCT target) > 1")
def g26_alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that several targets claim."""
    return states.collisions(_pairs(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT DISTINCT alias, target FROM pairs WHERE p_type = 'PROMO' EXCEPT SELECT alias, target FROM pairs WHERE p_type = 'ECONOMY'")
def j20_pack_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of one pack that another lacks."""
    p = _pairs(spark, sf_dir)
    return p.where("p_type = 'PROMO'").select("alias", "target").distinct().join(p.where("p_type = 'ECONOMY'").select("alias", "target"), ["alias", "target"], "left_anti")


@query("SELECT o_custkey AS field, count(DISTINCT o_orderpriority) AS spread, list_slice(list_sort(list(DISTINCT o_orderpriority)), 1, 10) AS sample, round(least(0.99, 0.5 + 0.45 * count(*) / 100.0), 4) AS confidence FROM orders GROUP BY o_custkey")
def g05_field_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of a field, a sample of them and a confidence that grows with frequency."""
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("field")).agg(F.count_distinct(p).alias("spread"), F.slice(F.array_sort(F.collect_set(p)), 1, 10).alias("sample"), F.round(F.least(F.lit(0.99), F.lit(0.5) + F.lit(0.45) * F.count("*") / 100.0), 4).alias("confidence"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 0")
def u02_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required less excluded."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").subtract(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"))


@query("WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'), a AS (SELECT doc_id, CASE WHEN source = 'src1' THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE lang <> 'fr') SELECT coalesce(f.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN f.doc_id IS NULL THEN 'unexpected' WHEN f.h <> a.h THEN 'changed' ELSE 'same' END AS status FROM f FULL JOIN a ON f.doc_id = a.doc_id")
def u06_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen set against what is there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("!")), 256).alias("other"))
    return states.drift(d.where("lang <> 'es'"), d.where("lang <> 'fr'").withColumn("h", F.when(F.col("source") == "src1", F.col("other")).otherwise(F.col("h"))), "doc_id", "h")


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS turns, count(*) = max(turn) + 1 AS gapless, count(DISTINCT turn) = count(*) AS unique_turns FROM conversations GROUP BY conv_id")
def w15_index_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes are unique and without gaps."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("turns"), (F.count("*") == F.max("turn") + 1).alias("gapless"), (F.count_distinct("turn") == F.count("*")).alias("unique_turns"))


@query("WITH u AS (SELECT s_nationkey AS nation, 'supplier' AS producer, 1 AS ord FROM supplier UNION ALL SELECT c_nationkey, 'customer', 2 FROM customer) SELECT nation, arg_min(producer, ord) AS producer FROM u GROUP BY nation")
def u01_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of producers in fixed order, the first of each signature kept."""
    part = lambda name, c, k: table(spark, sf_dir, name).select(F.col(c).alias("nation"), F.lit(name).alias("producer"), F.lit(k).alias("ord"))
    return part("supplier", "s_nationkey", 1).unionByName(part("customer", "c_nationkey", 2)).groupBy("nation").agg(F.min_by("producer", "ord").alias("producer"))


@query("SELECT p_brand AS schema_id, max(p_size) AS version, arg_max(p_type, (p_size, p_partkey)) AS status FROM part GROUP BY p_brand")
def s05_catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each catalogue entry."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("schema_id"), F.col("p_size").alias("version"), F.col("p_type").alias("status"), "p_partkey")
    return states.latest(rows, "schema_id", F.struct("version", "p_partkey")).select("schema_id", "version", "status")


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, count(*) AS n, list_contains(list(DISTINCT l_returnflag), 'R') AS touches_return FROM lineitem GROUP BY l_orderkey")
def j09_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of an order's set of flags with a wanted set."""
    flags = F.collect_set("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(flags).alias("flags"), F.count("*").alias("n"), F.arrays_overlap(flags, F.array(F.lit("R"))).alias("touches_return"))


@query("SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, 'none') AS segment, c_custkey IS NULL AS orphan FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def j11_parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children with their parent, and those without."""
    parents = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    joined = table(spark, sf_dir, "orders").join(parents, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "o_custkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.col("c_custkey").isNull().alias("orphan"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming extension: hourly windows of events; the same function serves a stream."""
    return stream.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k")
def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming extension: sessions of users that end after thirty minutes."""
    return stream.sessions(table(spark, sf_dir, "events"))


_OPS = "CASE event_id % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'activate' WHEN 2 THEN 'activate' WHEN 3 THEN 'create' WHEN 4 THEN CASE WHEN value > 40 THEN 'archive' ELSE 'activate' END WHEN 5 THEN CASE WHEN value > 45 THEN 'rollback' ELSE 'review' END ELSE 'activate' END"


@query(
    f"""WITH RECURSIVE log AS (SELECT user_id AS pack_id, event_id AS seq, {_OPS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
    life AS (SELECT pack_id, CAST(-1 AS BIGINT) AS seq, '' AS op, CAST(0 AS BIGINT) AS k, '' AS before, 'none' AS after, TRUE AS accepted FROM log WHERE k = 1 UNION ALL
      SELECT l.pack_id, l.seq, l.op, l.k, p.after, CASE WHEN l.op = 'create' AND p.after = 'none' THEN 'draft' WHEN l.op = 'activate' AND p.after IN ('draft', 'active') THEN 'active' WHEN l.op IN ('archive', 'rollback') AND p.after IN ('draft', 'active') THEN 'archived' ELSE p.after END,
        (l.op = 'create' AND p.after = 'none') OR (l.op IN ('activate', 'archive', 'rollback') AND p.after IN ('draft', 'active')) FROM life p JOIN log l ON l.pack_id = p.pack_id AND l.k = p.k + 1)
    SELECT pack_id, seq, op, before, after, accepted FROM life WHERE k > 0"""
)
def r05_pack_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operation on a knowledge pack found and left, with users' events as the log; streaming.packs plays the same log as a stream."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("pack_id"), "ts", F.col("event_id").alias("seq"), F.expr(_OPS).alias("op"))
    return packs.history(log)


_GRAPHS = """n AS (SELECT o_orderkey % 100 AS graph, 'order:' || o_orderkey AS node, CASE o_orderkey % 7 WHEN 0 THEN 'chunk' WHEN 1 THEN 'artifact' ELSE 'field' END AS kind FROM orders), e AS (SELECT DISTINCT l_orderkey % 100 AS graph, 'order:' || l_orderkey AS src, 'order:' || (l_orderkey + 100 * l_linenumber) AS dst FROM lineitem WHERE l_linenumber < 3 AND l_returnflag = 'N'),
    m AS (SELECT e.*, EXISTS (SELECT 1 FROM n WHERE n.graph = e.graph AND node = src) AND EXISTS (SELECT 1 FROM n WHERE n.graph = e.graph AND node = dst) AS fine FROM e), t AS (SELECT graph, node, bool_or(fine) AS fine FROM (SELECT graph, src AS node, fine FROM m UNION ALL SELECT graph, dst, fine FROM m) GROUP BY ALL),
    g AS (SELECT n.graph, kind, count(*) AS n, count(*) FILTER (fine) AS linked, count(*) FILTER (fine IS NULL) AS orphans, CAST(0 AS BIGINT) AS broken_edges FROM n LEFT JOIN t ON t.graph = n.graph AND t.node = n.node GROUP BY ALL UNION ALL SELECT graph, 'edge', count(*), count(*) FILTER (fine), 0, count(*) FILTER (NOT fine) FROM m GROUP BY graph)"""


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    nodes = table(spark, sf_dir, "orders").select((k % 100).alias("graph"), F.concat(F.lit("order:"), k.cast("string")).alias("node"), F.when(k % 7 == 0, "chunk").when(k % 7 == 1, "artifact").otherwise("field").alias("kind"))
    line = table(spark, sf_dir, "lineitem").where("l_linenumber < 3 AND l_returnflag = 'N'")
    rows = line.select((F.col("l_orderkey") % 100).alias("graph"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("order:"), (F.col("l_orderkey") + 100 * F.col("l_linenumber")).cast("string")).alias("dst"))
    return lineage.graph_totals(nodes, rows)


@query(f"WITH {_GRAPHS} SELECT * FROM g")
def g07_graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind, linked or alone, and broken edges, of a hundred graphs of orders."""
    return _graphs(spark, sf_dir)


@query(
    f"""WITH {_GRAPHS}, c AS (SELECT count(DISTINCT graph) AS graphs, round(sum(linked) FILTER (kind = 'field') / sum(n) FILTER (kind = 'field'), 6)::DOUBLE AS field_coverage, round(sum(linked) FILTER (kind = 'chunk') / sum(n) FILTER (kind = 'chunk'), 6)::DOUBLE AS chunk_coverage, round(sum(linked) FILTER (kind = 'artifact') / sum(n) FILTER (kind = 'artifact'), 6)::DOUBLE AS artifact_coverage, CAST(sum(orphans) AS BIGINT) AS orphans, CAST(sum(broken_edges) AS BIGINT) AS broken_edges FROM g)
    SELECT *, CASE WHEN broken_edges = 0 AND field_coverage >= 0.9 AND chunk_coverage >= 0.9 AND artifact_coverage >= 0.95 THEN 'passed' ELSE 'failed' END AS status FROM c"""
)
def e08_lineage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by kind, orphans and broken edges over all graphs, against their thresholds."""
    return lineage.report(_graphs(spark, sf_dir))
