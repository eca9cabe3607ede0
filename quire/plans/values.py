"""Queries over values: coercion, transforms, assertions, validation, JSON paths, exports of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.assertions import Assertion, coerced, outcome
from quire.operators import tables
from quire.plans.registry import query, table


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_slash, strftime(o_orderdate, '%Y-%m-%d') AS iso_cjk, CAST(NULL AS VARCHAR) AS impossible FROM orders")
def f21_date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates written with slashes and with CJK marks, and a day that no calendar has."""
    d = F.col("o_orderdate")
    slash = F.concat_ws("/", F.year(d), F.month(d), F.dayofmonth(d))
    cjk = F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日上午"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.normalize_date(slash).alias("iso_slash"), t.normalize_date(cjk).alias("iso_cjk"), t.normalize_date(F.lit("2024-02-30")).alias("impossible"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS unparsable FROM orders")
def f23_number_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amounts written with currency signs and thousands marks."""
    written = F.concat(F.lit("￥ "), F.format_number("o_totalprice", 2), F.lit("元"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.normalize_number(written).alias("amount"), t.normalize_number(F.lit("n.a.")).alias("unparsable"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS closed, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority FROM orders")
def f25_boolean_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """booleans by word, and an enum map that leaves unknown values."""
    word = F.when(F.col("o_orderstatus") == "F", " YES").when(F.col("o_orderstatus") == "O", "no").otherwise("perhaps")
    names = F.create_map(F.lit("1-URGENT"), F.lit("urgent"), F.lit("2-HIGH"), F.lit("high"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.normalize_boolean(word).alias("closed"), F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), "o_orderpriority").alias("priority"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing.deep') IS NOT NULL AS has_missing, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events")
def f24_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values at JSON paths, and whether they are there."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing.deep", "variant").isNotNull().alias("has_missing"), F.try_variant_get(v, "$.k", "variant").isNotNull().alias("has_k"))


_ASSERTIONS = (
    Assertion("k_exists", "$.k", "exists"),
    Assertion("k_filled", "$.k", "non_empty"),
    Assertion("k_whole", "$.k", "type_is", "integer"),
    Assertion("k_small", "$.k", "number_range", (0, 49)),
    Assertion("k_digits", "$.k", "regex_match", "^[0-9]{2}$"),
    Assertion("k_known", "$.k", "enum_allowed", ("1", "2", "3", "5", "8", "13")),
    Assertion("k_short", "$.k", "regex_match", ("[0-9]", "fullmatch")),
    Assertion("k_itself", "$.k", "equal_to_path", "$.k"),
    Assertion("label", "$.label", "exists"),
    Assertion("note", "$.note", "exists", optional=True),
)


@query(
    """WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT unnest([
      {'a': 'k_exists', 'o': 'passed'}, {'a': 'k_filled', 'o': 'passed'}, {'a': 'k_whole', 'o': 'passed'}, {'a': 'k_small', 'o': CASE WHEN k BETWEEN 0 AND 49 THEN 'passed' ELSE 'failed' END},
      {'a': 'k_digits', 'o': CASE WHEN k BETWEEN 10 AND 99 THEN 'passed' ELSE 'failed' END}, {'a': 'k_known', 'o': CASE WHEN k IN (1, 2, 3, 5, 8, 13) THEN 'passed' ELSE 'failed' END},
      {'a': 'k_short', 'o': CASE WHEN k BETWEEN 0 AND 9 THEN 'passed' ELSE 'failed' END}, {'a': 'k_itself', 'o': 'passed'}, {'a': 'label', 'o': 'missing'}, {'a': 'note', 'o': 'skipped'}]) AS x FROM e)
    SELECT x.a AS assertion, x.o AS outcome, count(*) AS n FROM r GROUP BY ALL"""
)
def t10_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions over JSON payloads, parsed once, by outcome."""
    each = F.explode(F.array(*[F.struct(F.lit(a.name).alias("assertion"), outcome(F.col("v"), a, parsed=True).alias("outcome")) for a in _ASSERTIONS]))
    return table(spark, sf_dir, "events").select(F.try_parse_json("props").alias("v")).select(each.alias("x")).groupBy("x.assertion", "x.outcome").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, CAST(l_extendedprice AS DOUBLE) AS price, l_returnflag = 'R' AS returned, [l_returnflag, l_linestatus] AS flags FROM lineitem")
def t01_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written values coerced to target types."""
    written = {"ship_date": (F.date_format("l_shipdate", "yyyy/M/d"), "date"), "price": (F.concat(F.lit("¥"), F.format_number("l_extendedprice", 2)), "number"), "returned": (F.when(F.col("l_returnflag") == "R", "True").otherwise("0"), "boolean"), "flags": (F.concat_ws("、", "l_returnflag", "l_linestatus"), "array[string]")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[coerced(v, k).alias(n) for n, (v, k) in written.items()])


@query("SELECT p_partkey, upper(trim(p_name)) || '-' || lower(p_type) AS merged, string_split(p_name, ' ')[1] AS colour, coalesce(nullif(p_brand, 'Brand#2'), 'unbranded') AS brand, CAST(p_size AS DOUBLE) AS size FROM part")
def t03_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of trim, merge, split, default and number rules, each of which sees the value before it."""
    rules = [
        {"operation": "trim", "source": "p_name", "target": "name"},
        {"operation": "upper", "source": "name", "target": "name"},
        {"operation": "lower", "source": "p_type", "target": "kind"},
        {"operation": "merge", "source": ["name", "kind"], "target": "merged", "with": "-"},
        {"operation": "split", "source": "p_name", "target": "colour", "by": " ", "index": 0},
        {"operation": "null_if", "source": "p_brand", "target": "brand", "value": "Brand#2"},
        {"operation": "default", "source": "brand", "target": "brand", "value": "unbranded"},
        {"operation": "normalize_number", "source": "p_size", "target": "size"},
    ]
    return tables.transformed(table(spark, sf_dir, "part"), rules).select("p_partkey", "merged", "colour", "brand", "size")


@query(
    """WITH i AS (SELECT c_custkey, unnest(list_filter([CASE WHEN c_name IS NULL THEN 'required:c_name' END, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'pattern:c_name' END,
      CASE WHEN c_acctbal < 0 THEN 'minimum:c_acctbal' END, CASE WHEN c_acctbal > 9000 THEN 'maximum:c_acctbal' END, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'enum:c_mktsegment' END,
      CASE WHEN length(c_mktsegment) > 9 THEN 'max_length:c_mktsegment' END], lambda x: x IS NOT NULL)) AS issue FROM customer)
    SELECT issue, count(*) AS n, min(c_custkey) AS first_key FROM i GROUP BY issue"""
)
def t07_schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of rows against a schema's constraints, counted by failure."""
    schema = {"c_name": {"required": True, "pattern": "Customer#[0-9]{9}"}, "c_acctbal": {"minimum": 0, "maximum": 9000}, "c_mktsegment": {"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], "max_length": 9}}
    return tables.issues(table(spark, sf_dir, "customer"), schema).groupBy("issue").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 'failed' WHEN lang NOT IN ('en', 'de', 'fr', 'es') OR length(text) > 20000 THEN 'review_required' ELSE 'completed' END AS status FROM documents")
def t09_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed before review before completed."""
    review = ~F.col("lang").isin("en", "de", "fr", "es") | (F.length("text") > 20000)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") == 0, "failed").when(review, "review_required").otherwise("completed").alias("status"))


@query("SELECT doc_id, coalesce(nullif(lang, 'es'), 'unknown') AS language, CASE WHEN lang = 'es' THEN 'default' ELSE 'metadata' END AS language_from, source AS origin, CAST(n_chars AS BIGINT) AS size, NULL IS NOT NULL AS has_owner FROM documents")
def t05_metadata_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata template with traced defaults."""
    lang = F.nullif(F.col("lang"), F.lit("es"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(lang, F.lit("unknown")).alias("language"), F.when(lang.isNull(), "default").otherwise("metadata").alias("language_from"), F.col("source").alias("origin"), F.col("n_chars").cast("long").alias("size"), F.lit(False).alias("has_owner"))


@query("SELECT c_custkey, unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS field, unnest([c_name, CAST(c_nationkey AS VARCHAR), printf('%.2f', c_acctbal), c_mktsegment]) AS value FROM customer")
def k08_csv_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in long form, a row for each field."""
    rows = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))
    return tables.long_form(rows, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def k08_csv_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows pivoted wide with known columns."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT n_nationkey, to_json({'name': n_name, 'region': r_name}) AS data FROM nation JOIN region ON n_regionkey = r_regionkey")
def k09_business_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business records as JSON."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"))).alias("data"))


@query("SELECT event_type, CASE WHEN regexp_matches(CAST(value AS VARCHAR), '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' ELSE 'text' END AS shape, count(*) AS n FROM events GROUP BY ALL")
def f05_value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the form of values, by event type."""
    return table(spark, sf_dir, "events").groupBy("event_type", t.value_shape(F.col("value").cast("string")).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s_\\-]+', '', 'g') AS normalized, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS field_id FROM part")
def f01_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names normalised and made identifiers."""
    return table(spark, sf_dir, "part").select("p_partkey", t.normalize_name(F.col("p_name")).alias("normalized"), t.sanitize(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("field_id"))


@query("SELECT event_id, '[REDACTED]' AS token, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events")
def f47_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive keys masked in JSON, at any depth."""
    payload = F.concat(F.lit('{"token": "s3cr3t", "inner": '), "props", F.lit("}"))
    clean = tables.redacted(payload, ("token", "password", "secret", "api_key"))
    v = F.parse_json(clean)
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(v, "$.token", "string").alias("token"), F.variant_get(v, "$.inner.k", "string").alias("k"))


_ORDER_ASSERTIONS = (
    Assertion("day", "$.day", "date_format", ("yyyy/MM/dd", "yyyy-MM-dd")),
    Assertion("not_a_day", "$.status", "date_format", "yyyy-MM-dd"),
    Assertion("moment", "$.moment", "datetime_format", "yyyy-MM-dd HH:mm:ss"),
    Assertion("clerk_short", "$.clerk", "text_length", (1, 8)),
    Assertion("tags_two", "$.tags", "array_length", (2, 2)),
    Assertion("no_array", "$.clerk", "array_length", (0, 99)),
    Assertion("link", "$.link", "url_like"),
    Assertion("no_link", "$.clerk", "url_like"),
    Assertion("open_range", "$.price", "number_range", (0, 1000, False, False)),
    Assertion("status_differs", "$.status", "not_equal_to_path", "$.first"),
    Assertion("status_same", "$.status", "equal_to_path", "$.first"),
    Assertion("flag_no_number", "$.flag", "type_is", "number"),
    Assertion("status_begins", "$.status", "regex_match", ("F", "match")),
    Assertion("gone", "$.gone", "not_equal_to_path", "$.first"),
)


@query(
    """WITH r AS (SELECT unnest([
      {'a': 'day', 'o': 'passed'}, {'a': 'not_a_day', 'o': 'failed'}, {'a': 'moment', 'o': 'passed'}, {'a': 'clerk_short', 'o': CASE WHEN length(o_orderpriority) <= 8 THEN 'passed' ELSE 'failed' END}, {'a': 'tags_two', 'o': 'passed'},
      {'a': 'no_array', 'o': 'failed'}, {'a': 'link', 'o': 'passed'}, {'a': 'no_link', 'o': 'failed'}, {'a': 'open_range', 'o': CASE WHEN o_totalprice > 0 AND o_totalprice < 1000 THEN 'passed' ELSE 'failed' END},
      {'a': 'status_differs', 'o': CASE WHEN o_orderstatus <> 'F' THEN 'passed' ELSE 'failed' END}, {'a': 'status_same', 'o': CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END}, {'a': 'flag_no_number', 'o': 'failed'},
      {'a': 'status_begins', 'o': CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END}, {'a': 'gone', 'o': 'missing'}]) AS x FROM orders)
    SELECT x.a AS assertion, x.o AS outcome, count(*) AS n FROM r GROUP BY ALL"""
)
def f33_assertion_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other assertion operators with their modes and flags, over orders as JSON."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    payload = F.to_json(F.struct(day.alias("day"), F.concat(day, F.lit(" 12:30:00")).alias("moment"), F.col("o_orderpriority").alias("clerk"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.concat(F.lit("HTTPS://example.org/"), "o_orderkey").alias("link"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.lit("F").alias("first"), F.lit(True).alias("flag")))
    each = F.explode(F.array(*[F.struct(F.lit(a.name).alias("assertion"), outcome(F.col("v"), a, parsed=True).alias("outcome")) for a in _ORDER_ASSERTIONS]))
    return table(spark, sf_dir, "orders").select(F.try_parse_json(payload).alias("v")).select(each.alias("x")).groupBy("x.assertion", "x.outcome").agg(F.count("*").alias("n"))


@query("SELECT assertion, severity, n, row_number() OVER (ORDER BY severity <> 'error', assertion) AS place FROM (SELECT event_type AS assertion, CASE WHEN avg(value) > 50 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM events GROUP BY event_type)")
def o05_issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in order, errors first, then by id. One issue an assertion, and assertions are few."""
    issues = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("assertion")).agg(F.when(F.avg("value") > 50, "error").otherwise("warning").alias("severity"), F.count("*").alias("n"))
    return issues.withColumn("place", F.row_number().over(W.orderBy(F.col("severity") != "error", "assertion")))


@query("SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / nullif(sum(o_totalprice), 0), 0) AS closed_share, coalesce(count(*) FILTER (o_orderstatus = 'P') / nullif(count(*) FILTER (o_orderstatus <> 'F'), 0), 0) AS partial_share FROM orders GROUP BY o_custkey")
def f50_safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratios that are 0 where the denominator is."""
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    closed = F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(safe(closed, F.sum("o_totalprice")).alias("closed_share"), safe(F.count_if(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_orderstatus") != "F")).alias("partial_share"))
