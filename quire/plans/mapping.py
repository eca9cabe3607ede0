"""Queries that map source fields to target fields, over customers as documents."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import matching as m
from quire.plans.registry import query, table

#: The target schema: id, type, aliases, required.
TARGETS = [
    ("customer_name", "string", ["name", "client-name"], True),
    ("balance", "number", ["account balance", "acct_bal"], True),
    ("segment", "enum", ["market segment"], False),
    ("country_code", "string", ["nation key", "nation"], False),
    ("phone", "string", ["tel"], True),
]
#: Source name and column of each candidate.
SOURCES = [("Client Name", "c_name"), ("Account-Balance", "c_acctbal"), ("Segment", "c_mktsegment"), ("Nation Key", "c_nationkey")]

_CANDIDATES = "SELECT c_custkey AS doc_id, unnest([" + ", ".join(f"'{n}'" for n, _ in SOURCES) + "]) AS source_name, unnest([" + ", ".join(f"'$.metadata.{c}'" for _, c in SOURCES) + "]) AS source_path, unnest([" + ", ".join(f"CAST({c} AS VARCHAR)" for _, c in SOURCES) + "]) AS sample FROM customer"
_NORM = "regexp_replace(lower({}), '[\\s_\\-]+', '', 'g')"


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer", *x) for x in TARGETS], "schema_id string, target_id string, target_type string, aliases array<string>, required boolean")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each field of a customer, as a document's candidate."""
    each = F.array(*[F.struct(F.lit(n).alias("source_name"), F.lit(f"$.metadata.{c}").alias("source_path"), F.col(c).cast("string").alias("sample")) for n, c in SOURCES])
    # dealt out by document: a small file of many rows is one task, and what is grouped by document later then stays where it is
    dealt = table(spark, sf_dir, "customer").select("c_custkey", *[c for _, c in SOURCES]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = dealt.select(F.col("c_custkey").alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.*")
    return rows.withColumns({"schema_id": F.lit("customer"), "kind": t.infer_type(F.col("sample"))})


@query(f"WITH c AS ({_CANDIDATES}) SELECT doc_id, source_path, source_name, sample, CASE WHEN lower(sample) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(sample, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ].*)?$') THEN 'date' WHEN regexp_matches(sample, '^[$]?-?[0-9][0-9,]*(\\.[0-9]+)?$') THEN 'number' ELSE 'string' END AS kind FROM c")
def p01_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from metadata with inferred types."""
    return candidates(spark, sf_dir).select("doc_id", "source_path", "source_name", "sample", "kind")


_ALIASES = "(VALUES " + ", ".join(f"('{x}', '{a}', '{'exact' if a == x else 'alias'}')" for x, _, al, _ in TARGETS for a in [x, *al]) + ") AS a(target_id, alias, match)"


@query(f"WITH c AS ({_CANDIDATES}) SELECT doc_id, source_path, target_id, match FROM c JOIN {_ALIASES} ON {_NORM.format('source_name')} = {_NORM.format('alias')}")
def j02_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and alias matches."""
    return m.alias_matches(candidates(spark, sf_dir), targets(spark)).select("doc_id", "source_path", "target_id", "match")


#: Similarity of the few names of the configuration, which SQL has no function for.
_LEXICAL = "(VALUES " + ", ".join(f"('{n}', '{x}', {SequenceMatcher(None, re.sub(r'[_ -]', '', n.lower()), x.replace('_', '')).ratio()!r}::DOUBLE, '{kind}', {1.0 if re.sub(r'[_ -]', '', n.lower()) == x.replace('_', '') else 0.9 if re.sub(r'[_ -]', '', n.lower()) in [re.sub(r'[_ -]', '', y) for y in al] else 0.0}::DOUBLE)" for n, _ in SOURCES for x, kind, al, _ in TARGETS) + ") AS l(source_name, target_id, lexical, target_type, alias)"
_PAIRS = f"""c AS ({_CANDIDATES}), k AS (SELECT *, CASE WHEN lower(sample) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(sample, '^[$]?-?[0-9][0-9,]*([.][0-9]+)?$') THEN 'number' ELSE 'string' END AS kind FROM c),
    f AS (SELECT doc_id, source_path, target_id, lexical, alias, (CASE WHEN kind = target_type THEN 1.0 WHEN kind = 'string' AND target_type IN ('string', 'text', 'enum') THEN 0.9 WHEN target_type = 'text' THEN 0.6 ELSE 0.4 END)::DOUBLE AS type,
      (CASE WHEN target_type = 'number' THEN CASE WHEN regexp_matches(regexp_replace(sample, '[,\\s￥¥元]', '', 'g'), '^-?[0-9]+([.][0-9]+)?$') THEN 1.0 ELSE 0.2 END WHEN trim(sample) <> '' THEN 0.8 ELSE 0.2 END)::DOUBLE AS value, (CASE WHEN trim(coalesce(sample, '')) = '' THEN 0.5 ELSE 1.0 END)::DOUBLE AS quality FROM k JOIN {_LEXICAL} USING (source_name)),
    s AS (SELECT *, round(0.30 * lexical + 0.25 * alias + 0.15 * type + 0.15 * value + 0.15 * quality, 4) AS score FROM f)"""


@query(f"WITH {_PAIRS} SELECT doc_id, source_path, target_id, lexical, alias, type, value, quality, score FROM s")
def m13_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and score of each pair."""
    return m.pair_features(candidates(spark, sf_dir), targets(spark)).select("doc_id", "source_path", "target_id", "lexical", "alias", "type", "value", "quality", "score")


@query(f"WITH {_PAIRS} SELECT doc_id, target_id, source_path, score, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0.0), 4) AS margin FROM s WINDOW w AS (PARTITION BY doc_id, target_id ORDER BY score DESC, source_path) QUALIFY rank <= 3")
def w13_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each target with margins."""
    return m.ranked(m.pair_features(candidates(spark, sf_dir), targets(spark))).select("doc_id", "target_id", "source_path", "score", "rank", "margin")


@query()
def m14_global_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment of the greatest total score; tests hold brute force against it."""
    return m.assigned(m.pair_features(candidates(spark, sf_dir), targets(spark)))


@query(f"WITH c AS ({_CANDIDATES}), h AS (SELECT doc_id, target_id FROM c JOIN {_ALIASES} ON {_NORM.format('source_name')} = {_NORM.format('alias')}) SELECT c_custkey AS doc_id, t.target_id FROM customer CROSS JOIN (VALUES " + ", ".join(f"('{x[0]}')" for x in TARGETS if x[3]) + ") AS t(target_id) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = c_custkey AND h.target_id = t.target_id)")
def m12_unmapped_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required targets that no candidate names; each document lists its own few, none are crossed."""
    need = [x[0] for x in TARGETS if x[3]]
    had = m.alias_matches(candidates(spark, sf_dir), targets(spark)).groupBy("doc_id").agg(F.collect_set("target_id").alias("had"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).join(had, "doc_id", "left")
    return ids.select("doc_id", F.explode(F.array_except(F.array(*map(F.lit, need)), F.coalesce("had", F.array().cast("array<string>")))).alias("target_id"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT (regexp_matches(p_type, '^(ECONOMY|PROMO)') AND p_size < 10) AND p_brand NOT IN ('Brand#1', 'Brand#3')")
def j04_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured pattern pairs and forbidden names are left out."""
    forbidden = F.broadcast(spark.createDataFrame([("Brand#1",), ("Brand#3",)], "p_brand string"))
    rows = table(spark, sf_dir, "part").where(~(F.col("p_type").rlike("^(ECONOMY|PROMO)") & (F.col("p_size") < 10)))
    return rows.join(forbidden, "p_brand", "left_anti").select("p_partkey", "p_type")


_ROUTES = {"licence": ["licensed", "license", "rights reserved"], "german": [" und ", " der "], "french": [" les ", " et "], "english": [" the ", " and "]}


@query(
    "WITH s AS (SELECT doc_id, unnest(["
    + ", ".join(f"{{'k': {i}, 'schema_id': '{k}', 'score': (" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ws) + f") / {len(ws)}.0}}" for i, (k, ws) in enumerate(_ROUTES.items()))
    + "]) AS x FROM documents), r AS (SELECT doc_id, x.schema_id AS schema_id, CAST(x.score AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.k) AS n FROM s) SELECT doc_id, schema_id, score, CASE WHEN score >= 0.75 THEN 'auto' WHEN score >= 0.5 THEN 'select' ELSE 'unsupported' END AS decision FROM r WHERE n = 1"
)
def m20_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema with the most signals, ties to the first in order, and what the score allows."""
    low = F.lower("text")
    one = lambda ws: sum(F.contains(low, F.lit(w)).cast("int") for w in ws) / len(ws)
    scored = [F.struct(one(ws).cast("double").alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("schema_id")) for i, (k, ws) in enumerate(_ROUTES.items())]
    best = table(spark, sf_dir, "documents").select("doc_id", F.array_max(F.array(*scored)).alias("b"))
    return best.select("doc_id", "b.schema_id", "b.score", F.when(F.col("b.score") >= 0.75, "auto").when(F.col("b.score") >= 0.5, "select").otherwise("unsupported").alias("decision"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 'reject' WHEN lang = 'es' THEN 'unsupported' WHEN n_chars < 200 OR len(string_split(text, chr(10))) < 2 THEN 'review' ELSE 'pass' END AS status, greatest(0.0, 1.0 - CASE WHEN n_chars < 200 THEN 0.35 ELSE 0 END - CASE WHEN len(string_split(text, chr(10))) < 2 THEN 0.08 ELSE 0 END) AS score FROM documents")
def m21_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by precedence and a score less penalties."""
    short, flat = F.col("n_chars") < 200, F.size(F.split("text", "\n")) < 2
    status = F.when(F.col("n_chars") == 0, "reject").when(F.col("lang") == "es", "unsupported").when(short | flat, "review").otherwise("pass")
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), F.greatest(F.lit(0.0), F.lit(1.0) - F.when(short, 0.35).otherwise(0.0) - F.when(flat, 0.08).otherwise(0.0)).alias("score"))


#: Patterns of values by target, hints of source names, and targets that no fuzzy match may fill.
PATTERNS = {"phone": "^[0-9]{2}-[0-9]{3}-[0-9]{3}-[0-9]{4}$"}
HINTS = {"Segment": ["segment"]}
NO_FUZZY = ("country_code",)
#: Aliases as a second schema has them: fewer, so that later strategies have work.
_CASCADE_TARGETS = [("customer_name", "string", ["client name"]), ("account_balances", "number", []), ("country_code", "string", []), ("segment", "enum", []), ("phone", "string", []), ("remark", "text", [])]


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    dial = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lpad("c_nationkey", 2, "0"), F.lit("-555-010-"), F.lpad(F.col("c_custkey") % 10000, 4, "0"))).otherwise(F.lit("unknown"))
    sources = [*((n, c, F.col(c)) for n, c in SOURCES), ("Dial", "dial", dial)]
    each = F.array(*[F.struct(F.lit(n).alias("source_name"), F.lit(f"$.metadata.{c}").alias("source_path"), value.cast("string").alias("sample")) for n, c, value in sources])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.*")
    rows = rows.withColumns({"kind": t.infer_type(F.col("sample")), "hints": F.coalesce(F.try_element_at(hints, F.col("source_name")), F.array().cast("array<string>"))})
    return m.cascade(rows, spark.createDataFrame(_CASCADE_TARGETS, "target_id string, target_type string, aliases array<string>"), PATTERNS, NO_FUZZY)


@query(
    """SELECT * FROM (SELECT c_custkey AS doc_id, unnest(['customer_name', 'segment', 'phone', 'remark', 'account_balances']) AS target_id, unnest(['alias', 'exact', CASE WHEN c_custkey % 3 <> 0 THEN 'regex' ELSE 'none' END, 'type', 'fuzzy']) AS strategy,
    unnest(['$.metadata.c_name', '$.metadata.c_mktsegment', '$.metadata.dial', '$.metadata.c_mktsegment', '$.metadata.c_acctbal']) AS source_path, unnest([0.95, 1.0, 0.92, 0.74, 0.62])::DOUBLE AS confidence FROM customer) WHERE strategy <> 'none'"""
)
def m01_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy of the cascade that finds a source for each target of a document."""
    return _cascade(spark, sf_dir)


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS label, CASE WHEN l_returnflag = 'N' THEN 0.7 ELSE 0.6 END AS evidence, l_tax * 12 AS context, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.4 END AS kind, CASE WHEN l_linenumber = 4 THEN 0.5 ELSE 1.0 END AS quality,
      l_quantity >= 49 AS forbidden, l_linenumber = 2 AS high, l_linenumber = 3 AS medium, l_discount < 0.02 AS weak, l_returnflag = 'A' AS alias, l_linenumber = 5 AS no_path FROM lineitem),
    r AS (SELECT *, least(1.0, CASE WHEN forbidden THEN 1.0 ELSE 0 END + CASE WHEN high THEN 0.5 ELSE 0 END + CASE WHEN medium THEN 0.2 ELSE 0 END + CASE WHEN weak THEN 0.25 ELSE 0 END + CASE WHEN alias THEN 0.15 ELSE 0 END + CASE WHEN no_path THEN 0.4 ELSE 0 END) AS risk FROM f),
    s AS (SELECT *, round(least(1.0, greatest(0.0, 0.35 * label + 0.3 * evidence + 0.2 * context + 0.1 * kind + 0.05 * quality - risk)) + 0.00000001, 3) AS score FROM r)
    SELECT l_orderkey, l_linenumber, score::DOUBLE AS score, CASE WHEN forbidden THEN 'blocked' WHEN medium OR score < 0.62 THEN 'review' ELSE 'accepted' END AS status,
      list_filter([CASE WHEN score < 0.62 THEN 'low_confidence' END, CASE WHEN medium THEN 'fuzzy_match' END, CASE WHEN score < 0.62 OR medium THEN 'review_required' END, CASE WHEN quality < 1 THEN 'missing_value_sample' END], lambda x: x IS NOT NULL) AS flags FROM s"""
)
def m08_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking formula, its risk penalty, the decision and the flags, with order lines as mappings and their columns as features."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem")
    quality = F.when(c("l_linenumber") == 4, 0.5).otherwise(1.0)
    features = {"label": c("l_discount").cast("double") * 10, "evidence": F.when(c("l_returnflag") == "N", 0.7).otherwise(0.6), "context": c("l_tax").cast("double") * 12, "type": F.when(c("l_linestatus") == "F", 1.0).otherwise(0.4), "quality": quality}
    forbidden, fuzzy = c("l_quantity") >= 49, c("l_linenumber") == 3
    risk = m.risk_penalty({"forbidden": forbidden, "high": c("l_linenumber") == 2, "medium": fuzzy, "weak": c("l_discount") < 0.02, "alias": c("l_returnflag") == "A", "no_path": c("l_linenumber") == 5})
    scored = rows.withColumn("score", F.round(m.ranking(features, risk) + 1e-8, 3))
    low = c("score") < 0.62
    flags = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in (("low_confidence", low), ("fuzzy_match", fuzzy), ("review_required", low | fuzzy), ("missing_value_sample", quality < 1))]))
    return scored.select("l_orderkey", "l_linenumber", "score", m.decision(c("score"), forbidden, fuzzy, 0.62).alias("status"), flags.alias("flags"))


@query("SELECT c_custkey AS doc_id, 'balance' AS target_id, '$.metadata.c_acctbal' AS source_path, 0.9::DOUBLE AS score, 'accepted' AS status FROM customer UNION ALL SELECT c_custkey, 'country_code', CASE WHEN c_nationkey < 12 THEN '$.metadata.c_mktsegment' ELSE '$.metadata.c_nationkey' END, CASE WHEN c_nationkey < 12 THEN 0.65 ELSE 0.8 END::DOUBLE, 'review' FROM customer")
def m18_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required targets that the cascade left open take the best unused path in order of target."""
    doc = F.col("c_custkey").alias("doc_id")
    customers = table(spark, sf_dir, "customer")
    pair = lambda target, path, score: F.struct(F.lit(target).alias("target_id"), F.lit(f"$.metadata.{path}").alias("source_path"), score.cast("double").alias("score"), F.lit(True).alias("required"))
    late = F.when(F.col("c_nationkey") < 12, 0.5).otherwise(0.8)
    pairs = customers.select(doc, F.explode(F.array(pair("balance", "c_acctbal", F.lit(0.9)), pair("balance", "c_nationkey", F.lit(0.7)), pair("country_code", "c_acctbal", F.lit(0.95)), pair("country_code", "c_nationkey", late), pair("country_code", "c_mktsegment", F.lit(0.65)), pair("customer_name", "c_name", F.lit(0.99)))).alias("x")).select("doc_id", "x.*")
    taken = customers.select(doc, F.lit("customer_name").alias("target_id"), F.lit("$.metadata.c_name").alias("source_path"))
    return m.repaired(pairs, taken)
