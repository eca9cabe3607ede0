"""Queries that read administrative notices: sentences by rules, signatures, sections and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import dates, rulebooks, rules, runs
from quire.plans.registry import query, table
from quire.sources import notices



def _last_century(book: tuple[rules.Rule, ...]) -> tuple[rules.Rule, ...]:
    """The rules with years of the orders: their default is this century."""
    return tuple(rules.Rule(**{**r.__dict__, "pattern": r.pattern.replace("20[0-9]{2}", "(?:19|20)[0-9]{2}")}) for r in book)


_RULES, _MEETING_RULES, _GUIDE_RULES = map(_last_century, (rules.POLICY, rulebooks.MEETING, rulebooks.GUIDE))
_N = f"blocks AS ({notices.SQL})"
_trim = lambda c: f"regexp_replace({c}, '^{rules.S}|{rules.S}$', '', 'g')"
_squeeze = lambda c: f"regexp_replace({c}, '{rules.S[:-1]}+', '', 'g')"


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.notices(table(spark, sf_dir, "orders"))


def _whole_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.whole_notices(table(spark, sf_dir, "orders"))


@query(rules.facts_sql(_RULES).replace("WITH trimmed", f"WITH {_N}, trimmed", 1))
def x20_policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and sentences of notices by a table of 28 rules, one fact a span and target."""
    return rules.facts(_notices(spark, sf_dir), _RULES)


_ORGS = f"regexp_extract_all({_squeeze('t')}, '{runs.ORGANISATION}')"
_SIGNED = f"""{_N}, l AS (SELECT doc_id, pos, {_trim('text')} AS t FROM blocks),
    o AS (SELECT doc_id, pos, t, CASE WHEN t <> '' AND length(t) <= 120 AND NOT regexp_matches(t, '{runs.MARKS}') AND array_to_string({_ORGS}, '') = {_squeeze('t')} THEN {_ORGS} ELSE [] END AS orgs FROM l),
    island AS (SELECT *, sum(CASE WHEN len(orgs) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS g FROM o),
    ends AS (SELECT doc_id, g, pos, t FROM island WHERE len(orgs) = 0 AND regexp_matches(t, '^{rules.FULL_DATE}$')),
    run AS (SELECT i.doc_id, e.pos AS date_pos, e.t, min(i.pos) AS first_pos, count(*) AS n_blocks, flatten(list(i.orgs ORDER BY i.pos)) AS names FROM island i JOIN ends e ON e.doc_id = i.doc_id AND e.g = i.g WHERE len(i.orgs) > 0 AND e.pos - i.pos <= 8 GROUP BY i.doc_id, e.pos, e.t),
    uniq AS (SELECT *, list_filter(names, lambda x, k: list_position(names, x) = k) AS u FROM run),
    signed AS (SELECT doc_id, date_pos, {_squeeze('t')} AS date, first_pos, n_blocks, array_to_string(u, '、') AS issuer, len(u) AS n_issuers FROM uniq QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY date_pos) = 1)"""


@query(f"WITH {_SIGNED} SELECT * FROM signed")
def w07_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation lines right above a document's first signed date."""
    return runs.signatures(_notices(spark, sf_dir))


@query(
    f"""WITH {_SIGNED}, labelled AS (SELECT doc_id, arg_min(value, pos) AS issuer FROM ({rules.facts_sql(tuple(r for r in _RULES if r.target == 'issuer'))}) GROUP BY doc_id),
    titled AS (SELECT doc_id, substr(text, 1, instr(text, '关于') - 1) AS issuer FROM blocks WHERE pos = 0 AND instr(text, '关于') > 1 AND regexp_extract_all(substr(text, 1, instr(text, '关于') - 1), '{runs.ORGANISATION}') = [substr(text, 1, instr(text, '关于') - 1)])
    SELECT o_orderkey AS doc_id, coalesce(l.issuer, t.issuer, s.issuer, CAST(o_orderpriority AS VARCHAR)) AS issuer, CASE WHEN l.issuer IS NOT NULL THEN 'policy_issuer_label' WHEN t.issuer IS NOT NULL THEN 'policy_title_issuer' WHEN s.issuer IS NOT NULL THEN 'policy_signature' ELSE 'weak_source_site_issuer_review' END AS kind,
      CASE WHEN l.issuer IS NOT NULL THEN 0.91 WHEN t.issuer IS NOT NULL THEN 0.9 WHEN s.issuer IS NOT NULL THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence
    FROM orders LEFT JOIN labelled l ON l.doc_id = o_orderkey LEFT JOIN titled t ON t.doc_id = o_orderkey LEFT JOIN signed s ON s.doc_id = o_orderkey"""
)
def x17_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice's issuer by its label, else its title, else its signature, else the site it comes from (here the order's priority)."""
    blocks = _notices(spark, sf_dir)
    labelled = rules.facts(blocks, tuple(r for r in _RULES if r.target == "issuer")).groupBy("doc_id").agg(F.min_by("value", "pos").alias("label"))
    titles = blocks.where("pos = 0").select("doc_id", "text")
    return runs.issuers(labelled, titles, runs.signatures(blocks), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("site")))


def _bodies_sql(head: str, stop: str, limit: int, soft: str = "FALSE") -> str:
    """Bodies by joins on positions: the blocks between each head and its first stop, in plain comparisons."""
    return f"""l AS (SELECT doc_id, pos, type, {_trim('text')} AS t FROM blocks), m AS (SELECT *, {head} AS is_head, ({head}) OR ({stop}) AS is_stop, {soft} AS is_soft FROM l),
    h AS (SELECT a.doc_id, a.pos, a.t, a.type, (SELECT coalesce(min(b.pos), 1000000) FROM m b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.is_stop) AS hard, (SELECT coalesce(min(b.pos), 1000000) FROM m b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.t <> '') AS filled FROM m a WHERE is_head),
    e AS (SELECT *, least(hard, pos + {limit} + 1, (SELECT coalesce(min(b.pos), 1000000) FROM m b WHERE b.doc_id = h.doc_id AND b.pos > h.filled AND b.is_soft)) AS stop FROM h),
    body AS (SELECT e.doc_id, e.pos AS head_pos, e.t AS head, e.type, coalesce(string_agg(b.t, chr(10) ORDER BY b.pos), '') AS body, count(b.pos) AS n FROM e LEFT JOIN m b ON b.doc_id = e.doc_id AND b.pos > e.pos AND b.pos < e.stop AND b.t <> '' GROUP BY e.doc_id, e.pos, e.t, e.type)"""


_NAMED = "regexp_replace(regexp_replace(t, '^第[一二三四五六七八九十0-9]+[章节条] *', ''), '^([一二三四五六七八九十]+|[0-9]+) *[、.．] *', '')"
_LISTED = lambda names: ", ".join(f"'{x}'" for x in names)


@query(
    f"""WITH {_N}, {_bodies_sql(f"regexp_replace({_NAMED}, '[（(].*?[）)]', '') IN ({_LISTED(runs.MEASURES)})", f"{_NAMED} IN ({_LISTED(runs.BOUNDARIES)})", 11, "type = 'heading'")}
    SELECT doc_id, head_pos, regexp_replace({_NAMED.replace('(t,', '(head,')}, '[（(].*?[）)]', '') AS name, CASE WHEN body = '' THEN head ELSE body END AS body, n AS n_blocks FROM body WHERE body <> '' OR type = 'paragraph' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY head_pos) = 1"""
)
def x18_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice's first section of measures, eleven blocks at most, to the next boundary or heading."""
    return runs.measures(_whole_notices(spark, sf_dir))


def _numbered_sql(limit: int) -> str:
    return f"""WITH {_N}, {_bodies_sql("regexp_matches(t, '^[一二三四五六七八九十]+[、.．] *(申报要求|申报方式)$')", f"regexp_matches(t, '{runs.NUMBERED}')", limit)} SELECT doc_id, head_pos, regexp_extract(head, '申报要求|申报方式') AS name, body, n AS n_blocks FROM body WHERE body <> ''"""


@query(_numbered_sql(100_000))
def x10_numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements and ways of application, from their numbered heading to the next."""
    return runs.numbered_sections(_whole_notices(spark, sf_dir)).select("doc_id", "head_pos", "name", "body", F.size("positions").alias("n_blocks"))


@query(_numbered_sql(2))
def w04_lookahead_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit of two blocks below the heading."""
    return runs.numbered_sections(_whole_notices(spark, sf_dir), limit=2).select("doc_id", "head_pos", "name", "body", F.size("positions").alias("n_blocks"))


_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
_MATCH = [f"nullif(regexp_extract(t, '{form}', 0), '')" for form in dates.FORMS]
_MEETING = f"""{_N}, l AS (SELECT doc_id, pos, {_trim('text')} AS t FROM blocks),
    y AS (SELECT *, CASE WHEN regexp_matches(t, '{dates.STANDALONE}') THEN translate(split_part(regexp_replace({_squeeze('t')}, '^[（(]', ''), '年', 1), '零〇○一二三四五六七八九', '000123456789') ELSE nullif(regexp_extract(t, '^[（(]?((19|20)[0-9]{{2}})年[0-9]{{1,2}}月[0-9]{{1,2}}日[）)]?$', 1), '') END AS year FROM l),
    c AS (SELECT *, coalesce(lag(year, 1) OVER w, lag(year, 2) OVER w, lag(year, 3) OVER w) AS near,
      {_HAS(dates.LABELS)} AS explicit, regexp_matches(t, '(^|[\\x09-\\x0D\\x20])日期[ ]*[:：]') AS generic, {_HAS(dates.OPENINGS)} AS opening, regexp_matches(t, '{dates.STANDALONE}') AS alone FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT *, CASE WHEN explicit OR generic OR opening THEN coalesce({', '.join(_MATCH)}) WHEN alone THEN {_MATCH[2]} END AS raw FROM c WHERE NOT {_HAS(dates.FORBIDDEN)}),
    p AS (SELECT *, NOT contains(raw, '年') AND NOT regexp_matches(raw, '^[0-9]{{4}}[-/]') AS part FROM r WHERE raw IS NOT NULL),
    d AS (SELECT doc_id, pos, CASE WHEN alone THEN 6 WHEN explicit THEN 5 WHEN contains(t, '主持召开') THEN 4 WHEN opening THEN 3 ELSE 2 END AS score, raw,
      CASE WHEN part AND near IS NOT NULL THEN near || '年' || raw ELSE raw END AS value, CASE WHEN part THEN raw ELSE raw END AS name,
      (CASE WHEN part THEN CASE WHEN near IS NULL THEN 0.65 ELSE 0.78 END WHEN alone THEN 0.82 WHEN explicit OR contains(t, '主持召开') THEN 0.9 WHEN generic THEN 0.8 ELSE 0.75 END)::DOUBLE AS confidence,
      CASE WHEN alone THEN 'standalone_meeting_date' WHEN explicit THEN 'explicit_meeting_date' WHEN generic THEN 'generic_labeled_meeting_date' ELSE 'meeting_opening_date' END AS evidence,
      CASE WHEN part AND near IS NULL THEN 'medium_risk_partial_date' ELSE '' END AS flag FROM p)"""


@query(f"WITH {_MEETING} SELECT * FROM d")
def x11_meeting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block that dates its notice's meeting, with its score and the year that a partial date takes from the blocks before."""
    return dates.meeting_dates(_notices(spark, sf_dir), "(?:19|20)")


@query(f"WITH {_MEETING} SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1")
def o11_best_meeting_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best meeting date of a notice, by score and then the earliest block."""
    return dates.best_meeting_date(_notices(spark, sf_dir), "(?:19|20)")


@query(rules.facts_sql(_MEETING_RULES).replace("WITH trimmed", f"WITH {_N}, trimmed", 1))
def x12_meeting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, chairs, places, people, topics, decisions and actions of meetings, by a table of 19 rules."""
    return rules.facts(_notices(spark, sf_dir), _MEETING_RULES)


@query(rules.facts_sql(_GUIDE_RULES).replace("WITH trimmed", f"WITH {_N}, trimmed", 1))
def x14_guide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, objects, steps, deadlines, conditions and materials of guides, by a table of 15 rules."""
    return rules.facts(_notices(spark, sf_dir), _GUIDE_RULES)


_PLAIN = f"regexp_replace({_NAMED}, '[（(].*?[）)]', '')"


@query(
    f"""WITH {_N}, {_bodies_sql(f"{_PLAIN} IN ({_LISTED(rulebooks.GUIDE_SECTIONS)})", f"regexp_matches(t, '^[一二三四五六七八九十]+ *[、.．] *[^。；]{{2,30}}$')", 7)},
    n AS (SELECT doc_id, head_pos, {_PLAIN.replace('(t,', '(head,')} AS name, body FROM body WHERE body <> ''), g AS (SELECT *, CASE {' '.join(f"WHEN name = '{k}' THEN '{v}'" for k, v in rulebooks.GUIDE_SECTIONS.items())} END AS target FROM n)
    SELECT doc_id, head_pos, name, target, CASE WHEN target IN ('contact', 'service_object') THEN split_part(body, chr(10), 1) ELSE body END AS body FROM g"""
)
def x14_guide_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of guides by their names, seven blocks at most."""
    return rulebooks.guide_sections(_whole_notices(spark, sf_dir))


#: Openings of notices as guides write them, for some orders.
_OPENING = "CASE WHEN pos = 0 AND doc_id % 3 = 0 THEN '第' || doc_id || '号申报指南' WHEN pos = 1 AND doc_id % 5 = 0 THEN ' ' WHEN pos = 4 AND doc_id % 4 = 0 THEN '经费额度' || doc_id WHEN pos = 6 AND doc_id % 7 = 0 THEN '申报流程说明' ELSE text END"


@query(
    f"""WITH {_N}, o AS (SELECT doc_id, pos, {_OPENING} AS text FROM blocks), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE pos < 12 AND trim(text) <> ''),
    g AS (SELECT doc_id FROM e GROUP BY doc_id HAVING count(*) >= 3 AND bool_or(regexp_matches(text, '办事指南|申报指南|申报流程说明')) AND NOT bool_or(regexp_matches(text, '{rulebooks.OWN_LABEL}'))),
    c AS (SELECT e.* FROM e WHERE regexp_matches(text, '办理事项及证明材料清单|经费额度|申报流程说明') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)
    SELECT doc_id, pos, 'service_object' AS target, 'service or subject section' AS name, text AS value, 0.84::DOUBLE AS confidence FROM e JOIN g USING (doc_id) WHERE k = 2 UNION ALL SELECT doc_id, pos, 'application_conditions', 'process or condition detail', text, 0.8 FROM e JOIN g USING (doc_id) WHERE k = 3
    UNION ALL SELECT doc_id, pos, 'category', CASE WHEN contains(text, '办理事项及证明材料清单') THEN '办理事项及证明材料清单' WHEN contains(text, '经费额度') THEN '经费额度' ELSE '申报流程说明' END, text, 0.66 FROM c JOIN g USING (doc_id)"""
)
def x15_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object, conditions and category of guides by their first blocks."""
    return rulebooks.front_matter(_notices(spark, sf_dir).withColumn("text", F.expr(_OPENING)))
