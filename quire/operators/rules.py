"""Extraction rules as rows, compiled into one pass over blocks.

A rule is a pattern with the words a block must and must not hold, the target it speaks for, a name, a value and a confidence. All
rules become one array expression behind a search for a few words that many rules share, so a block that no rule can match costs no
regular expression, and a rule costs one where the block holds a word of each set that its pattern needs. Rules stand in order of precedence: of overlapping matches for one target the first rule's stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space as the patterns below mean it, in syntax that Java and RE2 share.
S = r"[\x09-\x0D\x20\x{A0}\x{3000}]*"
_NUMERALS = "二〇○零一二三四五六七八九十"
_Y, _M, _D = r"(20[0-9]{2})", r"0?([0-9]{1,2})", r"0?([0-9]{1,2})"


def _day(year: str = _Y) -> str:
    return f"{year}{S}年{S}{_M}{S}月{S}{_D}{S}日"


#: A date in full: with marks of year, month and day, with separators, or in numerals. Has no groups.
FULL_DATE = f"(?:[0-9]{{4}}{S}年{S}[0-9]{{1,2}}{S}月{S}[0-9]{{1,2}}{S}日|[0-9]{{4}}{S}[-/.]{S}[0-9]{{1,2}}{S}[-/.]{S}[0-9]{{1,2}}|[{_NUMERALS}]{{4}}{S}年{S}[{_NUMERALS[4:]}]{{1,3}}{S}月{S}[{_NUMERALS[4:]}]{{1,3}}{S}日)"


@dataclass(frozen=True)
class Rule:
    """needs and forbids: words a block must hold all of, or none of. value and name: templates in which {1} is a group of the pattern, {0} the match without white
    space and {text} the block. alone: not where the document has a fact of a rule of the kind `alone` for the same target."""

    kind: str
    target: str
    pattern: str
    name: str
    value: str
    confidence: float
    needs: tuple[str, ...] = ()
    forbids: tuple[str, ...] = ()
    flag: str = ""
    alone: str = ""


def _label(kind: str, target: str, labels: tuple[str, ...], value: str, confidence: float, flag: str = "") -> Rule:
    return Rule(kind, target, rf"^{S}\[?({'|'.join(labels)})\]?{S}[:：]{S}({value}?)[。；;]?{S}$", "{1}", "{2}", confidence, flag=flag)


#: Labels, words, kinds, targets and confidences of the rules for policy documents, labels first.
POLICY = (
    _label("policy_publish_date_label", "publish_date", ("发布日期", "公布日期", "发布时间", "公开日期"), r".{1,1000}", 0.93),
    _label("policy_issue_date_review", "publish_date", ("成文日期", "印发日期", "发文日期"), r".{1,1000}", 0.66, "medium_risk_issue_date"),
    _label("policy_target_audience_label", "target_audience", ("适用对象", "支持对象", "服务对象", "面向对象", "申报主体", "实施对象", "受益群体", "补贴对象"), r".{1,1000}", 0.86),
    _label("policy_issuer_label", "issuer", ("发文机关", "发布机关", "制定机关", "印发机关", "主办单位", "发布单位", "主管部门", "牵头部门", "牵头单位", "发布机构", "制定单位", "印发单位", "联合发布单位"), r"[^，。；;\n]{2,100}", 0.91),
    _label("policy_document_number_label", "document_number", ("发文字号", "文号", "文件编号"), r"[^\x20，。；;]{3,80}", 0.91),
    Rule("policy_legal_basis_sentence", "policy_measures", "^第一条", "根据", "{text}", 0.84, ("根据",), ("制定本法",)),
    Rule("policy_measure_enactment_purpose", "policy_measures", "^第一条", "制定本法", "{text}", 0.9, ("制定本法",)),
    Rule("policy_support_content_section", "policy_measures", rf"^(?:[一二三四五六七八九十]+[、.．]{S})?(支持内容及标准)", "{1}", "{text}", 0.9),
    Rule("policy_revision_terms", "policy_measures", "部分条款", "修订条款", "{text}", 0.9, ("修订", "具体如下")),
    Rule("policy_revision_history_date", "publish_date", f"({FULL_DATE})[^。；;]{{0,40}}?通过", "{1}通过", "{1}", 0.66, flag="medium_risk_revision_history_date"),
    Rule("responsible_departments_sentence", "responsible_departments", "负责制定", "负责", "{text}", 0.84, ("按照职责分工负责",)),
    Rule("policy_effective_date_sentence", "effective_date", f"自{S}{_day()}{S}起{S}(施行|执行|生效)", "自{1}年{2}月{3}日起{4}", "{1} 年 {2} 月 {3} 日", 0.9),
    Rule("policy_effective_period_sentence", "effective_date", f"自{S}{_day()}{S}至{S}{_day()}", "自{1}年{2}月{3}日至{4}年{5}月{6}日", "自{1}年{2}月{3}日至{4}年{5}月{6}日", 0.9),
    Rule("policy_effective_period_start_review", "publish_date", f"自{S}{_day()}{S}至{S}{_day()}", "{1}年{2}月{3}日", "{1}年{2}月{3}日", 0.66, flag="medium_risk_effective_period_start_for_publish"),
    Rule("policy_partial_effective_date_sentence", "effective_date", f"{_M}{S}月{S}{_D}{S}日{S}(生效|施行|执行)", "{1}月{2}日{3}", "{1}月{2}日{3}", 0.86),
    Rule("policy_relative_effective_date_sentence", "effective_date", "自(?:发布|印发|公布)之日起(?:施行|执行|生效)", "{0}", "{0}", 0.66, flag="relative_effective_date_requires_review"),
    Rule("policy_valid_until_sentence", "valid_until", f"(?:有效期至|执行至|实施至){S}{_day()}", "有效期至", "{1}年{2}月{3}日", 0.88),
    Rule("policy_open_valid_until_sentence", "valid_until", r"实施至[^，。；;\n]{2,40}?截止", "{0}", "{0}", 0.66, flag="open_ended_valid_until_requires_review"),
    Rule("policy_notice_addressee", "target_audience", rf"^(各有关单位|各有关部门|各单位|各部门){S}[:：][^\n]*$", "{1}", "{text}", 0.62, flag="medium_risk_notice_addressee"),
    Rule("policy_mixed_notice_addressee", "target_audience", rf"^[^\n]+各有关单位{S}[:：]", "各有关单位", "{text}", 0.86),
    Rule("policy_county_notice_addressee", "target_audience", "县直有关单位", "各乡镇人民政府等", "{text}", 0.86, ("乡", "镇人民政府")),
    Rule("policy_document_number", "document_number", f"国{S}信{S}办{S}发{S}文", "国信办发文", "{text}", 0.9),
    Rule("policy_addressee_sentence", "target_audience", "^各省", "各省中小企业主管部门", "{text}", 0.86, ("中小企业主管部门",)),
    Rule("policy_subsidy_scope_audience", "target_audience", "对(在京个人消费者|个人消费者|中小企业|小微企业)[^。；;]{0,300}?(?:给予|予以|享受|发放)补贴", "{1}", "{1}", 0.86),
    Rule("policy_addressee_sentence", "target_audience", "^各省", "各地主管部门和有关单位", "{text}", 0.86, ("主管部门", "有关单位")),
    Rule("policy_measure_instruction", "policy_measures", "结合实际认真抓好落实", "结合实际抓好落实", "{text}", 0.86),
    Rule("policy_target_audience_sentence", "target_audience", "^第一条", "未成年人网络平台", "{text}", 0.84, ("未成年人", "网络平台")),
    Rule("policy_signature_date_review", "publish_date", rf"^20[0-9]{{2}}{S}年{S}[0-9]{{1,2}}{S}月{S}[0-9]{{1,2}}{S}日$", "{0}", "{0}", 0.66, flag="medium_risk_signature_date", alone="policy_publish_date_label"),
)


def _groups(template: str) -> list[str]:
    return [x for x in re.split(r"(\{\w+\})", template) if x]


def compact(c: Column) -> Column:
    return F.regexp_replace(c, S[:-1] + "+", "")


def _filled(template: str, text: Column, pattern: str, match: Column) -> Column:
    parts = [text if x == "{text}" else compact(match) if x == "{0}" else compact(F.regexp_extract(text, pattern, int(x[1:-1]))) if x[0] == "{" else F.lit(x) for x in _groups(template)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _words(rule: Rule) -> list[str]:
    """Words of which a block holds one if the rule matches it."""
    plain = re.sub(r"\\[\[\]]|\[[^\]]*\][*+?]?(\{[^}]*\})?|\(\?:|[\\^$(){}*+?|.]|[0-9,]+", "\0", rule.pattern)
    return list(rule.needs[:1]) or [x for x in plain.split("\0") if x]


def _clauses(pattern: str) -> list[tuple[str, ...]]:
    """Sets of words of a pattern: each text that it matches holds one word of every set. Made of its literals, of small classes and of groups that have one in each branch."""
    best = lambda clauses: max(clauses, key=lambda c: (min(map(len, c)), -len(c)))

    def group(i: int) -> tuple[list[tuple[str, ...]], int]:
        """The sets of what begins at i, and where its closing bracket or the end stands."""
        branches: list[list[tuple[str, ...]]] = [[]]
        word = ""
        while True:
            c = pattern[i : i + 1]
            small = inside = None
            if c in ("", ")", "|", "^", "$", "."):
                i += 1
            elif c == "[":
                end = pattern.index("]", i + 1)
                small, i = pattern[i + 1 : end], end + 1
                small = None if len(small) > 3 or set(small) & set("^\\") or "-" in small[1:-1] else tuple(small)
            elif c == "(":
                plain = pattern[i + 1 : i + 2] != "?" or pattern[i + 1 : i + 3] == "?:"
                inside, i = group(i + (1 if pattern[i + 1 : i + 2] != "?" else 3))
                inside, i = inside if plain else [], i + 1
            elif c == "\\" and pattern[i + 1] == "x":
                code = re.match(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))", pattern[i:])
                c, i = chr(int(code[1] or code[2], 16)), i + len(code[0])
                small = (c,)
            elif c == "\\":
                small, i = (None if pattern[i + 1].isalnum() else (pattern[i + 1],)), i + 2
            else:
                small, i = (c,), i + 1
            times = re.match(r"(?:[*+?]|\{([0-9]+)[^}]*\})[?+]?", pattern[i:]) if c not in ("", ")", "|") else None
            i += len(times[0]) if times else 0
            must = not times or times[0][0] == "+" or int(times[1] or 0) > 0
            if must and small and len(small) == 1:
                word += small[0]
            if times or not small or len(small) > 1:
                branches[-1] += [(word,)] if word else []
                word = ""
            if must:
                branches[-1] += inside or ([small] if small and len(small) > 1 else [])
            if c == "|":
                branches.append([])
            elif c in ("", ")"):
                if len(branches) == 1:
                    return branches[0], i - 1
                return ([tuple(dict.fromkeys(w for b in branches for w in best(b)))] if all(branches) else []), i - 1

    return group(0)[0]


def _keys(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, ...]], list[list[tuple[str, ...]]]]:
    """The sets of words that are looked for in every block, one at least of each rule that has any and few words in all, as rules share them; and all sets of each rule, those of fewest words first."""
    every = [sorted({*_clauses(r.pattern), *((w,) for w in r.needs)}, key=lambda c: (len(c), -min(map(len, c)), c)) for r in rules]
    keys: list[tuple[str, ...]] = []
    left = [set(x) for x in every if x]
    while left:
        worth = {c: (sum(c in x for x in left) / len(c), min(map(len, c)), c) for x in left for c in x}
        keys.append(max(worth, key=worth.get))
        left = [x for x in left if keys[-1] not in x]
    return keys, every


def facts(blocks: DataFrame, rules: tuple[Rule, ...] = POLICY) -> DataFrame:
    """(doc_id, pos, kind, target, name, value, confidence, flag, start, length): a row for each match of a rule in blocks(doc_id, pos, text) that stays.

    A rule matches a block once, at its first match in the trimmed text; start counts from 1. Where matches for one target overlap, the rule that stands first stays; blocks that are null or blank have none.
    """
    text = F.btrim(F.col("text"), F.lit("".join(map(chr, (*range(9, 14), 32, 0xA0, 0x3000)))))  # the characters of S
    keys, sets = _keys(rules)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(F.col("t"), F.lit(w)) for w in words])
    each = []
    for rank, (rule, own) in enumerate(zip(rules, sets, strict=True)):
        match = F.regexp_extract(F.col("t"), rule.pattern, 0)
        held = reduce(lambda a, b: a & b, [F.contains(F.col("t"), F.lit(x)) for x in rule.needs] + [~F.contains(F.col("t"), F.lit(x)) for x in rule.forbids], F.lit(True))
        fact = F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.target).alias("target"), _filled(rule.name, F.col("t"), rule.pattern, match).alias("name"), _filled(rule.value, F.col("t"), rule.pattern, match).alias("value"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.flag).alias("flag"), F.lit(rule.alone).alias("alone"), F.instr(F.col("t"), match).alias("start"), F.length(match).alias("length"))
        # a search for words costs a fiftieth of a regular expression that fails; what most blocks lack is known already
        near = reduce(lambda a, b: a & b, [F.col(f"h.k{keys.index(c)}") for c in own if c in keys] + [has(c) for c in own if c not in keys], F.lit(True))
        each.append(F.when(near & held & F.col("t").rlike(rule.pattern), fact))
    held_keys = F.struct(*[has(c).alias(f"k{k}") for k, c in enumerate(keys)], F.lit(not all(sets)).alias("any"))
    may = reduce(lambda a, b: a | b, [F.col(f"h.k{k}") for k in range(len(keys))], F.col("h.any"))
    overlaps = lambda a, b: (a["target"] == b["target"]) & (a["rank"] < b["rank"]) & (a["start"] < b["start"] + b["length"]) & (b["start"] < a["start"] + a["length"])
    # exploding an array of one value keeps the optimiser from writing it out at each of its uses
    rows = blocks.select("doc_id", "pos", F.explode(F.array(text)).alias("t")).select("doc_id", "pos", "t", F.explode(F.array(held_keys)).alias("h"))
    # the higher-order function on pos keeps this step out of whole-stage code, where all rules make one method, too long for the JVM to compile; around the rules themselves it would have them interpreted
    found = rows.where(may).select("doc_id", F.transform(F.array("pos"), lambda x: x)[0].alias("pos"), F.array(*each).alias("f"))
    found = found.select("doc_id", "pos", F.explode(F.array("f")).alias("f")).select("doc_id", "pos", F.explode(F.array(F.array_compact("f"))).alias("f"))
    rows = found.select("doc_id", "pos", F.explode_outer(F.filter("f", lambda x: ~F.exists("f", lambda y: overlaps(y, x)))).alias("x")).where("x IS NOT NULL").select("doc_id", "pos", "x.*")
    guards = sorted({r.alone for r in rules if r.alone})
    if guards:  # only documents' facts are shuffled, not their texts
        spoken = F.max(F.when(F.col("kind").isin(*guards), F.struct("kind", "target"))).over(W.partitionBy("doc_id", "target"))
        rows = rows.withColumn("spoken", spoken).where((F.col("alone") == "") | F.col("spoken").isNull() | (F.col("spoken.kind") != F.col("alone"))).drop("spoken")
    return rows.drop("rank", "alone")


def facts_sql(rules: tuple[Rule, ...] = POLICY, blocks: str = "blocks") -> str:
    """The same from the same rows of rules, as DuckDB SQL over a table of blocks: one SELECT a rule, then a self-join for overlaps."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    squeeze = lambda x: f"regexp_replace({x}, {quote(S[:-1] + '+')}, '', 'g')"
    parts = []
    for rank, r in enumerate(rules):
        fill = lambda t, r=r: " || ".join("t" if x == "{text}" else squeeze(f"regexp_extract(t, {quote(r.pattern)}, {x[1:-1]})") if x[0] == "{" else quote(x) for x in _groups(t))
        where = " AND ".join([f"contains(t, {quote(x)})" for x in r.needs] + [f"NOT contains(t, {quote(x)})" for x in r.forbids] + [f"regexp_matches(t, {quote(r.pattern)})"])
        parts.append(f"SELECT doc_id, pos, {rank} AS rank, {quote(r.kind)} AS kind, {quote(r.target)} AS target, {fill(r.name)} AS name, {fill(r.value)} AS value, {r.confidence} AS confidence, {quote(r.flag)} AS flag, {quote(r.alone)} AS alone, instr(t, regexp_extract(t, {quote(r.pattern)}, 0)) AS start, length(regexp_extract(t, {quote(r.pattern)}, 0)) AS length FROM trimmed WHERE {where}")
    return (
        f"WITH trimmed AS (SELECT doc_id, pos, regexp_replace(text, {quote(f'^{S}|{S}$')}, '', 'g') AS t FROM {blocks}), found AS ({' UNION ALL '.join(parts)}), "
        "kept AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.pos = f.pos AND g.target = f.target AND g.rank < f.rank AND g.start < f.start + f.length AND f.start < g.start + g.length)) "
        "SELECT doc_id, pos, kind, target, name, value, CAST(confidence AS DOUBLE) AS confidence, flag, start, length FROM kept k WHERE alone = '' OR NOT EXISTS (SELECT 1 FROM kept g WHERE g.doc_id = k.doc_id AND g.target = k.target AND g.kind = k.alone)"
    )
