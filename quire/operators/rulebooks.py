"""Rule tables for minutes of meetings and for guides to applications, beside the one for policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.rules import S, Rule
from quire.operators.runs import bodies, each, is_section, numbered, section_name

_CJK = r"\x{4e00}-\x{9fff}"
_DAY = r"20[0-9]{2}(?:年[0-9]{1,2}月[0-9]{1,2}日|[-/.][0-9]{1,2}[-/.][0-9]{1,2})"
_CHAIR = rf"(?:县委副书记、代县长|区政府党组书记、区长|市委副书记、市长|县委副书记、县长|县长|区长|市长)?([{_CJK}·]{{2,4}}?)(?:在[^，。；]{{1,30}})?主持召开"

#: Rules for minutes of meetings, the number's forms first.
MEETING = (
    Rule("meeting_opening_full_number_alias", "meeting_number", f"20[0-9]{{2}}{S}年{S}第{S}[0-9]+{S}次常务会议", "{0}", "{0}", 0.9),
    Rule("meeting_opening", "meeting_number", f"第{S}([0-9]+){S}次(?:常务|专题|全体)?(?:（[^）]+）)?会议", "第{1}次", "第{1}次", 0.9),
    Rule("meeting_opening", "meeting_number", f"会议纪要第{S}([0-9]+){S}期", "第{1}期", "第{1}期", 0.9),
    Rule("meeting_opening", "meeting_number", f"第{S}([0-9]+){S}号会议纪要", "第{1}号", "第{1}号", 0.9),
    Rule("meeting_document_number_pattern", "meeting_number", f"[{_CJK}]{{1,12}}〔20[0-9]{{2}}〕{S}[0-9]+{S}号", "{0}", "{0}", 0.9, alone="meeting_opening"),
    Rule("meeting_opening", "chairperson", _CHAIR, "{1}主持", "{1}", 0.9),
    Rule("meeting_opening_organizer_review", "organizer", _CHAIR, "{1}", "{1}", 0.66, flag="medium_risk_chairperson_as_organizer"),
    Rule("meeting_source_organizer", "organizer", rf"^来源{S}[:：]{S}([^，。；;\n]{{2,80}})$", "{1}", "{1}", 0.66, flag="medium_risk_source_organizer"),
    Rule("meeting_opening_location", "meeting_location", "在([^，。；;]{2,40}会议室)主持召开", "{1}", "{1}", 0.9),
    Rule("mixed_attendees_sentence", "attendees", "出席会议", "出席会议", "{text}", 0.65, flag="medium_risk_mixed_attendees"),
    Rule("mixed_attendees_sentence", "attendees", f"^出{S}席{S}[:：]", "出席", "{text}", 0.65, flag="medium_risk_mixed_attendees"),
    Rule("department_attendees_sentence", "attendees", "各乡镇、各部门单位", "{0}", "{text}", 0.66, flag="medium_risk_mixed_attendees"),
    Rule("meeting_opening_sentence", "topics", "审议《", "reviewed matters", "{text}", 0.8),
    Rule("meeting_opening_sentence", "topics", rf"会议[，,、\x20]*(?:研究审议|研究了|审议通过|听取了?|传达学习|传达|原则同意)([^。；;]{{2,500}})", "{1}", "{text}", 0.75),
    Rule("numbered_agenda_heading", "topics", rf"^(?:[一二三四五六七八九十]+|[0-9]+){S}[、.．]{S}([^。；;]{{2,500}})", "{1}", "{text}", 0.78),
    Rule("meeting_decision_sentence", "decisions", "会议原则通过|会议原则同意|原则同意|原则通过", "{0}", "{text}", 0.86),
    Rule("meeting_action_item_sentence", "action_items", "^会议要求", "会议要求", "{text}", 0.86),
    Rule("meeting_action_item_sentence", "action_items", "^会议强调", "会议强调", "{text}", 0.86),
    Rule("meeting_action_item_sentence", "action_items", "(?:由|请)[^\n]{1,30}(?:负责|牵头)|责成[^\n]{1,30}(?:负责|落实|推进)", "责任行动", "{text}", 0.86),
)


def _labels(kind: str, target: str, labels: tuple[str, ...], confidence: float = 0.86) -> Rule:
    return Rule(kind, target, rf"^({'|'.join(labels)}){S}[:：]{S}([^\n]{{1,1000}})$", "{1}", "{2}", confidence)


#: Rules for guides to applications, labels first.
GUIDE = (
    _labels("general_contact_label", "contact", ("咨询电话", "联系电话", "咨询方式", "办理窗口电话", "服务热线", "服务电话", "电话")),
    _labels("service_object_labeled_sentence", "service_object", ("服务对象", "适用对象", "申请对象", "办理对象", "面向对象", "申报主体要求", "申报主体", "可申请主体", "项目负责人要求")),
    _labels("process_steps_labeled_sentence", "process_steps", ("办理流程", "申请流程", "申报流程", "流程步骤", "申报方式")),
    Rule("general_addressee_service_object", "service_object", f"^(各有关单位|各有关部门|各单位|各部门|有关单位){S}[:：]$", "{1}", "{1}", 0.86),
    Rule("explicit_deadline", "deadline", rf"(申报截止时间|报名截止时间|提交截止时间|受理截止时间|截止日期|截止时间|办理期限|受理时间|申报时间|申请时间|材料提交时间)(?:（[^）]{{0,30}}）)?(?:为|[:：])?{S}({_DAY}(?:[0-9]{{1,2}}:[0-9]{{2}})?|[一二三四五六七八九十0-9]{{1,4}}{S}个工作日)", "{1}", "{2}", 0.9),
    Rule("deadline_sentence", "deadline", f"(?:于{S})?{_DAY}{S}(?:前|之前){S}(?:提交|完成申报|完成报名|报送)|截至{S}{_DAY}", "于日期前提交", "{0}", 0.86),
    Rule("service_object_sentence", "service_object", "^(?:面向|适用于)([^。；;]{2,500})[。；;]?$", "适用对象", "{1}", 0.8),
    Rule("service_object_sentence", "service_object", "拟申请([^，。；]{2,80}的企业)", "拟申请企业", "{1}", 0.82),
    Rule("service_object_requirement", "service_object", "申报主体", "申报主体", "{text}", 0.86, ("合作单位",)),
    Rule("process_steps_sentence", "process_steps", "项目申报采用[^。；;]{0,100}申报方式[^。；;]{0,800}", "申报方式", "{0}", 0.86),
    Rule("process_steps_overview", "process_steps", "具体办理流程如下", "五步走办理流程", "{text}", 0.84),
    Rule("application_conditions_sentence", "application_conditions", "经营范围中需含", "经营范围中需含货物进出口", "{text}", 0.8),
    Rule("application_conditions_sentence", "application_conditions", "(?:申请[^。；;]{0,50}(?:应具备|必须满足)|符合以下条件)[^。]{2,800}", "申请条件", "{0}", 0.8),
    Rule("application_conditions_sentence", "application_conditions", "(申请[^，。；]{1,40}(?:单位|企业|机构))", "{1}", "{text}", 0.72, flag="medium_risk_role"),
    Rule("application_material_requirement", "application_materials", "推荐函", "推荐函", "{text}", 0.86),
)
#: What sections of a guide speak of, by their names.
GUIDE_SECTIONS = {
    "适用范围": "service_object", "服务对象": "service_object", "申报主体": "service_object", "申报主体要求": "service_object", "项目负责人要求": "service_object",
    "申请材料目录": "application_materials", "申请材料": "application_materials", "申报材料": "application_materials",
    "办理基本流程": "process_steps", "办理流程": "process_steps", "申报方式": "process_steps", "申报流程": "process_steps",
    "服务电话": "contact", "咨询电话": "contact", "联系方式": "contact",
    "申请条件": "application_conditions", "受理条件": "application_conditions", "办理条件": "application_conditions", "申报条件": "application_conditions", "申报要求": "application_conditions",
}
#: Sections of these targets are their first text alone.
SHORT = ("contact", "service_object")


def guide_sections(blocks: DataFrame, limit: int = 7) -> DataFrame:
    """(doc_id, head_pos, name, target, body): sections of a guide by the names of GUIDE_SECTIONS, `limit` blocks at most, to the next numbered heading."""
    stop = rf"^{S}[一二三四五六七八九十]+{S}[、.．]{S}[^。；]{{2,30}}{S}$"
    found = bodies(blocks, lambda t: is_section(t, tuple(GUIDE_SECTIONS)), lambda t: numbered(t, stop), limit)
    found = each(found, F.filter("bodies", lambda x: x["body"] != "")).withColumn("name", section_name(F.col("head")))
    target = F.create_map(*[F.lit(x) for pair in GUIDE_SECTIONS.items() for x in pair])[F.col("name")]
    body = F.when(target.isin(*SHORT), F.substring_index("body", "\n", 1)).otherwise(F.col("body"))
    return found.select("doc_id", "head_pos", "name", target.alias("target"), body.alias("body"))

#: Words that make a document's opening a guide's, a label that speaks for itself, and words of a category to review.
GUIDE_WORDS = ("办事指南", "申报指南", "申报流程说明")
OWN_LABEL = "(服务对象|适用对象|申报对象|申请对象|办理对象)[:：]"
CATEGORY_WORDS = ("办理事项及证明材料清单", "经费额度", "申报流程说明")


def front_matter(blocks: DataFrame, early: int = 12) -> DataFrame:
    """(doc_id, pos, target, name, value, confidence): what the opening of a guide says by its places: the second text that is not blank is its object, the third its conditions.

    Of blocks(doc_id, pos, text) only the first `early` of a document count. There must be three texts among them and a guide's words, and none with a label of its own. The first
    text with a word of CATEGORY_WORDS is a category to review. A document's opening is bounded, so it meets in one row.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    first = blocks.withColumn("n", F.row_number().over(order)).where((F.col("n") <= early) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    opening = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b")).where("size(b) >= 3")
    has = lambda *words: F.exists("b", lambda x: x["text"].rlike("|".join(words)))
    guide = opening.where((has(*GUIDE_WORDS) | (has("各有关单位") & has("项目申报指南"))) & ~has(OWN_LABEL))
    fact = lambda x, target, name, sure: F.struct(x["pos"].alias("pos"), F.lit(target).alias("target"), name.alias("name"), x["text"].alias("value"), F.lit(sure).alias("confidence"))
    marked = F.get(F.filter("b", lambda x: x["text"].rlike("|".join(CATEGORY_WORDS))), F.lit(0))
    marker = F.coalesce(*[F.when(F.contains(marked["text"], F.lit(w)), F.lit(w)) for w in CATEGORY_WORDS])
    three = F.array(fact(F.col("b")[1], "service_object", F.lit("service or subject section"), 0.84), fact(F.col("b")[2], "application_conditions", F.lit("process or condition detail"), 0.8), F.when(marked.isNotNull(), fact(marked, "category", marker, 0.66)))
    return guide.select("doc_id", F.explode(F.array_compact(three)).alias("x")).select("doc_id", "x.*")
