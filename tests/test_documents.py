"""Extraction, summaries and structure on small documents, against what a reader would say and against plain loops."""

import datetime
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.operators import blocktools, canonical_build, chunks, contracts, cover, dates, leakage, lineage, matching, measures, rulebooks, rules, runs, summaries, trees
from quire.streaming import packs

BLOCK = "doc_id int, pos int, type string, text string"


def blocks(spark, *docs):
    return spark.createDataFrame([(d, p, *(x if isinstance(x, tuple) else ("paragraph", x))) for d, texts in enumerate(docs) for p, x in enumerate(texts)], BLOCK)


def facts(spark, *texts):
    return {(r["target"], r["kind"], r["name"], r["value"]) for r in rules.facts(blocks(spark, texts)).collect()}


def test_rules_read_labels_and_sentences(spark):
    assert facts(spark, "适用对象：中小企业。") == {("target_audience", "policy_target_audience_label", "适用对象", "中小企业")}
    assert facts(spark, "自 2024 年 03 月 1 日起施行") == {("effective_date", "policy_effective_date_sentence", "自2024年3月1日起施行", "2024 年 3 月 1 日")}
    assert facts(spark, "自2024年1月1日至2025年12月31日执行") == {
        ("effective_date", "policy_effective_period_sentence", "自2024年1月1日至2025年12月31日", "自2024年1月1日至2025年12月31日"),
        ("publish_date", "policy_effective_period_start_review", "2024年1月1日", "2024年1月1日"),
    }
    assert facts(spark, "对个人消费者购买新车给予补贴") == {("target_audience", "policy_subsidy_scope_audience", "个人消费者", "个人消费者")}
    assert facts(spark, "有效期至2026年01月05日。") == {("valid_until", "policy_valid_until_sentence", "有效期至", "2026年1月5日")}
    assert facts(spark, None, "", "   ", "无关文字") == set()


def test_rules_keep_one_fact_a_span_and_obey_guards(spark):
    one = facts(spark, "第一条 为了规范管理，根据法律，制定本法。")
    assert one == {("policy_measures", "policy_measure_enactment_purpose", "制定本法", "第一条 为了规范管理，根据法律，制定本法。")}  # the legal basis forbids it
    assert {x[1] for x in facts(spark, "2024年5月6日")} == {"policy_signature_date_review"}
    assert {x[1] for x in facts(spark, "发布日期：2024年5月1日", "2024年5月6日")} == {"policy_publish_date_label"}  # a label speaks for the document
    both = rules.facts(blocks(spark, ["各省主管部门和有关单位、中小企业主管部门："])).collect()
    spans = [(r["target"], r["start"], r["start"] + r["length"]) for r in both]
    assert all(a == b or a[0] != b[0] or a[2] <= b[1] or b[2] <= a[1] for a in spans for b in spans) and len({r["name"] for r in both}) == 1


def test_signature_runs_end_at_blank_lines_and_limits(spark):
    many = [f"北京市{x}局" for x in "甲乙丙丁戊己庚辛壬癸"]
    rows = runs.signatures(blocks(spark, ["标题", "财政部", "教育部 民政部", "2024年1月2日"], ["财政部", "", "教育部", "2024-1-2"], ["财政部", "说明：", "2024年1月2日"], [*many, "二〇二四年一月二日"], ["2023年1月1日", "财政部", "2024年1月2日", "教育部", "2025年1月2日"], [None])).collect()
    got = {r["doc_id"]: (r["issuer"], r["first_pos"], r["n_blocks"], r["date"]) for r in rows}
    assert got == {0: ("财政部、教育部、民政部", 1, 2, "2024年1月2日"), 1: ("教育部", 2, 1, "2024-1-2"), 3: ("、".join(many[2:]), 2, 8, "二〇二四年一月二日"), 4: ("财政部", 1, 1, "2024年1月2日")}
    two = runs.signatures(blocks(spark, [*many, "2024年1月2日"]), 2).collect()
    assert [r["n_blocks"] for r in two] == [2]


def test_bodies_stop_at_heads_limits_and_soft_headings(spark):
    doc = [("heading", "第二章 支持措施"), ("heading", "总则"), "甲", "", "乙", ("heading", "说明"), "丙", ("heading", "申报材料"), "丁"]
    assert [tuple(r) for r in runs.measures(blocks(spark, doc)).collect()] == [(0, 0, "支持措施", "总则\n甲\n乙", 3)]  # a heading is a body's first text, the next one ends it
    long = [("heading", "三、主要内容"), *[f"条{i}" for i in range(20)]]
    assert runs.measures(blocks(spark, long)).first()["body"] == "\n".join(f"条{i}" for i in range(11))
    alone = ["主要内容", ("heading", "附则"), "丁"]
    assert runs.measures(blocks(spark, alone)).first()["body"] == "主要内容"
    sections = runs.numbered_sections(blocks(spark, ["一、申报要求", "甲", None, "二、申报方式", "三、其他事项", "乙", "四、申报方式", "丙"])).collect()
    assert sorted((r["head_pos"], r["name"], r["body"]) for r in sections) == [(0, "申报要求", "甲"), (6, "申报方式", "丙")]


def test_issuers_by_precedence(spark):
    labelled = spark.createDataFrame([(1, "甲部")], "doc_id int, label string")
    titles = spark.createDataFrame([(1, "财政部关于事"), (2, "财政部关于事"), (3, "关于事"), (4, "财政部 教育部关于事")], "doc_id int, text string")
    signed = spark.createDataFrame([(2, "民政部"), (3, "民政部")], "doc_id int, issuer string")
    sites = spark.createDataFrame([(i, "site") for i in range(1, 5)], "doc_id int, site string")
    assert sorted((r["doc_id"], r["issuer"], r["confidence"]) for r in runs.issuers(labelled, titles, signed, sites).collect()) == [(1, "甲部", 0.91), (2, "财政部", 0.9), (3, "民政部", 0.9), (4, "site", 0.6)]


def best(spark, *texts):
    r = dates.best_meeting_date(blocks(spark, texts)).collect()
    return tuple(r[0])[1:] if r else None


def test_meeting_dates_score_inherit_and_break_ties(spark):
    assert best(spark, "会议于2024年3月5日召开。", "会议时间：2024年3月4日") == (1, 5, "2024年3月4日", "2024年3月4日", "2024年3月4日", 0.9, "explicit_meeting_date", "")
    assert best(spark, "（二〇二四年三月五日）", "会议研究了3月4日的事项")[:5] == (0, 6, "二〇二四年三月五日", "二〇二四年三月五日", "二〇二四年三月五日")
    assert best(spark, "2024年3月5日", "", "会议听取3月4日汇报") == (2, 3, "3月4日", "2024年3月4日", "3月4日", 0.78, "meeting_opening_date", "")
    assert best(spark, "2024年3月5日", "a", "b", "c", "会议听取03月4日汇报") == (4, 3, "03月4日", "03月4日", "03月4日", 0.65, "meeting_opening_date", "medium_risk_partial_date")
    assert best(spark, "主持召开会议 2024-3-5", "会议审议2024年3月4日")[:3] == (0, 4, "2024-3-5")
    assert best(spark, "会议于2024年3月5日召开", "会议于2023年1月1日召开")[0] == 0  # equal scores: the earlier block
    assert best(spark, "会议日期：2024年3月5日，发布日期：2024年3月6日", "日期：2024/3/7")[2] == "2024/3/7"
    assert best(spark, "2024年3月5日", None, "一九九九年一月一日 附") is None


def test_chunk_summaries(spark):
    texts = {
        "1. 名称：甲\n说明\n2、地点: 乙\n1. 名称：甲": "1. 名称：甲\n2、地点: 乙",
        "甲：\n乙：\n丙：\n丁：一\n戊：二": "丁：一\n戊：二",
        "甲：\n丁：一\n戊：二": "甲： 丁：一 戊：二",
        "短句。第二句较长一些。第三句。": "短句。第二句较长一些。",
        "  ": "",
        "无" * 130: "无" * 120 + "...",
        "1. a: " + "x" * 200: "1.a: " + "x" * 115 + "...",
    }
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", summaries.chunk_summary(F.col("x")).alias("s"))
    got = {r["x"]: r["s"] for r in rows.collect()}
    texts["1. a: " + "x" * 200] = ("1. a: " + "x" * 200)[:120] + "..."
    assert got == texts


def test_document_summaries_keep_both_budgets(spark):
    doc = [("heading", "T"), "First. Second.", "Third.", ("heading", "U"), "", "First.", ("heading", "V"), "Fourth! Fifth."]
    full = summaries.block_summaries(blocks(spark, doc)).first()
    assert (full["summary"], full["positions"], full["truncated"]) == ("First.\nFourth!", "1,7", False)  # a repeat is left out
    assert summaries.block_summaries(blocks(spark, doc), 5, 8).first()["summary"] == "First."
    cut = summaries.block_summaries(blocks(spark, doc), 5, 4).first()
    assert (cut["summary"], cut["truncated"]) == ("Firs", True)
    flat = summaries.block_summaries(blocks(spark, ["a. b. c.", "d."]), 3, 500).first()
    assert (flat["summary"], flat["n_sentences"]) == ("a.\nb.\nc.", 3)
    assert summaries.block_summaries(blocks(spark, [None, ""])).first()["summary"] == ""


def test_faithfulness_finds_each_fault(spark):
    source = "财政局2024年1月2日拨款100万元。" + "说明文字" * 20
    cases = {"fine": "财政局拨款100万元。", "empty": None, "new_dates": "2025年3月4日拨款", "new_amounts": "拨款200万元", "new_organisations": "海淀医院说明", "missing": "文字", "overlong": source * 2}
    rows = spark.createDataFrame([(k, v, source, ["必要"] if k == "missing" else None, ["禁止"]) for k, v in cases.items()], "doc_id string, summary string, source string, must array<string>, must_not array<string>")
    got = {r["doc_id"]: r for r in summaries.faithfulness(rows).collect()}
    assert got["fine"]["passed"] and not any(got[k]["passed"] for k in cases if k != "fine")
    assert all(got[k][k] not in ("", False) for k in cases if k != "fine")


def test_numbers_belong_to_the_nearest_label(spark):
    cells = spark.createDataFrame([(1, "甲局", "收入", "10.50万元"), (1, "甲局", "支出", "20万元"), (1, "乙局", "收入", "30万元"), (2, "丙局", "收入", "1万元"), (2, "丙局", "支出", None)], "doc_id int, row string, col string, cell string")
    said = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "doc_id int, summary string")
    wrong = lambda *x: {r["doc_id"]: r["violations"] for r in summaries.table_numbers(cells, said(*x)).collect()}
    assert wrong("甲局收入10.5万元，支出20万元；乙局收入30万元", None) == {}
    assert wrong("甲局收入20万元；乙局收入10.5万元", "丙局支出1万元") == {1: ["乙局/收入:10.5万元", "甲局/收入:20万元"]}
    assert wrong("5万元属甲局，共20万元、99个", "丙局" + "x" * 90 + "7万元") == {1: ["甲局:99个"]}


def test_section_trees_of_any_depth(spark):
    def tree(k, n):
        return {"title" if k % 2 else "heading": f"s{k}", "paragraphs": [f"p{k}", "", 3], "tables": [{"rows": [["a", k]]}, {"x": 1}], "children": [tree(k + 1, n), "no"] if k < n else None}

    def walk(node, path, level, out):
        name = node.get("heading") or node.get("title")
        out.append(("heading", level, name, path))
        out += [("paragraph", None, p, f"{path}.paragraphs[{i}]") for i, p in enumerate(node["paragraphs"]) if isinstance(p, str) and p]
        out += [("table", None, json.dumps(t["rows"], separators=(",", ":")), f"{path}.tables[{i}]") for i, t in enumerate(node["tables"]) if "rows" in t]
        for i, c in enumerate(node["children"] or []):
            if isinstance(c, dict):
                walk(c, f"{path}.children[{i}]", level + 1, out)

    first, second, want = tree(1, 40), tree(1, 2), []
    for i, x in enumerate((first, second)):
        walk(x, f"payload.document.sections[{i}]", 1, want)
    payload = json.dumps({"document": {"sections": [first, second]}})
    rows = trees.section_blocks(spark.createDataFrame([(1, payload), (2, "no json"), (3, None), (4, '{"document": {"sections": {}}}')], "id int, payload string")).orderBy("pos").collect()
    assert [(r["type"], r["level"], r["text"] or r["rows"], r["external_path"]) for r in rows] == want and max(r["level"] or 0 for r in rows) == 40
    assert {r["id"] for r in rows} == {1} and rows[4]["block_id"] == "b005"


def test_tree_differences_tell_kinds_apart(spark):
    a = {"k": 1, "same": [1, {"x": None}], "was": "here", "n": 1, "t": 1, "gone": {"in": "a"}, "id": 5, "two": "v", "pair": "v"}
    b = {"k": 2, "same": [1, {"x": None}], "now": "here", "n": 1, "t": "1", "id": 6, "new": [], "x": "v"}
    rows = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, payload string")
    found = trees.tree_differences(rows(json.dumps(a), "{}", None), rows(json.dumps(b), "{}", "[]"), ("id",)).collect()
    got = {(r["id"], r["path"]): (r["change"], r["other_path"]) for r in found}
    assert got == {(0, "$.k"): ("changed", None), (0, "$.was"): ("moved", "$.now"), (0, "$.t"): ("retyped", None), (0, "$.gone"): ("lost", None), (0, "$.gone.in"): ("lost", None), (0, "$.new"): ("added", None), (0, "$.two"): ("lost", None), (0, "$.pair"): ("lost", None), (0, "$.x"): ("added", None), (2, "$"): ("added", None)}


def test_leaks_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abß eÉ-１") for _ in range(rng.choice([1, 3, 9, 20, 40])))
    texts = ["".join(word() for _ in range(rng.randint(1, 12))) for _ in range(60)] + [None, "", "--"]
    values = [t[i : i + rng.choice([2, 7, 8, 12, 31, 50])] for t in texts[:40] for i in [rng.randint(0, max(len(t) - 5, 0))]] + [word() for _ in range(20)] + [None, "-", texts[0]]
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKC", x or "").casefold() if c.isalnum())
    want = set()
    for i, v in enumerate(map(plain, values)):
        for j, t in enumerate(map(plain, texts)):
            if v and t and (v in t or t in v):
                want.add((i, j, "equal" if v == t else "value_in_text" if v in t else "text_in_value"))
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "id int, text string")
    assert {tuple(r) for r in leakage.leaks(rows(values), rows(texts)).collect()} == want and {x[2] for x in want} == {"equal", "value_in_text", "text_in_value"}


def test_canonical_objects_follow_the_schema(spark):
    meta = spark.createDataFrame([(1, '{"a":{"b":[1,"x"],"_s":1},"t":null}'), (2, "bad")], "id int, payload string")
    text = spark.createDataFrame([(1, "b1", 'say "hi"'), (1, "b2", None)], "id int, block_id string, text string")
    wanted = [(1, "z.y", 0, "metadata.a.b"), (1, "z.x", 0, "blocks.b1.text"), (1, "z.x", 1, "metadata.t"), (1, "m", 0, "metadata.a._s"), (1, "n", 0, "blocks.b2.text"), (1, "q", 0, "metadata.no"), (2, "n", 0, "blocks.b1.text"), (2, "z.y", 0, "metadata.a.b")]
    rows = canonical_build.canonical(spark.createDataFrame(wanted, "id int, field string, rank int, path string"), meta, text, ("n", "z.x", "m", "z.y")).collect()
    got = {r["id"]: (r["json"], r["conflicts"], r["errors"]) for r in rows}
    assert got == {1: ('{"n":null,"z":{"x":"say \\"hi\\"","y":[1,"x"]}}', "z.x", "metadata.a._s:unsafe_source_path|metadata.no:source_missing"), 2: ("{}", "", "blocks.b1.text:source_missing|metadata.a.b:source_missing")}


def test_chunk_faults_are_found_once_each(spark):
    b = spark.createDataFrame([(d, f"b{k}", "table" if k == 3 else "paragraph", f"text  number {k}") for d in range(12) for k in (1, 2, 3)] + [(99, "b1", "paragraph", "x")], "doc_id int, block_id string, type string, text string")
    good = lambda d: [(d, "c1", "text number 1\n\ntext  number 2", ["b1", "b2"], ["e"], None), (d, "c2", "text  number 3", ["b3"], [], "c1")]
    rows = {d: good(d) for d in range(12)}
    change = lambda d, k, **x: rows[d].__setitem__(k, tuple({**dict(zip(("doc", "chunk", "text", "ids", "ents", "parent"), rows[d][k], strict=True)), **x}.values()))
    change(1, 0, text=" ")
    change(2, 0, ids=["b1", "b2", "b9"])
    change(3, 0, text="other words")
    change(4, 0, ents=["e", "f"])
    change(5, 1, parent="c7")
    rows[6].pop(0)
    rows[7].pop(1)
    change(8, 1, text="text number 3")
    change(9, 0, text="text number 1\n\ntext  num")
    rows[10].append((10, "c3", "number 2", ["b2"], [], None))
    rows[11] = []
    made = spark.createDataFrame([x for r in rows.values() for x in r], "doc_id int, chunk_id string, text string, source_block_ids array<string>, entity_ids array<string>, parent_id string")
    ents = spark.createDataFrame([(d, "e") for d in range(12)], "doc_id int, entity_id string")
    got = {(r["doc_id"], r["code"], r["chunk_id"] or r["block_id"]) for r in cover.chunk_faults(made, b, ents).collect()}
    assert got == {
        (1, "chunk_text_empty", "c1"), (2, "unknown_source_block", "c1"), (3, "text_not_derivable", "c1"), (4, "unknown_entity", "c1"), (5, "parent_missing", "c2"), (6, "block_missing", "b1"), (6, "block_missing", "b2"), (6, "parent_missing", "c2"),
        (7, "protected_block_missing", "b3"), (8, "protected_block_changed", "b3"), (9, "text_gap", "b2"), (10, "text_overlap", "b2"), (11, "chunks_empty", None), (99, "chunks_empty", None),
    }


def test_retrieval_counts_all_terms(spark):
    rows = spark.createDataFrame([("如何 申报 Tax 2024", "tax tax 申报 如何申报 2024")], "q string, t string")
    r = rows.select(measures.retrieval_terms(F.col("q")).alias("w"), measures.retrieval_score(measures.retrieval_terms(F.col("q")), F.lower("t"), F.array(F.lit("Tax"), F.lit("zzz"))).alias("s")).first()
    assert r["w"] == ["tax", "2024", "如何", "何申", "申报", "如何申", "何申报", "如何申报"]
    assert r["s"] == sum("tax tax 申报 如何申报 2024".count(w) for w in r["w"]) + 25


def test_fixed_windows_trim_white_space_only(spark):
    docs = spark.createDataFrame([(1, "0 first 0\n  1 second 1  \n")], "doc_id int, text string")
    assert chunks.fixed_window(docs, 100).first()["text"] == "0 first 0\n\n1 second 1"


def test_children_stand_under_the_last_level_1_heading(spark):
    docs = spark.createDataFrame([(1, "Opening line of it\nsome paragraph that is long enough\nshort\na | b\nanother paragraph of some length"), (2, "x" * 90 + "\n\n" + "y" * 90), (3, None), (4, "")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["parent_index"], r["chunk_index"], r["first_pos"]) for r in chunks.parent_child(docs, 20).collect())
    want = []
    for doc, text in ((1, docs.collect()[0]["text"]), (2, docs.collect()[1]["text"])):
        heads, number = 0, {}
        rows = {r["chunk_index"]: r["first_pos"] for r in chunks.greedy(docs.where(F.col("doc_id") == doc), 20, False).collect()}
        for pos, line in enumerate(text.split("\n")):
            heads += pos == 0 and len(line) <= 80
            number |= {c: max(0, heads - 1) for c, p in rows.items() if p == pos}
        want += [(doc, number[c], c, p) for c, p in rows.items()]
    assert got == sorted(want) and len(got) > 4


def test_pack_stream_equals_the_batch_out_of_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 5), start + datetime.timedelta(minutes=2 * k), k, rng.choice(["create", "activate", "activate", "archive", "rollback", "review"])) for k in range(90)]
    files = [rows[k : k + 15] for k in range(0, 90, 15)]
    files[1], files[2] = files[2], files[1]  # within the delay
    schema = "pack_id bigint, ts timestamp, seq bigint, op string"
    closing = [[(9, start + datetime.timedelta(days=1 + k), 1000 + k, "review")] for k in range(2)]
    got = []

    def run(folder):
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        query = packs.history_stream(log, "90 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        query.stop()

    folder = f"{tmp_path}/in"
    for n, part in enumerate([*files, *closing]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        if n in (2, 7):  # the second run starts again from the checkpoint
            run(folder)
    want = packs.history(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r for r in got if r[0] != 9) == sorted(map(tuple, want)) and {r["after"] for r in want} >= {"draft", "active", "archived"}


def test_meeting_and_guide_rules(spark):
    said = lambda book, *texts: {(r["target"], r["name"], r["value"]) for r in rules.facts(blocks(spark, texts), book).collect()}
    text = "县长李明在县政府第一会议室主持召开2024年第3次常务会议"
    assert said(rulebooks.MEETING, text) == {("meeting_number", "2024年第3次常务会议", "2024年第3次常务会议"), ("chairperson", "李明主持", "李明"), ("organizer", "李明", "李明"), ("meeting_location", "县政府第一会议室", "县政府第一会议室")}
    assert said(rulebooks.MEETING, "会议原则同意《方案》。") == {("decisions", "会议原则同意", "会议原则同意《方案》。"), ("topics", "《方案》", "会议原则同意《方案》。")}
    assert said(rulebooks.GUIDE, "申报截止时间：2024年5月6日", "咨询电话：010-1") == {("deadline", "申报截止时间", "2024年5月6日"), ("contact", "咨询电话", "010-1")}
    assert said(rulebooks.GUIDE, "适用于本市企业。") == {("service_object", "适用对象", "本市企业")}
    found = rulebooks.guide_sections(blocks(spark, [("heading", "一、申请条件（试行）"), "甲", "乙", ("heading", "二、联系方式"), "丙", "丁"])).collect()
    assert sorted((r["name"], r["target"], r["body"]) for r in found) == [("申请条件", "application_conditions", "甲\n乙"), ("联系方式", "contact", "丙")]


def test_block_tools(spark):
    faults = spark.createDataFrame([("(a+)+",), (r"(a)\1",), ("(?<!a)b",), ("(?(1)a)",), ("(?P=n)",), ("x" * 1001,), ("^a+[bc]{2}$",), (None,)], "p string").select("p", blocktools.regex_fault(F.col("p")).alias("f"))
    assert [r["f"] and r["f"].split(" ")[0] for r in faults.collect()] == ["nested", "backreferences", "lookbehind", "conditional", "named", "regex", None, None]
    made = spark.createDataFrame([(1, "c1", 0, "甲 tax tax", ["b1"]), (1, "c2", 1, "tax 乙", ["b2"]), (1, "c3", 2, "tax tax", ["b3"])], "doc_id int, chunk_id string, place int, text string, source_block_ids array<string>")
    asked = spark.createDataFrame([(1, 1, "tax"), (2, 1, "none"), (3, 1, "?"), (4, 1, None)], "query_id int, doc_id int, query string")
    assert {tuple(r) for r in blocktools.best_chunks(asked, made).collect()} == {(1, 0, 2), (3, 0, 0), (4, 0, 0)}  # the first of equal scores
    named = spark.createDataFrame([(1, "Issuer", "甲", "schema_field", ["b2"]), (1, "issuer", "甲", "metadata", ["b3"]), (1, "fee", "乙", "metadata", None), (1, "甲方", " 乙 ", "metadata", None), (1, "person", None, "schema_field", None)], "doc_id int, name string, value string, source string, source_block_ids array<string>")
    tags = {(r["chunk_id"], r["text"], r["entity_type"], r["confidence"]) for r in blocktools.entity_tags(made, blocktools.inferred_entities(named)).collect()}
    assert tags == {("c2", "甲", "organization", 0.8), ("c1", "甲", "organization", 0.7), ("c2", "乙", "party", 0.7)}
    cases = [(3, "b", "s", "t", "x", "f"), (1, "b", "s", "t", "x", "f"), (2, "b", "s", "t", "bad", "f"), (4, "b", "s", None, "y", "f"), (5, "other", "s", "t", "z", "f"), (6, "b", "s", "t", "w", "f")]
    kept = blocktools.gold_candidates(spark.createDataFrame(cases, "place int, behaviour string, schema_id string, template_id string, source_field string, target_field string"), spark.createDataFrame([("bad", "f")], "source_field string, target_field string"), "b")
    assert {(r["candidate_id"], r["source_field"]) for r in kept.collect()} == {("kc_gold_1", "x"), ("kc_gold_2", "w")}


def test_pooled_bins_equal_pooling_neighbours(spark):
    rng = random.Random(3)
    for _ in range(4):
        bins = [(k, rng.randint(0, 9), rng.randint(1, 9)) for k in range(rng.randint(1, 8))]
        got = {r["bin"]: r["rate"] for r in measures.pooled_bins(spark.createDataFrame(bins, "bin int, positives long, n long")).collect()}
        assert [round(got[k], 9) for k, _, _ in bins] == [round(x, 9) for x in matching.pooled([(p, n) for _, p, n in bins])]
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "doc_id int")
    splits = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "doc_id int, split string")
    assert tuple(measures.split_checks(ids, splits).first()) == (1, 2)


def test_front_matter_and_exclusions(spark):
    rows = rulebooks.front_matter(blocks(spark, ["办事指南", " ", "甲", "乙", "经费额度100"], ["办事指南", "甲"], ["申报指南", "服务对象：甲", "乙"], ["各有关单位", "项目申报指南", "丙"], ["x", "y", "z"], [*["", None] * 6, "办事指南", "a", "b"])).collect()
    assert {(r["doc_id"], r["pos"], r["target"]) for r in rows} == {(0, 2, "service_object"), (0, 3, "application_conditions"), (0, 4, "category"), (3, 1, "service_object"), (3, 2, "application_conditions")}
    b = spark.createDataFrame([(1, "b1", "paragraph", "x"), (1, "b2", "paragraph", "y"), (1, "b3", "table", "z"), (1, "b4", "paragraph", "w")], "doc_id int, block_id string, type string, text string")
    c = spark.createDataFrame([(1, "c1", "x", ["b1"], [], None)], "doc_id int, chunk_id string, text string, source_block_ids array<string>, entity_ids array<string>, parent_id string")
    out = spark.createDataFrame([(1, "b2", "known"), (1, "b3", "known"), (1, "b4", "other"), (1, "b9", "known")], "doc_id int, block_id string, rule string")
    ents = spark.createDataFrame([], "doc_id int, entity_id string")
    assert {(r["code"], r["block_id"]) for r in cover.chunk_faults(c, b, ents, exclusions=out, rules=("known",)).collect()} == {("protected_block_missing", "b3"), ("protected_block_exclusion", "b3"), ("unknown_exclusion_rule", "b4"), ("block_missing", "b4")}


def test_contract_rows(spark):
    hints = spark.createDataFrame([('{"schema_hint": 3, "document_type": "b"}',), ('{"document": {"schema_hint": "a", "document_type": "b"}}',), ('{"schema_hint": "zzz"}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in hints.select(contracts.route_hint(F.col("j"), ("a", "b"))).collect()] == ["b", "a", None, None, None]
    docs = spark.createDataFrame([(1, "plain words before any heading, long enough to be none, of eighty characters or more in all\nHeading two here\nsome text that is long enough\n\nShort\nmore text that is long enough"), (2, ""), (3, None)], "doc_id int, text string")
    paths = {(r["doc_id"], r["pos"]): r["title_path"] for r in contracts.block_title_paths(docs).collect()}
    assert paths == {(1, 0): "", (1, 1): "Heading two here", (1, 2): "Heading two here", (1, 4): "Heading two here > Short", (1, 5): "Heading two here > Short"}
    assert {(r["doc_id"], r["n_blocks"], r["block_types"]) for r in contracts.document_rows(docs.where("doc_id > 1")).collect()} == {(2, 1, "empty"), (3, 1, "empty")}
    asked = spark.createDataFrame([(7, 2, {"Token": "x", "a": None}), (8, 99, {"a": "b"})], "request_id int, doc_id int, options map<string,string>")
    assert [(r["task_id"], r["options"]) for r in contracts.new_tasks(asked, docs).collect()] == [("task_7", "Token=***;a=")]
    gold = spark.createDataFrame([(1, "b1", "v"), (1, "b1", "v"), (1, "b7", " "), (9, "b1", "v")], "doc_id int, block_id string, value string")
    held = spark.createDataFrame([(1, "b1")], "doc_id int, block_id string")
    assert {tuple(r) for r in contracts.gold_faults(gold, held, 5).collect()} == {("unknown_document", 1), ("unknown_block", 1), ("empty_value", 1), ("repeated_row", 1), ("too_few_rows", 1)}
    want = spark.createDataFrame([(1, "mapping", "a", "x"), (1, "mapping", "b", "y"), (1, "review", "c", "z")], "doc_id int, kind string, source string, target string")
    got = spark.createDataFrame([(1, "accepted", "a", "x"), (1, "accepted", "a", "x"), (1, "accepted", "b", "no"), (1, "review", "c", "z")], "doc_id int, status string, source string, target string")
    r = contracts.gold_scores(want, got, spark.createDataFrame([("b", "no")], "source string, target string")).first()
    assert (r["accepted_correct"], r["review_correct"], r["missing"], r["violations"], r["auto_recall"], r["assisted_recall"]) == (1, 1, 1, 1, 0.333333, 0.666667)
    fields = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f")], "doc_id int, field_id string")
    said = lambda *x: spark.createDataFrame(list(x), "doc_id int, field_id string, source_path string")
    assert {tuple(r) for r in contracts.predictions(said((1, "f", "p")), said((2, "f", "q")), fields).collect()} == {(1, "f", "p", "accepted"), (2, "f", "q", "review"), (1, "g", None, "abstained")}


def test_drafts_and_descriptors(spark):
    labels = spark.createDataFrame([(1, "f", "a"), (2, "f", " a"), (2, "f", "a"), (3, "g", "a"), (1, "g", "b"), (2, "g", "b"), (1, "f", "b"), (2, "f", "b"), (9, "f", None), (9, "f", "c")], "doc_id int, field_id string, label string")
    assert {tuple(r) for r in contracts.template_draft(labels).collect()} == {("f", "a", 2)}  # b is a tie, c has too few
    rules_ = spark.createDataFrame([(1, "s", "t", 0, None), (2, "s", "u", 1, "x*"), (3, "q", "t", 2, "^a$"), (4, "q", "t", None, ".")], "rule_id int, source string, target string, evidence int, pattern string")
    risks = contracts.draft_risks(rules_, spark.createDataFrame([("t",)], "target string"), spark.createDataFrame([("q", "t")], "source string, target string"))
    assert sorted(tuple(r) for r in risks.collect()) == [(1, "missing_evidence"), (2, "overbroad_pattern"), (2, "unknown_target"), (3, "forbidden_pair"), (4, "forbidden_pair"), (4, "missing_evidence"), (4, "overbroad_pattern")]
    fields = spark.createDataFrame([("f", "enum", ["b", None, "a"], {"enum": "x|y", "min": "0"}), ("g", "text", None, None)], "field_id string, type string, aliases array<string>, constraints map<string,string>")
    got = contracts.target_descriptors(fields, spark.createDataFrame([("f", "a"), ("f", "c"), ("g", "z")], "field_id string, alias string")).orderBy("field_id").collect()
    assert [(r["aliases"], r["allowed"], r["constraints"]) for r in got] == [(["a", "b", "c"], ["x", "y"], "min=0"), (["z"], [], "")]
    named = spark.createDataFrame([(1, "b1", " v ", '{"field_name": "n"}'), (1, "b2", "v", '{"field_name": 3}'), (1, "b3", " ", '{"field_name": "n"}'), (1, "b4", "v", "no json"), (1, "b5", "v", None)], "doc_id int, block_id string, text string, attributes string")
    assert {tuple(r) for r in contracts.named_block_candidates(named).collect()} >= {(1, "$.blocks.b1.text", "n", "v")}


def test_lineage_report(spark):
    nodes = spark.createDataFrame([(1, "a", "field"), (1, "b", "chunk"), (1, "c", "artifact"), (1, "d", "field"), (2, "a", "field")], "graph int, node string, kind string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "b", "c"), (1, "d", "zzz"), (2, "b", "c")], "graph int, src string, dst string")
    totals = {(r["graph"], r["kind"]): tuple(r)[2:] for r in lineage.graph_totals(nodes, edges).collect()}
    assert totals == {(1, "field"): (2, 1, 0, 0), (1, "chunk"): (1, 1, 0, 0), (1, "artifact"): (1, 1, 0, 0), (2, "field"): (1, 0, 1, 0), (1, "edge"): (3, 2, 0, 1), (2, "edge"): (1, 0, 0, 1)}
    said = lineage.report(lineage.graph_totals(nodes, edges)).first()
    assert (said["graphs"], said["field_coverage"], said["chunk_coverage"], said["orphans"], said["broken_edges"], said["status"]) == (2, 0.333333, 1.0, 1, 2, "failed")
    assert lineage.report(lineage.graph_totals(nodes.limit(0), edges.limit(0))).first()["status"] == "passed"


def test_pages_are_freed_as_they_are_read(spark):
    """A read page leaves no cycle behind for the collector, and a task gives its pages a few at a time."""
    import gc

    from quire.operators import html

    page = "<html><title>t</title><body><nav><p>n</p></nav><article><h1>a</h1><p>b</p><ul><li>c</li></ul></article></body></html>"
    want = html.page_of(page)
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            assert html.page_of(page) == want
        assert gc.collect() == 0
    finally:
        gc.enable()
    rows = spark.createDataFrame([(k, "u", page if k % 3 else None) for k in range(150)], "page_id int, url string, html string").coalesce(1)
    found = html.pages_read(rows).collect()
    assert [r["page_id"] for r in found] == list(range(150)) and {r["status"] for r in found} == {"extracted", "rejected"}
