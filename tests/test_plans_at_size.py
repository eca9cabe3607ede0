"""Plans and intermediate tables that must follow the input, and not what Spark takes them for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import substring_grams
from quire.operators import blocktools, leakage, summaries
from quire.plans.registry import QUERIES
from quire.sources import notices

DATA = "/root/testdata/sf0.1"


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_notices_are_estimated_with_all_their_blocks(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    used = orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    rows = notices.notices(orders)
    assert estimate(rows) >= notices.BLOCKS * estimate(used)
    assert rows.count() == notices.BLOCKS * orders.count()


@pytest.mark.parametrize("name", ["t04_paths", "t06_canonical", "x18_measures", "c07_chunk_faults"])
def test_no_derived_rows_are_broadcast(spark, name):
    """Only tables as given and the twenty places of blocks may reach every task through the driver, or what AQE measures first."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("\n")
    level = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            inside = next((j for j in range(k + 1, len(plan)) if level(plan[j]) <= level(line)), len(plan))
            below = "\n".join(plan[k + 1 : inside])
            assert "Exchange hash" in below or not re.search(r"quire-|variant|CASE WHEN", below), below


def test_leakage_writes_only_grams_that_may_meet(spark, monkeypatch):
    """Either way round, the larger side's grams are written where the smaller side's filter lets them through, and the pairs are those of all against all."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    many = [text(600) for _ in range(300)]
    few = [many[7][100:140], many[9], text(50), many[3] + "zz", "x"]
    sizes, was = [], leakage.written

    def counted(df):
        out = was(df)
        if "key" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(leakage, "written", counted)
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "id int, text string")
    for values, texts in ((few, many), (many, few)):
        sizes.clear()
        want = {(i, j, "equal" if v == t else "value_in_text" if v in t else "text_in_value") for i, v in enumerate(values) for j, t in enumerate(texts) if v in t or t in v}
        assert {tuple(r) for r in leakage.leaks(rows(values), rows(texts)).collect()} == want and len(want) >= 3
        assert sum(sizes) < 5000, sizes  # 300 texts have some 200,000 grams


def test_rules_are_guarded_by_their_words(spark):
    """Words in a bracketed label count too, so a block that no rule can match meets one test; rules without words join that test by their patterns."""
    from quire.operators import rulebooks, rules

    label = next(r for r in rules.POLICY if r.kind == "policy_publish_date_label")
    assert rules._words(label) == ["发布日期", "公布日期", "发布时间", "公开日期"]
    assert all(rules._words(r) for r in rules.POLICY)
    blocks = spark.createDataFrame([(1, 0, "[发布日期]：2020年1月2日"), (1, 1, "一、审查工作安排"), (1, 2, "无关。"), (2, 0, None)], "doc_id int, pos int, text string")
    assert {(r["pos"], r["kind"]) for r in rules.facts(blocks, (label,)).collect()} == {(0, "policy_publish_date_label")}
    assert {(r["pos"], r["kind"]) for r in rules.facts(blocks, rulebooks.MEETING).collect()} == {(1, "numbered_agenda_heading")}


def test_windows_over_notices_move_no_texts(spark):
    """Orders are dealt out before their blocks are made: a window over a document's blocks needs no further exchange."""
    plan = QUERIES["x11_meeting_dates"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def test_whole_notices_hold_the_same_blocks(spark):
    orders = spark.read.parquet(f"{DATA.replace('0.1', '0.001')}/orders.parquet")
    whole = notices.whole_notices(orders).selectExpr("doc_id", "inline(blocks)")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, notices.notices(orders).collect()))


@pytest.mark.parametrize("name", ["f15_retrieval_tokens", "e05_faithfulness", "f53_source_links", "c15_entity_tags"])
def test_notices_meet_without_shuffling_or_sorting_texts(spark, name):
    """Only orders move; before, blocks were collected, or joined to blocks, which sorts or shuffles all texts."""
    df = QUERIES[name](spark, DATA)
    assert exchanges(df) == 1 and "collect_list" not in df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_runs_of_characters(spark):
    text = "a\U0001f600b\nc"
    rows = spark.createDataFrame([(text,), ("ab",), ("a",), (None,)], "x string").select(substring_grams(F.col("x"), 2, 3)).collect()
    runs = lambda x: [x[i : i + n] for n in (2, 3) for i in range(len(x) - n + 1)]
    assert [r[0] for r in rows] == [runs(text), ["ab"], [], []]


def test_whole_documents_have_the_links_and_tags_of_joins(spark):
    chunks = [("c0", "甲 乙", ["b1", "b9"]), ("c1", "乙", ["b2"]), ("c2", None, ["b3"])]
    found = [("甲", "party", 0.8, ["b1"]), ("甲", "party", 0.7, []), ("乙", "person", 0.7, []), ("", "party", 0.7, []), ("丙", "party", 0.8, ["b2", "b1"])]
    some = [(0, "b1", " x  y "), (1, "b2", None), (2, "b3", "z")]
    made = spark.createDataFrame([(1, *c) for c in chunks], "doc_id int, chunk_id string, text string, source_block_ids array<string>")
    entities = spark.createDataFrame([(1, *e) for e in found], "doc_id int, text string, entity_type string, confidence double, source_block_ids array<string>")
    blocks = spark.createDataFrame([(1, *b) for b in some], "doc_id int, pos int, block_id string, text string")
    docs = spark.createDataFrame([(1, chunks, found, some)], "doc_id int, chunks array<struct<chunk_id:string,text:string,source_block_ids:array<string>>>, entities array<struct<text:string,entity_type:string,confidence:double,source_block_ids:array<string>>>, blocks array<struct<pos:int,block_id:string,text:string>>")
    key = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert key(blocktools.whole_entity_tags(docs).collect()) == key(blocktools.entity_tags(made, entities).collect())
    assert key(blocktools.whole_source_links(docs).collect()) == key(blocktools.source_links(made, blocks).collect())


def test_small_files_of_many_rows_are_dealt_out(spark):
    """One file of parts is one task whatever its rows; summaries dealt over tasks are those of the column."""
    assert exchanges(QUERIES["f18_summaries"](spark, DATA)) == 1
    rows = spark.createDataFrame([(1, "1. a: b\n2. c: d"), (2, "x:\ny:\nz:\na: b\nc: d"), (3, "One. Two and more."), (4, None), (5, "")], "id int, t string")
    assert sorted(map(tuple, summaries.chunk_summaries(rows, F.col("t")).collect())) == sorted(map(tuple, rows.select("id", summaries.chunk_summary(F.col("t"))).collect()))


def test_texts_of_notices_are_made_outside_whole_stage_code(spark):
    """All texts in one generated method are too long for the JVM to compile, and are then interpreted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are compiled only as they run
    try:
        plan = notices.notices(spark.read.parquet(f"{DATA}/orders.parquet"))._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in plan if "事项的通知" in line]
    assert made and not [line for line in made if "*(" in line]


def test_table_numbers_move_each_line_once(spark):
    """Lines are grouped by order once, beside the join that gives them their part's name; no window and no other join."""
    plan = QUERIES["f57_table_numbers"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Exchange") <= 4


def test_table_numbers_of_odd_labels(spark):
    """The longest of labels that begin together counts, labels may hold what patterns mean, and null ones stand nowhere."""
    cells = spark.createDataFrame([(1, "甲", "a", "1元"), (1, "甲局", "a", "2元"), (2, "(x\\E.", "a", "3个"), (2, None, "b", "4"), (2, "", None, "5"), (None, "甲", "a", "6")], "doc_id int, row string, col string, cell string")
    said = spark.createDataFrame([(1, "甲局a2元，甲a2元"), (2, "(x\\E.a3个b3 个4"), (None, "甲a7"), (3, "甲a8")], "doc_id int, summary string")
    got = {r["doc_id"]: r["violations"] for r in summaries.table_numbers(cells, said).collect()}
    assert got == {1: ["甲/a:2元"], 2: ["(x\\E.:4"]}


@pytest.mark.parametrize("name", ["x14_guide_sections", "x18_measures", "x10_numbered_sections", "w04_lookahead_bodies"])
def test_sections_are_found_in_whole_notices(spark, name):
    """Only orders move; before, all blocks were sorted and stood in windows."""
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and "Window" not in plan and "Join" not in plan


def test_sections_by_rows_of_blocks_are_those_of_whole_documents(spark):
    """Rows in any order, blank and null texts, names in brackets and with white space around them, headings right below each other, no block at all."""
    from quire.operators import rulebooks, runs

    texts = ["　一、申请(附)条件\t", " ", None, "甲 ", "第二章 申请条件 第3条 x", "乙", "二、联系方式", "三、联系方式（新）", "丙", "丁", *"123456789", "申报要求", "四、无名", "庚", "申报方式"]
    rows = [(d, p, "Heading" if t and "、" in t else "paragraph", t) for d in (1, 2) for p, t in enumerate(texts[::d])] + [(None, 0, None, "申报方式"), (None, 1, None, "辛")]
    random.Random(1).shuffle(rows)
    blocks = spark.createDataFrame(rows, "doc_id int, pos int, type string, text string")
    whole = runs.whole_documents(blocks).unionByName(spark.sql("SELECT 9 AS doc_id, array() AS blocks UNION ALL SELECT 10, null"))
    key = lambda df: sorted(map(str, df.collect()))
    for found in (rulebooks.guide_sections, runs.measures, runs.numbered_sections):
        assert key(found(blocks)) == key(found(whole))
    got = {(r["head_pos"], r["name"], r["body"]) for r in rulebooks.guide_sections(blocks).where("doc_id = 1").collect()}
    assert got == {(0, "申请条件", "甲"), (4, "申请条件", "乙"), (7, "联系方式", "丙")}
    assert [(r["head_pos"], r["body"]) for r in rulebooks.guide_sections(blocks).where("doc_id IS NULL").collect()] == [(0, "辛")]


def test_chunk_faults_move_only_orders(spark):
    """c07 finds all faults in whole notices; before, blocks, chunks and their sources were written and joined again for each kind of fault."""
    df = QUERIES["c07_chunk_faults"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and "Join" not in plan and "quire-" not in plan


def test_chunk_faults_of_whole_documents_are_those_of_joins(spark):
    """Random chunks: cut, widened and empty texts, unknown, repeated, null and no sources, entities and parents, exclusions of all kinds, documents without chunks."""
    from quire.operators import cover

    rng = random.Random(4)
    some = lambda choices, n: [rng.choice(choices) for _ in range(rng.randint(0, n))]
    docs = []
    for d in range(150):
        blocks = [(f"b{k}", rng.choice(["table", "list", "paragraph"]), rng.choice([None, "", " ", "a  b", "a b", "ab　c", "b", "\tab ab"])) for k in range(rng.randint(0, 5))]
        chunks = []
        for k in range(rng.randint(0, 4)):
            own = rng.sample([b[0] for b in blocks], rng.randint(0, len(blocks))) + some(["bx", None], 1)
            text = "\n\n".join(b[2] or "" for i in own for b in blocks if b[0] == i)
            chunks.append((f"c{k}", rng.choice([text] * 3 + [text[1:], text[:-2], text + " z", " ", None]), own, some(["e", "f", None], 2), rng.choice([None, "c0", "c9"])))
        docs.append((d, blocks, chunks, some(["e", "f"], 1), list({x[0]: x for x in [(rng.choice(["b0", "b1", "b2", "b9"]), rng.choice(["known", "other", None])) for _ in range(rng.randint(0, 2))]}.values())))
    kinds = {"blocks": "block_id:string,type:string,text:string", "chunks": "chunk_id:string,text:string,source_block_ids:array<string>,entity_ids:array<string>,parent_id:string", "exclusions": "block_id:string,rule:string"}
    whole = spark.createDataFrame(docs, f"doc_id int, blocks array<struct<{kinds['blocks']}>>, chunks array<struct<{kinds['chunks']}>>, entities array<string>, exclusions array<struct<{kinds['exclusions']}>>")
    b, c, out = (whole.selectExpr("doc_id", f"inline({x})") for x in ("blocks", "chunks", "exclusions"))
    ents = whole.selectExpr("doc_id", "explode(entities) AS entity_id")
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    got = key(cover.whole_chunk_faults(whole, rules=("known",)))
    assert got == key(cover.chunk_faults(c, b, ents, exclusions=out, rules=("known",))) and len({r[1] for r in got}) == 13


@pytest.mark.parametrize("name", ["t06_canonical", "t04_paths"])
def test_canonical_objects_move_only_orders(spark, name):
    """Paths are read in the row of their order; before, the nodes of all its metadata were written level by level and joined to its paths, and its blocks to these."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "quire-" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_canonical_objects_of_odd_documents(spark):
    """Objects stand where their first field with a value does; equal ranks take the least value; null paths, texts, payloads and no wanted path at all."""
    from quire.operators import canonical_build

    wanted = "array<struct<field:string,rank:int,path:string>>"
    one = [("z.y", 0, "metadata.a"), ("m", 1, "metadata.b"), ("m", 1, "metadata.a"), ("m", 2, "blocks.b1.text"), ("q", 0, "blocks.b2.text"), ("k.\"l", 0, "metadata.b.0"), ("z.x", None, None), ("none", 0, "metadata.c-d.e_f")]
    docs = spark.createDataFrame([(1, '{"a": 1.50, "b": "1\\n", "c-d": {"e_f": null}}', [("b1", "t"), ("b2", None)], one), (2, None, [], one[:4]), (3, "{}", [], []), (4, "[1", [("b1", '"')], one[2:4])], f"id int, payload string, blocks array<struct<block_id:string,text:string>>, wanted {wanted}")
    got = {r["id"]: (r["json"], r["conflicts"], r["errors"]) for r in canonical_build.whole_canonical(docs, ("z.x", "m", 'k."l', "z.y", "q", "none")).collect()}
    missing = "metadata.a:source_missing|metadata.b:source_missing"
    assert got == {
        1: ('{"m":"1\\n","z":{"y":1.5},"q":null,"none":null}', "m", "metadata.b.0:source_missing"),
        2: ("{}", "", f"blocks.b1.text:source_missing|{missing}"), 3: ("{}", "", ""), 4: ('{"m":"\\""}', "", "metadata.a:source_missing"),
    }


def test_rules_match_no_text_without_their_words(spark, monkeypatch):
    """Each text that a pattern matches holds one word of each of its sets, and facts are those of the patterns alone; few words are looked for in every block."""
    from quire.operators import rulebooks, rules
    from quire.plans import policy

    assert rules._clauses(r"^a(?:bc|d[0-9]e|f?)\x{4e00}?x{2}(g|hi)+[:：]\.j*k|l") == [("a", "l")] and rules._clauses("(?:a|b?)[0-9a-z]") == []
    assert rules._clauses(r"^a(?:bc|d[0-9]e|(?:z)?fg)\x{4e00}x{2}(g|hi)+[:：][^q]\.j*k(?=m)") == [("a",), ("bc", "d", "fg"), ("\u4e00x",), ("g", "hi"), (":", "："), (".",), ("k",)]
    books = [policy._RULES, policy._MEETING_RULES, policy._GUIDE_RULES]
    assert max(sum(map(len, rules._keys(b)[0])) for b in books) <= 30 and all(all(rules._keys(b)[1]) for b in books)
    texts = [r["text"] for r in notices.notices(spark.read.parquet(f"{DATA.replace('0.1', '0.001')}/orders.parquet")).select("text").distinct().collect()]
    rng = random.Random(9)
    texts = texts + ["".join(rng.choice([t, t[: len(t) // 2], t[len(t) // 2 :], rng.choice("：:。 \n")]) for t in rng.sample(texts, 3)) for _ in range(3000)] + ["", None, " \x85", "　第一条 制定本法\xa0"]
    blocks = spark.createDataFrame([(k // 20, k % 20, t) for k, t in enumerate(texts)], "doc_id int, pos int, text string")
    key = lambda df: sorted(map(str, df.collect()))
    found = [key(rules.facts(blocks, b)) for b in books]
    monkeypatch.setattr(rules, "_clauses", lambda pattern: [])
    assert found == [key(rules.facts(blocks, b)) for b in books] and min(map(len, found)) > 500
