"""Operators against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.assertions import Assertion, outcome
from quire.operators import chunks, html, lineage, matching, states, tables
from quire.sources import blocks as b
from quire.streaming import events as stream


def kind_of(text, pos):
    import re

    if not text.strip(" "):
        return "empty"
    if " | " in text:
        return "table"
    if re.match(r"([-*]|[0-9]+[.)]) ", text):
        return "list"
    if re.match(r"[^:|]{2,40}: .+", text):
        return "key_value"
    return "heading" if (pos == 0 and len(text) <= 80) or len(text) <= 16 else "paragraph"


def level_of(text, pos):
    return 1 if pos == 0 else 2 if len(text) >= 10 else 3


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    line = lambda: r.choice(["", "Short", "Longer head", "a | b | c", "- item here", "Key: value", "1. first"] + [" ".join(r.choice(["lorem", "ipsum", "漢字仮名", "dolor"]) for _ in range(r.randint(4, 60)))] * 4)
    return ["\n".join(line() for _ in range(r.randint(1, 25))) for _ in range(60)] + ["", "漢字" * 300]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def tokens(s):
    cjk = sum("一" <= c <= "鿿" for c in s)
    return 0 if not s else max(1, int(cjk / 1.5 + (len(s) - cjk) / 4))


def test_tokens_and_names(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("漢字漢字abcd",), ("  A_b-C  ",), ("::",)], "s string")
    got = [(r["s"], r["n"], r["k"], r["f"]) for r in rows.select("s", t.estimate_tokens(F.col("s")).alias("n"), t.normalize_name(F.col("s")).alias("k"), t.sanitize(F.col("s")).alias("f")).collect()]
    assert [g[1] for g in got] == [tokens(g[0]) for g in got]
    assert got[3][2:] == ("abc", "A_b-C".replace("-", "_")) and got[4][3] == "source"


def test_title_paths_equal_a_stack(documents, texts):
    want = set()
    for d, text in enumerate(texts):
        path = []
        for pos, line in enumerate(text.split("\n")):
            if kind_of(line, pos) == "heading":
                path = [*path[: level_of(line, pos) - 1], line]
                want.add((d, pos, " > ".join(path)))
    assert {tuple(r) for r in b.title_paths(documents).collect()} == want


@pytest.mark.parametrize("with_headings", [True, False])
def test_greedy_packing_equals_a_loop(documents, texts, with_headings):
    want = set()
    for d, text in enumerate(texts):
        packed, now = [], []
        for pos, line in enumerate(text.split("\n")):
            kind = kind_of(line, pos)
            if kind == "empty":
                continue
            alone = kind in ("table", "list")
            if now and (alone or kind == "heading" or tokens("\n\n".join([*(x for _, x in now), line])) > 64):
                packed, now = [*packed, now], []
            if kind == "heading" and not with_headings:
                continue
            now.append((pos, line))
            if alone:
                packed, now = [*packed, now], []
        packed += [now] * bool(now)
        want |= {(d, k, p[0][0], len(p), tokens("\n\n".join(x for _, x in p))) for k, p in enumerate(packed)}
    got = {(r["doc_id"], r["chunk_index"], r["first_pos"], r["n_blocks"], r["token_count"]) for r in chunks.greedy(documents, 64, with_headings).collect()}
    assert got == want


def test_assignment_is_the_best():
    r = np.random.default_rng(0)
    for rows, columns in ((1, 1), (2, 3), (3, 2), (4, 4), (3, 5)):
        for _ in range(20):
            s = np.where(r.random((rows, columns)) < 0.3, -1e5, r.random((rows, columns)))
            got = matching.best_assignment(s)
            used = [j for j in got if j >= 0]
            assert len(used) == len(set(used))
            value = sum(s[i, j] for i, j in enumerate(got) if j >= 0)
            best = max(sum(s[i, j] for i, j in enumerate(p) if j < columns) for p in itertools.permutations(range(columns + rows), rows))
            assert abs(value - best) < 1e-9


def test_similarity_and_pooling(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd", "bcde"), ("", ""), ("customername", "clientname")]
    got = spark.createDataFrame(pairs, "a string, b string").select(matching.similarity("a", "b").alias("s")).collect()
    assert [r["s"] for r in got] == [SequenceMatcher(None, *p).ratio() for p in pairs]
    assert matching.pooled([(1, 4), (3, 4), (1, 4), (4, 4)]) == [0.25, 0.5, 0.5, 1.0]


def test_html_blocks():
    page = "<html><head><title>T</title><script>x</script></head><body><nav><p>menu</p></nav><h2>Head</h2><p>One<br>two &amp; three<p>Head</p><ul><li>item <b>x</b><li>other<ul><li>in</ul></ul><table><tr><th>k<td>v<td>w</tr><tr><td>alone</table></body>"
    got = html.page_of(page)
    assert got["blocks"] == [
        ("heading", 2, "Head", {"html_tag": "h2"}), ("paragraph", None, "One two & three", {"html_tag": "p"}), ("list", None, None, {"items": ["item x", "other in"], "ordered": False}),
        ("table", None, None, {"rows": [{"field": "k", "value": "v | w"}, {"field": "alone", "value": ""}]}),
    ]
    assert (got["title"], got["status"]) == ("Head", "extracted")
    assert html.page_of("") == {"title": "", "status": "rejected", "metadata": {}, "blocks": []}


def test_html_content_rules():
    root = html.page_of("<title> A  b </title><body><p>out</p><div id='zoom'><p>发布日期： 2024-1-2</p><p>文号：x</p><p>other: y</p></div>")
    assert root["metadata"] == {"发布日期": "2024-1-2", "文号": "x"} and [b[2] for b in root["blocks"]][0] == "发布日期： 2024-1-2" and root["title"] == "A b"
    first = html.page_of("<body><div class='x content'><h1>c</h1></div><main><h1>m</h1><p>a</p><p>b</p></main>")
    assert [b[2] for b in first["blocks"]] == ["m", "a", "b"]  # main stands before .content
    layout = html.page_of("<body><table><tr><td><h1>t</h1><p>a</p><p>b</p></td></tr></table><table role=presentation><tr><td><p>c</p></td></tr></table>")
    assert [(b[0], b[2]) for b in layout["blocks"]] == [("heading", "t"), ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]
    few = html.page_of("<title>T</title><body><h1>h</h1><div>loose text<span>【打印】</span>h</div>x</body>")
    assert [(b[0], b[2]) for b in few["blocks"]] == [("heading", "h"), ("paragraph", "loose text")]
    assert html.page_of("<body><p>a</p><p>b</p><p>c</p>")["status"] == "rejected"  # no title
    assert html.page_of("<title>T</title><body><nav>only</nav></body>")["blocks"] == []


def test_assertions(spark):
    rows = spark.createDataFrame([('{"a": {"b": [1, 2]}, "s": "x", "n": null}',), ("not json",), (None,)], "j string")
    check = lambda *a, **k: [r[0] for r in rows.select(outcome(F.col("j"), Assertion("t", *a, **k))).collect()]
    assert check("$.a.b[1]", "number_range", (2, 2)) == ["passed", "missing", "missing"]
    assert check("$.s", "regex_match", "^y$")[0] == "failed"
    assert check("$.n", "non_empty")[0] == "failed"
    assert check("$.z", "exists", optional=True) == ["skipped"] * 3


def test_tables(spark):
    df = spark.createDataFrame([(1, " a ", "2024-1-5"), (2, None, "x")], "k int, v string, d string")
    made = tables.transformed(df, [{"operation": "trim", "source": "v", "target": "v"}, {"operation": "default", "source": "v", "target": "v", "value": "none"}, {"operation": "normalize_date", "source": "d", "target": "d"}])
    assert [tuple(r) for r in made.orderBy("k").collect()] == [(1, "a", "2024-01-05"), (2, "none", None)]
    with pytest.raises(ValueError):
        tables.transformed(df, [{"operation": "nope", "source": "v", "target": "v"}])
    assert {(r["k"], r["issue"]) for r in tables.issues(df, {"v": {"required": True, "pattern": "b"}}).collect()} == {(1, "pattern:v"), (2, "required:v")}
    secret = spark.createDataFrame([('{"Token": "a\\"b", "x": {"password": 12, "ok": 1}}',)], "j string").select(tables.redacted(F.col("j"), ("token", "password"))).first()[0]
    assert secret == '{"Token": "[REDACTED]", "x": {"password": "[REDACTED]", "ok": 1}}'


def test_lineage_and_states(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in lineage.reach(e, spark.createDataFrame([("r", "a")], "root string, node string"), 8).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, at int")
    assert {tuple(r) for r in states.latest(rows, "k", F.col("at")).select("k", "v").collect()} == {(1, "y"), (2, "z")}
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string")
    c = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "k int, h string")
    assert {tuple(r) for r in states.drift(a, c, "k", "h").collect()} == {(1, "missing"), (2, "same"), (3, "changed"), (4, "unexpected")}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    query = stream.windowed(stream.read_stream(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(stream.windowed(events))


def test_adapters_on_broken_and_uneven_payloads(spark):
    from quire.operators.trees import section_blocks
    from quire.plans.extraction import block_list

    lists = [(1, '{"blocks": [{"type": "Header", "title": "T"}, {"id": "x", "type": "grid", "text": "a"}], "items": []}'), (2, "no json"), (3, None), (4, '{"items": [{}]}'), (5, "{}")]
    got = [tuple(r) for r in block_list(spark.createDataFrame(lists, "id int, payload string")).orderBy("id", "place").collect()]
    assert got == [(1, "b001", "heading", "T", 0), (1, "x", "table", "a", 1), (4, "b001", "paragraph", "", 0)]
    trees = [(1, '{"sections": [{"heading": "A", "children": [{"heading": "B", "paragraphs": ["p"], "children": [{"heading": "C"}]}]}, {"heading": "D"}]}'), (2, None), (3, '{"sections": []}')]
    got = [(r["id"], r["external_path"], r["level"], r["text"]) for r in section_blocks(spark.createDataFrame(trees, "id int, payload string"), "$.sections", "s").orderBy("id", "pos").collect()]
    assert got == [(1, "s[0]", 1, "A"), (1, "s[0].children[0]", 2, "B"), (1, "s[0].children[0].paragraphs[0]", None, "p"), (1, "s[0].children[0].children[0]", 3, "C"), (1, "s[1]", 1, "D")]


def test_fixed_windows_are_greedy_and_whole():
    import random

    from quire.operators.chunks import _windows

    r = random.Random(4)
    size = lambda x: sum(1 / 1.5 if "\u4e00" <= c <= "\u9fff" else 0.25 for c in x)
    for _ in range(200):
        text = "".join(r.choice("ab 中文。.!?\n") for _ in range(r.randint(0, 200)))
        found = _windows(text, 8)
        assert "".join(found) == text and all(0 < size(x) <= 8 for x in found)
        for x, y in zip(found, found[1:], strict=False):  # the next sentence, or its part that fills a window, did not fit
            first = _windows(y, 8)[0]
            head = next((y[: i + 1] for i, c in enumerate(y) if c in "。.!?\n" and (i + 1 == len(y) or y[i + 1] not in "。.!?\n")), first)
            assert size(x) + size(head) > 8


def test_assignment_without_clashes_equals_brute_force(spark):
    import itertools
    import random

    from quire.operators import matching

    r = random.Random(2)
    rows = [(d, f"t{t}", f"s{s}", r.choice([0.3, 0.5, 0.6, 0.75, 0.9]), t == 0) for d in range(60) for t in range(3) for s in range(4)]
    pairs = spark.createDataFrame(rows, "doc_id long, target_id string, source_path string, score double, required boolean")
    total = {}
    seen = set()
    for x in matching.assigned(pairs).collect():
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["score"]
        for key in ((x["doc_id"], x["target_id"]), (x["doc_id"], x["source_path"])):
            assert key not in seen
            seen.add(key)
    score = {x[:3]: x[3] if x[3] >= 0.45 else 0.0 for x in rows}
    for d in range(60):
        best = max(sum(score[d, f"t{t}", f"s{s}"] for t, s in enumerate(p)) for p in itertools.permutations(range(4), 3))
        assert abs(total[d] - best) < 1e-9


def test_equal_forms_are_solved_once():
    from quire.operators import matching

    form = tuple((f"t{t}", f"s{s}", 0.5 + 0.1 * ((t + s) % 3), False) for t in range(3) for s in range(3))
    matching._solved.cache_clear()
    assert matching._solved(form, 0.45) == matching._solved(tuple(form), 0.45) and matching._solved.cache_info().hits == 1
