"""The corpus pipeline as a whole against plain loops, and texts that the single operators' tests leave out."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from quire.llm import mixing, queries, toxicity
from quire.llm.subwords import LONG_RUN, ids_of

SCHEMA = "doc_id long, text string, source string, n_chars long, score double, position string, rest string, label int, held_out boolean"


def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(45)
    texts = ["\n".join(prose(rng.randint(8, 30)) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    texts += [texts[0]] * 6 + [texts[1] + " more", " ".join([*texts[2].split(" ")[:-1], "other"])]
    texts += [f"{prose(12)}\n{passage}\n{prose(12)}" for _ in range(4)] + ["", None, "\n \t", "word"]
    rows = [(i, t, rng.choice(["s1", "s1", "s2", None]), len(t or ""), 0.1, "p", None, 1, None) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, prose(30), None, None, None, None, None, None, None)]


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def after_dedup(rows):
    """(id, text) that lines and near copies leave, by loops over all pairs."""
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    cut = []
    for k, (none, i, t) in enumerate(order):
        lines, gone = t.split("\n"), set()
        for low in range(len(lines)):
            for high in range(low + 1, len(lines) + 1):
                run = "\n".join(lines[low:high])
                if len(run.split()) >= 30 and any(f"\n{run}\n" in f"\n{x}\n" for _, _, x in order[:k]):
                    gone |= set(range(low, high))
        cut.append((none, i, "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    sets, parent = [shingles(t) for _, _, t in cut], list(range(len(cut)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(cut)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(None if cut[a][0] else cut[a][1]): cut[a][2] for a in range(len(cut)) if root(a) == a}


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("labels", [[], [(i, i % 2, i % 2) for i in range(12)], [(i, 1, 0) for i in range(40)]])
def test_run_keeps_all_where_labels_teach_nothing(spark, tmp_path, labels):
    rows = corpus(random.Random(5))
    pieces = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels)).collect()
    left = after_dedup(rows)
    docs = spark.createDataFrame([(i, t, next(r[2] for r in rows if r[0] == i)) for i, t in left.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, n in copies.items():
        own = [p for p in pieces if p["doc_id"] == i]
        size = len(plain.encode(left[i], add_special_tokens=False).ids) + 1
        assert sum(p["length"] for p in own) == n * size and {p["doc_tokens"] for p in own} <= {size}
    assert {p["doc_id"] for p in pieces} == {i for i, n in copies.items() if n} and len(left) > 40
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 2048


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    d = written(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(8)
    clean = ["the", "water", "road", "house", "walks", "slowly", "green", "paper", "reads", "quiet"]
    bad = ["idiot", "moron", "scum", "vermin", "loser"]
    texts = [" ".join(rng.choice(clean + (bad * 2 if i % 3 == 0 else [])) for _ in range(60)) for i in range(600)]
    rows = [(i, t, "s", len(t), None, None, None, None, None) for i, t in enumerate(texts)]
    d = written(spark, tmp_path, rows, [(i, 1, int(i % 3 == 0)) for i in range(600)])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert len([i for i in kept if i % 3 == 0]) <= 4 and len([i for i in kept if i % 3]) >= 396


def test_ranks_beyond_chance():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    assert toxicity.tells_apart(y + rng.normal(0, 1, 400), y)
    assert sum(toxicity.tells_apart(rng.random(400), y) for _ in range(50)) <= 1
    assert not toxicity.tells_apart(np.zeros(400), y) and not toxicity.tells_apart(rng.random(9), np.ones(9)) and not toxicity.tells_apart(np.empty(0), np.empty(0))


def test_mix_equals_its_sql_on_all_white_space(spark, tmp_path):
    texts = ["a\rb\x0bc\x0cd", "a b\tc\nd", " x y", "", None, "\r\r", "one"]
    rows = [(i, t, "s1" if i % 2 else None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    d = written(spark, tmp_path, rows, [])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken, copies, epochs FROM ({queries.SQL['op5_mixing']})").fetchall()
    got = queries.QUERIES["op5_mixing"](spark, d).select("doc_id", "size", "source_size", F.round("target", 6), "taken", "copies", "epochs").collect()
    assert sorted(map(tuple, got)) == sorted(want) and dict((r[0], r[1]) for r in got)[0] == 4


@pytest.mark.parametrize("n", [999, 1_000, 1_001, 19_000, 20_001])
def test_ids_of_long_white_space(n):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in (" ", "\n", "\t "):
        text = f"one{x * n}two{x * (n - 1)}three"
        assert ids_of(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert LONG_RUN == 1_000
