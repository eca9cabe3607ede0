"""The pipeline's near copies against all pairs."""

import itertools
import random

import corpus_pipeline
import pytest
from quire.llm import near_copies
from quire.llm.components import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    notice = prose(12)
    texts = []
    for _ in range(40):
        base = prose(r.randint(30, 300)) + notice
        texts.append(base)
        for _ in range(r.randint(0, 5)):
            edited = list(base)
            for k in r.sample(range(len(base)), max(1, len(base) * r.randint(1, 6) // 100)):
                edited[k] = r.choice(vocabulary)
            texts.append(edited)
    texts += [notice + prose(n) for n in (0, 1, 2, 3, 40)] + [prose(3), ["a"], [], []]
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(out)
    return [*out, (9000, None), (None, "no id"), (9001, out[0][1]), (9001, out[0][1])]


def kept_by_all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d))
    return {min(g)[1] for g in groups.values()}


def test_stage_keeps_one_of_each_group_of_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    want = kept_by_all_pairs(rows)
    assert len(want) < len(rows) - 40
    assert len(found) == len(set(found)) and set(found) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_order_of_shingles_changes_no_group(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda **k: sorted((str(r["doc_id"]), r["_text"], r["label"]) for r in near_copies.similar_groups(docs, **k).collect())
    assert label() == label(most_common=0)


def test_labels_after_few_rounds_stay_within_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    whole = {r["node"]: r["label"] for r in components(edges).collect()}
    early = {r["node"]: r["label"] for r in components(edges, 1).collect()}
    assert whole == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert early.keys() == whole.keys() and len(set(early.values())) > 2
    assert all(whole[v] == whole[k] for k, v in early.items())
