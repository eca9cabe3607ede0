"""Suffix arrays against sorting, removal of shared byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, substrings
from quire.llm.suffixes import common_prefixes, padded, suffix_array

SCHEMA = "doc_id bigint, text string"


def brute(rows, length):
    """(id, n_bytes, removed, spans, kept) by a dictionary of the first holder of every string."""
    raw = [(2**63 - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, x in raw:
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, i, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - length + 1):
            if first[x[s : s + length]] < key:
                gone[s : s + length] = True
        out.append((i, len(x), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), bytes(c for c, g in zip(x, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def by_operator(spark, rows, length=50, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = substrings.repeated_spans(docs, length, **more).collect()
    return sorted([(r["doc_id"], r["n_bytes"], sum(x["to"] - x["from"] for x in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in found], key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda x: bytes(b % 5 * 50 for b in x)), min_size=1, max_size=8), st.sampled_from([8, 11, 16, 21]), st.randoms())
def test_suffix_array(stretches, depth, rng):
    text, begins = padded(stretches, depth)
    places = np.array(sorted(rng.sample(range(len(text) - depth - 8), rng.randint(1, len(text) - depth - 8))))
    order = suffix_array(text, places, depth)
    raw = text.tobytes()
    seen = [raw[i : i + depth] for i in order.tolist()]
    assert sorted(order.tolist()) == places.tolist() and seen == sorted(seen)
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), depth)
    assert common_prefixes(text, order, depth).tolist() == [0, *(prefix(a, b) for a, b in zip(seen, seen[1:], strict=False))]
    assert begins.tolist() == [sum(len(x) + 1 for x in stretches[:k]) for k in range(len(stretches))]


def corpus(rng, n):
    words = ["ba", "lu", "ti", "ña", "é", " ", " ", "\n", "\0"]
    prose = lambda k: "".join(rng.choice(words) for _ in range(k))
    passages = [prose(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 80))]
        while rng.random() < 0.6:
            parts += [rng.choice(passages)[rng.randint(0, 30) :], prose(rng.randint(0, 30))]
        rows.append((rng.choice([i, i, rng.randint(0, n), None]) if rng.random() < 0.3 else i, "".join(parts)))
    rows += rng.sample(rows, 5) + [(n + 1, None), (n + 2, ""), (None, "x"), (n + 3, " " * 5000), (n + 4, "a" + " " * 9000 + "b"), (None, " " * 60), (-3, "ab" * 40), (n + 5, "ab" * 60)]
    return rows


@pytest.mark.parametrize("hot", [3, 4096])
def test_equal_to_brute_force(spark, hot):
    rows = corpus(random.Random(hot), 120)
    want = brute(rows, 50)
    assert by_operator(spark, rows, hot=hot, batch_bytes=4000, place_bytes=2000) == want
    assert sum(x[2] for x in want) > 1000
    assert by_operator(spark, rows, hot=hot, gram=50) == want


def test_short_strings_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 64)
    rows = corpus(random.Random(9), 40)
    assert by_operator(spark, rows, 12, gram=8, batch_bytes=3000) == brute(rows, 12)


def test_a_passage_of_very_many_documents(spark):
    rng = random.Random(4)
    passage = "the very same passage stands in every one of these documents, word for word and byte for byte"
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(600)]
    found = by_operator(spark, rows, hot=100, place_bytes=4000)
    assert found == brute(rows, 50) and sum(x[2] >= len(passage) for x in found) == 599


def test_query_and_columns_that_clash(spark, tmp_path):
    rows = [(1, "x" * 70, "a"), (2, "y" + "x" * 60, "b"), (3, None, "c"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {(1, 70, 0, 0, sha(b"x" * 70)), (2, 61, 60, 1, sha(b"y")), (3, 0, 0, 0, sha(b""))}
    out = substrings.substring_dedup(docs)
    assert out.columns == ["doc_id", "text", "spans", "bytes_removed"]
    assert {(r["doc_id"], r["text"], r["bytes_removed"]) for r in out.collect()} == {(1, "x" * 70, 0), (2, "y", 60), (3, None, 0), (3, "", 0)}
    assert substrings.repeated_spans(docs.limit(0)).count() == 0


def test_documents_are_scanned_together(monkeypatch):
    """Stretches of documents that lie one after the other are those of each alone, whatever their sizes; parcels go out many in a record batch."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(substrings, "LONGEST", 9)
    for sizes in ([], [0, 3], [19], [0, 400, 20, 19, 0, 21, 700, 5], [5, 60], [60, 60]):
        texts = [rng.integers(97, 99, n).astype(np.uint8) if k % 3 else np.full(n, 98, np.uint8) for k, n in enumerate(sizes)]
        doc, starts, ends, key = substrings.stretches(np.concatenate([np.empty(0, np.uint8), *texts]), np.array(sizes, np.int64), 20, 8)
        want = []
        for k, x in enumerate(texts):
            begin, run = sum(sizes[:k]), []
            own = [min(substrings._hashes(x[i : i + 20], 8).tolist()) for i in range(len(x) - 19)]
            for i, h in enumerate(own):
                if run and run[-1][3] == h and run[-1][2] - run[-1][1] < 9:
                    run[-1][2] += 1
                else:
                    run.append([k, begin + i, begin + i + 1, h])
            want += run
        assert [list(r) for r in zip(doc.tolist(), starts.tolist(), ends.tolist(), key.tolist(), strict=True)] == want
    out = list(substrings._together(((k, k, b"x" * 100) for k in range(600)), substrings._PARCEL))
    assert [b.num_rows for b in out] == [256, 256, 88] and out[2].column(0)[87].as_py() == 599


def test_members_of_chosen_groups():
    """Lows come from outside, so that gathering costs what is gathered and not all there is."""
    sizes = np.array([2, 1, 3])
    at, n = substrings._gathered(np.array([0, 2, 3]), sizes, np.array([2, 0, 2]))
    assert at.tolist() == [3, 4, 5, 0, 1, 3, 4, 5] and n.tolist() == [3, 2, 3]
    assert substrings._gathered(np.array([0, 2, 3]), sizes, np.empty(0, np.int64))[0].tolist() == []
