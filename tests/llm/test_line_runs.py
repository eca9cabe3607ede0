"""Line deduplication against a list of every common run."""

import random

from quire.llm import line_dedup


def lines_in_common_runs(a, b, words, least):
    """Places of b's lines that lie in any run of lines found unbroken in a with `least` words or more."""
    gone = set()
    for low in range(len(b)):
        for high in range(low + 1, len(b) + 1):
            if sum(words[low:high]) >= least and any(list(a[i : i + high - low]) == list(b[low:high]) for i in range(len(a))):
                gone |= set(range(low, high))
    return gone


def shared(a, b, words, least=30):
    size = dict(zip(b, words, strict=True))
    return line_dedup.shared_blocks(line_dedup.Anchors(a, [size.get(x, 5) for x in a], least), b, words)


def test_a_long_passage_beyond_short_shared_lines_is_found():
    assert shared([1, 2, 3], [0, 2, 3, 1], [9, 10, 10, 50]) == [(3, 4)]
    assert shared([1, 2, 8, 2, 3], [1, 2, 3], [20, 20, 20]) == [(0, 3)]
    assert shared([1, 2, 3], [0, 2, 3, 1], [9, 20, 20, 50]) == [(1, 4)]  # the moved line too
    assert shared([1, 2, 9, 3, 4], [6, 3, 4, 7, 1, 2, 8], [20] * 7) == [(1, 3), (4, 6)]
    assert shared([5, 1, 2, 9], [6, 1, 2, 7, 1, 2, 8], [20] * 7) == [(1, 3), (4, 6)]


def test_blocks_are_all_common_runs():
    r = random.Random(7)
    for _ in range(3000):
        kinds = r.randint(2, 8)
        size = [r.randint(0, 25) for _ in range(kinds)]
        a, b = ([r.randrange(kinds) for _ in range(r.randint(0, 9))] for _ in range(2))
        words = [size[x] for x in b]
        found = line_dedup.shared_blocks(line_dedup.Anchors(a, [size[x] for x in a], 30), b, words)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        assert {j for low, high in found for j in range(low, high)} == lines_in_common_runs(a, b, words, 30)


def test_patience_does_the_work(monkeypatch):
    a, b, words = [1, 2, 3, 9], [7, 1, 2, 3, 8], [20] * 5
    assert shared(a, b, words) == [(1, 4)]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert shared(a, b, words) == []


def test_whole_operator_equals_all_pairs(spark):
    r = random.Random(9)
    kinds = [" ".join(f"k{i}x{w}" for w in range(r.choice([0, 1, 2, 3, 12, 25, 31]))) for i in range(14)]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randint(1, 12))) for _ in range(50)]
    u, v = " ".join(f"u{w}" for w in range(25)), " ".join(f"v{w}" for w in range(25))
    verse = "\n".join(f"short line {w}" for w in range(12))
    tail = " ".join(f"t{w}" for w in range(31))
    # each line stood alone before its neighbours met; short lines only; a line beside a block that stood alone before
    texts += [f"{u}\nfirst own", f"{v}\nsecond own", f"third own\n{u}\n{v}", f"{u}\n{v}\nfourth own", f"{verse}\nfifth own", f"sixth own\n{verse}"]
    texts += [tail, f"{tail}\nfive short words stand here", f"own\n{tail}\nfive short words stand here"]
    found = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for k, t in enumerate(texts):
        b = t.split("\n")
        words = [len(x.split()) for x in b]
        gone = set().union(*(lines_in_common_runs(x.split("\n"), b, words, 30) for x in texts[:k]))
        assert found[k] == "\n".join(x for j, x in enumerate(b) if j not in gone)
    assert found[53] == "fourth own" and found[55] == "sixth own" and found[58] == "own"
