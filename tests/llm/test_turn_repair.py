"""Conversation repair against trying all edits of short conversations, and pieces of any size against whole ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def tried(rows):
    """Least (cost, audit, repaired) of all edits of rows [(turn, role, text)], two inserts in a gap at most."""
    marks, best = faults(rows), None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    name = {"u": "user", "a": "assistant"}
    choices = [[("D", 2, None)] if f in ("blank", "duplicate") else [("D", 2, None), *((e, c + 5 * (f == "truncated"), (r, t)) for e, c, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")))] for f, (_, role, t) in zip(marks, rows, strict=True)]
    for picked in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, out = [], 0, []
            for k, ins in enumerate(inserts):
                for r in ins:
                    audit.append("I")
                    cost += 5
                    out.append((name[r], ""))
                if k < len(rows):
                    e, c, kept = picked[k]
                    audit.append(e)
                    cost += c
                    out += [kept] if kept else []
            if (best is None or (cost, "".join(audit)) < best[:2]) and all(r for r, _ in out) and re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                best = (cost, "".join(audit), "\n".join(f"{r}:{t}" for r, t in out))
    return best


def expected(rows):
    """The row of one conversation, by trying everything."""
    marks, numbers = faults(rows), [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, text = tried(rows)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made(rng, n, most):
    texts = ["Yes.", "No", "Well?", " ", "", "So it is!", "a. b", "Yes. \n", "ß."]
    return [[(rng.choice([None, k, k, k, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "usher"]), rng.choice(texts)) for k in range(rng.randint(1, most))] for _ in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))


@pytest.mark.parametrize("piece_rows", [1, 2, 4096])
def test_equal_to_trying_all_edits(spark, piece_rows):
    all_rows = made(random.Random(7), 60, 3)
    docs = spark.createDataFrame([(i, *r) for i, rows in enumerate(all_rows) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(docs, piece_rows).collect()}
    assert got == {i: expected(ordered(rows)) for i, rows in enumerate(all_rows)}


def test_pieces_equal_whole_conversations(spark):
    rows = [(i, *r) for i, conv in enumerate(made(random.Random(3), 4, 300)) for r in conv]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, turn_repair.repair(docs).collect()))
    assert whole == sorted(map(tuple, turn_repair.repair(docs.repartition(3), 7).collect())) == sorted(map(tuple, turn_repair.repair(docs, 4096, 50).collect()))
    assert len(whole) == 4 and max(x[6] for x in whole) > 100


def test_costs_of_a_piece_are_a_matrix():
    rng = random.Random(5)
    for _ in range(200):
        turns = [(rng.choice("suax"), rng.randint(0, 3)) for _ in range(rng.randint(0, 7))]
        k = rng.randint(0, len(turns))
        m, behind = turn_repair.matrix(turns[:k]), turn_repair.costs(turns[k:], turn_repair.AT_END)[0]
        assert tuple(min(m[4 * q + e] + behind[e] for e in range(4)) for q in range(4)) == tuple(turn_repair.costs(turns, turn_repair.AT_END)[0])


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None]), rng.choice(["Hi. You!", "Once", None, "Why? ok"]), "x") for _ in range(90)]
    rows = [r for k, r in enumerate(rows) if sum(x[0] == r[0] for x in rows[:k]) < 3]
    rows.append((next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone.", "x"))
    spark.createDataFrame(rows, SCHEMA + ", audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    after = {r[0]: [] for r in rows}
    for conv, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        after[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    zeros = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_turn_repair"](spark, str(tmp_path)).collect()}
    assert got == {conv: expected(ordered(x)) if x and len(x) < 4 else zeros if not x else got[conv] for conv, x in after.items()}
    assert zeros in got.values()


def test_empty_table(spark):
    assert turn_repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0
