"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and long texts."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, boosting, byte_cnn, chat, line_dedup, lm, mixing, packing, quality_rules, simhash, toxicity
from quire.llm.attention import DOCUMENT, STEPS, VOCABULARY, ZERO, Attention, Counts, Shape, windows
from quire.llm.components import components
from quire.llm.subwords import ids_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = ["\n".join(prose(r.randint(5, 40)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    passage = prose(60)
    base += [base[0]] * 30 + [base[1].replace("a", "b", 1), base[2] + " x"] + [passage + "\n" + prose(30) for _ in range(8)]
    base += ["", None, "\n \t\n", "word <|endoftext|> x", "a" + "\u00a0" * 30_000 + " b", "word", "İ ı ß É", prose(20000), "a " * 500]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Rows with nulls, repeated rows and columns whose names clash with those that operators add."""
    rows = [(i, t, "en", ["s1", "s2", None][i % 3] if i % 2 else "s1", len(t or ""), 7, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, docs, column, rule):
    rows = [(r["doc_id"], int(rule(r["text"] or ""))) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    return spark.createDataFrame(sorted(set(rows)), f"doc_id long, {column} int")


def test_statistics_and_base(docs):
    found = quality_rules.apply_rules(docs, quality_rules.RuleList(())).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect()
    assert len({r["doc_id"] for r in found}) == docs.select("doc_id").distinct().count()
    for r in found:
        t, w, at, seen, dup = r["text"] or "", words(r["text"]), {}, set(), 0
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        for line in t.split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])


def test_rules_are_learnt_and_ordered(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)).astype(int)
    found = quality_rules.learn(x, y, ["symbol_rate", "repeat_share", "digit_share"])
    held = np.zeros(len(x), bool)
    for rule in found.rules:
        held |= np.all([(x[:, ["symbol_rate", "repeat_share", "digit_share"].index(n)] > t) if op == ">" else (x[:, ["symbol_rate", "repeat_share", "digit_share"].index(n)] <= t) for n, op, t in rule.tests], axis=0)
    assert (held == y).mean() > 0.97
    labels = labels_of(spark, docs, "quality", lambda t: "e" in t)
    assert quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).count() == docs.count()
    assert quality_rules.apply_rules(empty, quality_rules.fit(empty, labels)).count() == 0


def test_patience_and_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([5, 5, 5], [5, 5, 5]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.patience([7, 1, 2, 8], [1, 2, 1, 2]) == [(1, 0), (2, 1)]


def lines_held_before(rows, least):
    """By plain loops over all pairs: each text without the lines of runs of `least` words that an earlier one holds unbroken."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    out = {}
    for k, (none, d, t) in enumerate(order):
        lines, gone = t.split("\n"), set()
        size = [len(words(x)) for x in lines]
        for _, _, other in order[:k]:
            held = f"\n{other}\n"
            for low in range(len(lines)):
                for high in range(low + 1, len(lines) + 1):
                    if "\n" + "\n".join(lines[low:high]) + "\n" not in held:
                        break
                    if sum(size[low:high]) >= least:
                        gone |= set(range(low, high))
        out[None if none else d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_equals_loops(docs, empty, texts):
    found = line_dedup.line_dedup(docs)
    assert found.count() == docs.count()
    want = lines_held_before([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 30)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found.collect():
        t = before[r["doc_id"]]
        assert r["text"] == (None if t is None else want[r["doc_id"], t])
        assert r["lang"] == (None if r["doc_id"] is None else "en")
        if r["lines_removed"]:
            assert r["n_chars"] == len(r["text"])
    lines = [x for r in found.collect() for x in (r["text"] or "").split("\n")]
    for passage in {x for t in texts for x in (t or "").split("\n") if len(words(x)) > 50}:
        assert passage in lines
    assert line_dedup.line_dedup(empty).count() == 0


def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((str(d), p, str(least.get(find(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    found = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert found == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | set(least.values())
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7, 9])
def test_links_reach_all_pairs_for_any_number_of_blocks(spark, blocks):
    rng = random.Random(blocks)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        x = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << bit
        prints.append(x)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    edges = simhash.links(spark.createDataFrame([(p, p) for p in prints], "fp long, node long"), 4, blocks)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(label.get(p, p) == find(p) for p in prints)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(chain).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[500] == found[501] == 500
    assert components(chain.limit(0)).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and all(0 <= p <= 1 for p in r["positions"])
    assert all(r["source_size"] == sizes[r["source"]] for r in found)
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert target[s] - 1 < taken[s] <= target[s] + 1e-6 or taken[s] == int(target[s])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(empty).count() == 0


def test_curriculum_follows_its_schedule():
    import numpy as np

    for start, end in ((1.5, 0.5), (1, 1), (0.5, 1.5)):
        share = np.linspace(0, 1, 11)
        slope, area = (end - start) / 2, (start + end) / 2
        t = share if abs(slope) < 1e-12 else (-start + np.sqrt(start * start + 4 * slope * share * area)) / (2 * slope)
        assert np.allclose((start * t + slope * t * t) / area, share)


def test_packing_round_trip(docs, empty, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, open_windows=3).collect()
    for d, t in enumerate(texts):
        want = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == d)
        times = 3 if d == 5 else 1
        assert sum(len(p) for _, p in pieces) == 4 * len(want) * times
        if times == 1:
            assert b"".join(p for _, p in pieces) == want.tobytes()
            assert [s for s, _ in pieces] == list(np.cumsum([0, *(len(p) // 4 for _, p in pieces)])[:-1])
        assert all(r["doc_tokens"] == len(want) for r in rows if r["doc_id"] == d)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and {r["padded"] for r in pieces} == {2048 if at > 1024 else 1 << (at - 1).bit_length()}
    assert packing.pack(empty).count() == 0


def test_subwords_equal_the_reference_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("", " ", "a\r\n\tb  c", "don't <|endoftext|> stop", "naïve Ünïcödé 漢字 🙂", "x" * 3000, "1234567 89", "    z"):
        assert ids_of(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    x[300:420] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [1.0] * 3), (1100, [1.0, None] * 4), (None, [1.0] * 8), (50, x[50].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(table, F.col("vec_id") % 50 == 0, sample_rows=400, leaf_rows=16, branch=4).collect()
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = 0
    for q in range(0, 700, 50):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(700), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(g[2] - s[g[1]]) < 1e-12 for g in got)
        hit += len({g[1] for g in got} & set(best))
    assert hit >= 0.9 * 70
    assert {r["query_id"] for r in found} == set(range(0, 700, 50))
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    # every query finds its five, however few leaves the calibration asks for
    little = ann.nearest(table, F.col("vec_id") % 50 == 0, recall=0.01, sample_rows=400, leaf_rows=3, branch=4).collect()
    assert {(r["query_id"], r["rank"]) for r in little} == {(q, k) for q in range(0, 700, 50) for k in range(1, 6)}
    few = ann.nearest(spark.createDataFrame(rows[:3], table.schema), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_blocks_of_leaves_change_no_neighbour(spark, monkeypatch):
    """Small blocks of rows and queries, repeated rows, and columns with the operator's own names."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    x[100:200] = x[100]
    rows = [(i, v.tolist(), 1, "a", True) for i, v in enumerate(x)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, v string, asks boolean").repartition(3)
    found = lambda: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, F.col("vec_id") % 2 == 0, leaf_rows=30, branch=3, recall=1.0).collect())
    want = found()
    assert len(want) == 150 * 5
    for name, n in (("BLOCK_ROWS", 7), ("BLOCK_QUERIES", 5), ("AT_ONCE", 3)):
        monkeypatch.setattr(ann, name, n)
    assert found() == want


def test_boosting_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_boosted(x, y)
    assert ((boosting.sigmoid(model.raw(x)) > 0.5) == y).mean() > 0.97
    knots = boosting.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert np.all(np.diff(knots[1]) >= 0)
    assert boosting.fit_boosted(np.zeros((0, 4)), np.zeros(0)).raw(x).shape == (800,)


def test_toxicity_held_out(spark, empty):
    r = random.Random(5)
    rows = []
    for i in range(900):
        t = [r.choice("lorem ipsum dolor sit amet elit sed do tempor".split()) for _ in range(60)]
        if i % 4 == 1 and i % 3:
            for k in r.sample(range(60), 5):
                t[k] = r.choice(["grumpf", "zorkly", "Gr.umpf"])
        rows.append((i, " ".join(t)))
    rows += [(2000, ""), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, docs, "toxic", lambda t: "umpf" in t or "zork" in t)
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == len(rows)


def test_byte_cnn_held_out(spark, empty):
    r = random.Random(6)
    prose = lambda: " ".join(r.choice("lorem ipsum dolor sit amet elit".split()) for _ in range(r.randint(20, 400)))
    rows = [(i, prose() if i % 3 else prose() + " ### $$$ %%%" * 4 + prose()) for i in range(240)] + [(900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, docs, "quality", lambda t: "###" not in t)
    net = byte_cnn.fit(docs, labels)
    found = byte_cnn.score(docs, net).join(labels, "doc_id").where("doc_id < 900").collect()
    held = [r for r in found if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert byte_cnn.score(docs, net).where("score is null or score < 0 or score > 1").count() == 0
    assert byte_cnn.score(empty, net).count() == 0


def test_chunks_cover_whole_texts():
    shape = byte_cnn.Shape()
    for n in (0, 1, shape.step, shape.chunk, shape.chunk + 1, 5000):
        text = bytes(1 + i % 250 for i in range(n))
        found, owner = byte_cnn.chunk_bytes([text, b"zz"], shape)
        joined = found[owner == 0][0].tobytes() + b"".join(x[shape.chunk - shape.step :].tobytes() for x in found[owner == 0][1:])
        assert joined.rstrip(b"\0") == text.rstrip(b"\0")


def test_windows_score_each_place_once():
    shape = Shape()
    for n in (1, 2, 31, 32, 33, 34, 60, 61, 62, 500):
        begin, scored = windows(np.array([n, 5]), shape)
        at = np.sort((begin[:, None] + np.arange(shape.window))[scored])
        assert at.tolist() == [*range(n - 1), *range(n, n + 4)]


def small_net():
    shape = Shape(rows=64, classes=16, singles=10, dim=8, head=8, window=8, step=6)
    rng = np.random.default_rng(4)
    unigram = np.zeros(VOCABULARY)
    unigram[:80] = rng.integers(1, 50, 80)
    unigram[DOCUMENT] = 5
    begins = np.arange(VOCABULARY) % 3 == 0
    begins[DOCUMENT] = True
    net = Attention(Counts.of(unigram, begins, rng.random((64, 64)) * 9, rng.random(64) * 9, rng.random(64) * 9, shape), shape)
    net.p["out"][:] = rng.normal(size=net.p["out"].shape)
    return net, begins, rng


def test_attention_is_a_distribution_over_words_and_causal():
    net, begins, rng = small_net()
    total, first, opening = 0.0, 0.0, []
    for batch in np.array_split(np.arange(VOCABULARY), 20):
        ids = np.stack([np.full(len(batch), DOCUMENT), np.full(len(batch), 3), batch], axis=1).ravel()
        log, opens = net.log_probs(ids, np.full(len(batch), 3))
        total += np.exp(log[2::3]).sum()
        first += np.exp(log[2::3])[begins[batch]].sum()
        opening.append(opens[2::3])
    assert abs(total - 1) < 0.01 and np.ptp(np.concatenate(opening)) < 1e-4
    # what begins a word has the mass that the model says, so P(first) / P(any beginning) adds up to 1 over first subwords, and what does not, to the rest
    assert abs(first - np.exp(opening[0][0])) < 0.01
    a, b = rng.integers(0, 80, 30), rng.integers(0, 80, 30)
    b[:17] = a[:17]
    assert np.allclose(net.log_probs(a, np.array([30]))[0][:17], net.log_probs(b, np.array([30]))[0][:17], atol=1e-5)


def slow_log_probs(net, ids, sizes):
    """By hidden and class_probs, a window at a time."""
    c, out, opening = net.counts, np.zeros(len(ids)), np.zeros(len(ids))
    begin, scored = windows(sizes, net.shape)
    rows = np.append(c.row[ids], np.zeros(net.shape.window, np.int32))
    for w, s in zip(begin, scored, strict=True):
        h = net.hidden(rows[None, w : w + net.shape.window])[-1][0]
        for t in np.flatnonzero(s):
            last, goal = rows[w + t], rows[w + t + 1]
            probs = net.class_probs(h[t : t + 1], np.array([last]))[0]
            out[w + t + 1] = np.log(probs[c.kind[goal]]) + c.within[last, goal] + c.rest[ids[w + t + 1]]
            opening[w + t + 1] = np.log(probs[c.opens > 0].sum())
    return out, opening


def test_fast_scoring_equals_the_slow_form():
    net, _, rng = small_net()
    ids, sizes = rng.choice(200, 300), np.array([1, 2, 40, 7, 8, 9, 233])
    for fast, slow in zip(net.log_probs(ids, sizes, 5), slow_log_probs(net, ids, sizes), strict=True):
        assert np.allclose(fast, slow, atol=1e-3)


def test_score_equals_the_slow_form(spark, monkeypatch):
    """The operator's scores against words taken one by one."""
    from quire.llm.subwords import word_ids

    texts = ["Ab cde ab", "ab unknownword cde cde", "", "cde ab\u00a0x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nets = []
    fit = lm.fit_attention
    monkeypatch.setattr(lm, "fit_attention", lambda *a: nets.append(fit(*a)) or nets[-1])
    found = {r["doc_id"]: r for r in lm.lm_scores(docs, share=1).collect()}
    counts = {}
    for d, t in enumerate(texts):
        for w in [*words((t or "").lower()), None]:
            counts[w] = counts.get(w, 0) + (zlib.crc32(str(d).encode()) % 7 != 2)
    n = sum(counts.values())
    for d, t in enumerate(texts):
        ids, starts = [DOCUMENT], []
        for w in words((t or "").lower()):
            starts.append(len(ids))
            ids += word_ids(w.encode())
        log, opening = slow_log_probs(nets[0], np.array([*ids, DOCUMENT]), np.array([len(ids) + 1]))
        want = 0.0
        for w, i, j in zip([*words((t or "").lower()), None], [*starts, len(ids)], [*starts[1:], len(ids), None], strict=False):
            p = log[i] - opening[i] if w is None else log[i:j].sum() - opening[i] + opening[j]
            want += np.log10(0.3 * counts[w] / n + 0.7 * np.exp(p))
        assert abs(found[d]["score"] - want) < 1e-2


def test_lm_scores(spark, docs, empty, texts):
    found = lm.lm_scores(docs, warm_docs=50, share=4, trainer_docs=20).collect()
    assert len(found) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    counts = {}
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            for w in [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {}
    for d, t in rows:
        w = [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
        want[d] = (len(w), sum(counts.get(x, 0) > 0 for x in w), sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))
    for r in found:
        assert r["train_tokens"] == n and (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert abs(r["base_score"] - want[r["doc_id"]][2]) < 1e-6
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert lm.lm_scores(empty).count() == 0


@pytest.fixture(scope="module")
def turns(spark):
    r = random.Random(8)
    rows = []
    for c in range(300):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(1, 4)
        rows += [(c, i + c % 3, role, "\n".join(" ".join(["ab", "cde", "f"] * r.randint(1, 4 if role == "user" else 9)) + ("?" if role == "user" and r.random() < 0.8 else ".") for _ in range(1 if role == "user" else 3)), "own", True) for i, role in enumerate(roles)]
    rows += [(500, i, ["user", "assistant"][i % 2], "hello there", None, None) for i in range(700)]  # three blocks
    rows += [(501, 0, None, None, None, None), (502, 0, "user", "", None, None), (502, 0, "user", "", None, None), (503, None, "user", " " * 200_000 + "x", None, None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string, block boolean")


def roles_of(found):
    got = {}
    for x in sorted(found, key=lambda x: (x["block"], x["place"])):
        got.setdefault(x["conv_id"], []).append(x["role"])
    return got


def test_chat_recovers_roles(turns):
    given = {}
    for x in sorted((x for x in turns.collect() if x["conv_id"] < 300), key=lambda x: (x["conv_id"], x["turn"])):
        given.setdefault(x["conv_id"], []).append(x["role"])
    for unmarked, least in ((0, 0.97), (20, 0.6)):
        spelt = chat.transcripts(turns, unmarked)
        got = roles_of(chat.format_chat(spelt, chat.fit(spelt)).collect())
        held = [c for c in given if zlib.crc32(str(c).encode()) % 5 == 0]
        assert sum(got[c] == given[c] for c in held) >= least * len(held)
        assert len(got[501]) == 1
        if not unmarked:
            assert got[500] == ["user", "assistant"] * 350
    rows = [(None, None, None, "Human: hi "), (None, None, None, "Human: hi "), (7, 0, "user", "Human: <|q|> **x** ")]
    model = chat.fit(chat.transcripts(turns, 0))
    odd = chat.format_chat(turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"), model).collect()
    assert sorted(x["rendered"] for x in odd) == ["<|user|>\n<|q|> **x**\n<|end|>"] + ["<|user|>\nhi\n<|end|>"] * 2
    assert chat.format_chat(chat.transcripts(turns.limit(0)), chat.fit(turns.limit(0))).count() == 0


def test_blocks_do_not_change_turns(spark, turns):
    """Long transcripts, of rows that begin turns and rows that go on with them, in blocks of any size and levels of matrices."""
    r = random.Random(3)
    rows = []
    for c in range(6):
        i = 0
        while i < 300:
            role = r.choice(["User: ", "Bot: "])
            for k in range(r.choice([1, 1, 2, 30])):
                rows.append((c, i, role + "hi" if k == 0 else r.choice(["go on with it", "", "and so\n\nforth"])))
                i += 1
    table = spark.createDataFrame([*rows, *rows[:5]], "conv_id long, turn long, text string").repartition(3)
    model = chat.fit(chat.transcripts(turns, 10))
    plain = {}
    for c in range(6):
        pieces = sorted((t, x) for d, t, x in [*rows, *rows[:5]] if d == c)
        lines, seen = chat._seen([x for _, x in pieces])
        states = model.decode(seen)
        begins = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0]
        plain[c] = [(chat.ROLES[states[i] // 2], "\n".join([chat._MARKER.sub("", lines[i], count=1) if states[i] % 2 == 0 else lines[i], *lines[i + 1 : j]])) for i, j in zip(begins, [*begins[1:], len(lines)], strict=True)]
    for size in (3, 256, 10_000):
        got = {}
        for x in sorted(chat.format_chat(table, model, size).collect(), key=lambda x: (x["block"], x["place"])):
            got.setdefault(x["conv_id"], []).append((x["role"], x["text"]))
        assert got == plain


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(9)
    s = chat.STATES
    model = chat.Speakers(np.log(rng.dirichlet(np.ones(s))), np.log(rng.dirichlet(np.ones(s), s)), [np.log(rng.dirichlet(np.ones(n), s)) for n in chat.SIZES.values()])
    seen = np.stack([rng.integers(0, n, 4) for n in chat.SIZES.values()], axis=1)
    emit = model.scores(seen)
    worth = lambda p: model.start[p[0]] + sum(emit[i, x] for i, x in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(s), repeat=4), key=worth)
    assert tuple(model.decode(seen)) == best
    assert np.isclose(model.matrix(seen)[3, best[-1]], max(model.move[3, p[0]] + worth(p) - model.start[p[0]] for p in itertools.product(range(s), repeat=4) if p[-1] == best[-1]))


def test_samples_are_the_least_by_hash(spark):
    from quire.llm.common import least_by_hash

    rows = spark.range(5000).select(F.col("id"), F.xxhash64("id").alias("h")).repartition(7)
    want = sorted((r["h"], r["id"]) for r in rows.collect())[:200]
    assert [(r["h"], r["id"]) for r in least_by_hash(rows, F.col("h"), 200, 5000, "id").collect()] == want
    assert least_by_hash(rows, F.col("h"), 9000, 5000).count() == 5000 and least_by_hash(rows.limit(0), F.col("h"), 5, 0).count() == 0


def test_attention_learns_from_every_place_once():
    """By default each subword of a training document is a target once, those of long words too."""
    import inspect

    from quire.llm import lm
    from quire.llm.attention import Shape

    shape, words = Shape(), [b"extraordinarily" * 9, b"a", b"", b"b"] * 30
    for text in (b"", b"a", b" ".join(words), b"one two " * 14):
        block = lm.Block()
        found, numbers = block.add(text, False)
        rows, spans = block.stretches(found, numbers, 5, inspect.signature(lm.lm_scores).parameters["share"].default, shape)
        whole = [x for n in numbers.tolist() for x in block.ids[n]]
        assert [int(x) for r, (low, high) in zip(rows, spans, strict=True) for x in r[low + 1 : high + 1]] == whole


def test_fast_gradients_equal_the_slow_form():
    net, _, rng = small_net()
    p, c, s = net.p, net.counts, net.shape
    rows = c.row.astype(np.uint16)[rng.choice(200, (6, s.window + 1))]
    scored = rng.random((6, s.window)) < 0.7
    x, q, k, v, a, o, h = net.hidden(rows[:, :-1])
    d = net.class_probs(h[scored], rows[:, :-1][scored])
    d[np.arange(len(d)), c.kind[rows[:, 1:][scored]]] -= 1
    d /= len(d)
    dh = np.zeros_like(h)
    dh[scored] = d @ p["out"].T
    flat = lambda z: z.reshape(-1, z.shape[-1])
    do = dh @ p["merge"].T
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
    scale = s.head**-0.5
    dx = dh + dq @ (p["query"].T * scale) + dk @ p["key"].T + dv @ p["value"].T
    want = {"out": h[scored].T @ d, "merge": flat(o).T @ flat(dh), "query": flat(x).T @ flat(dq) * scale, "key": flat(x).T @ flat(dk), "value": flat(x).T @ flat(dv), "place": dx.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    np.add.at(want["embed"], rows[:, :-1], dx)
    got, used = net.gradients(rows, np.flatnonzero(scored), c.prior * STEPS + ZERO)
    assert np.array_equal(used, np.unique(rows[:, :-1]))
    own, got["embed"] = got["embed"], np.zeros_like(p["embed"])
    got["embed"][used] = own
    for name in p:
        assert np.allclose(got[name], want[name], atol=1e-4), name


def test_training_text_takes_little_room(spark):
    """What is written of training documents is their subwords once, 2 bytes each at most before compression; no windows and no shuffle of them."""
    text = " ".join(f"w{i % 977} common words of a text" for i in range(3000))
    block = lm.Block()
    found, numbers = block.add(text.encode(), False)
    ids = block.subwords(found, numbers)
    assert np.array_equal(lm._numbers(lm._planes(ids), "<u2"), ids) and len(lm._planes(ids)) <= 2 * len(ids) + 1
    for n in ([0], [255, 256], [1 << 16, 3], [(1 << 32) - 1, 0]):
        assert lm._numbers(lm._planes(np.array(n, "<u4")), "<u4").tolist() == n
    docs = spark.createDataFrame([(i, text[: 100 * i]) for i in range(20)], "doc_id long, text string")
    parts = lm._parts(docs.selectExpr("doc_id", "text", "doc_id % 7 = 2 AS held_out", "xxhash64(doc_id, text) AS o"), "bigint").where("numbers is not null").collect()
    for r in parts:
        own = lm.Block()
        want = own.subwords(*own.add(text[: 100 * r["doc_id"]].encode(), False))
        assert (r["subwords"] is None) == (r["doc_id"] % 7 == 2) and (r["subwords"] is None or lm._numbers(r["subwords"], "<u2").tolist() == want.tolist())


def test_words_of_a_block_are_encoded_together(monkeypatch):
    """Some thousands of new words take a few calls of the encoder, and their ids are those of each word by itself, white space inside words included."""
    from quire.llm import subwords

    odd = [" ", "a ", "　x", "<|endoftext|>", "'s", "1a!b", "́", "\x1c", "日本", "😀a", "​"]
    many = [x.encode() for x in (*(f"w{i}ord" for i in range(3000)), *odd * 3)] + [b"\xff\xfea", b"\xe6\xb5"]
    flat, length = subwords.all_word_ids(many)
    want = [subwords.word_ids(w) for w in many]
    assert flat.tolist() == [x for ids in want for x in ids] and length.tolist() == list(map(len, want))
    assert [len(x) for x in subwords.all_word_ids([])] == [0, 0]
    calls, own = [], subwords.encoder()

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(own, name)

    monkeypatch.setattr(subwords, "encoder", lambda folder=None: Counted())
    block = lm.Block()
    numbers = block.subwords(*block.add(b" ".join(many[:3000]), False))
    assert numbers.tolist() == [DOCUMENT, *(x for ids in want[:3000] for x in ids), DOCUMENT] and len(calls) < 30


def test_words_are_numbered_as_they_come():
    """Documents together, in slices and with white space at their ends, against loops; white space is ASCII's own, and letters A-Z alone change."""
    import pyarrow as pa

    raw = [b"", b"  ", b" a B\x0bc\x1cd ", b"\xff\xfe A\xc3 x", "Äb A".encode(), b"a", b"b ", b"\n"]
    block, number = lm.Block(), {b" ": 0}
    held = [i % 3 == 1 for i in range(len(raw))]
    column = pa.array(raw, pa.large_binary())
    got = block.add_all(column.slice(0, 5), held[:5]) + block.add_all(column.slice(5), held[5:])
    want = [[*(number.setdefault(w, len(number)) for w in x.lower().split()), 0] for x in raw]
    assert [x.tolist() for x in got] == want and list(block.number) == list(number)
    counted = np.concatenate([n for _, n in block.listed()])
    assert counted.tolist() == [sum(x.count(i) for x, h in zip(want, held, strict=True) if not h) for i in range(len(number))]
