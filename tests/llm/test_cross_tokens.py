"""Alignment of two tokenizers against plain loops over the libraries' own encoders."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import cross_tokens, queries

SCHEMA = "doc_id bigint, text string"
TEXTS = [
    None, "", " ", "  two  spaces \n\n and\ttabs\r\n", "plain words, plain words", "<|endoftext|> and <s> </s> <unk> <0x0A>", "naïve ﬁ é́ 日本語 🙂🙂", "a▁b", "▁", "x" * 3000, " " * 2500, "\n" * 30 + "end", "\0\x01\x7f", "plain words, plain words", "l'été est là", "e" * 7 + " " + "e" * 7,
]


def brute(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {}  # of byte-level pieces: printable bytes stand for themselves, the others for 256 and up, in order
    for x in [*range(33, 127), *range(161, 173), *range(174, 256)]:
        back[chr(x)] = x
    for x in sorted(set(range(256)) - set(back.values())):
        back[chr(256 + sum(y > 255 for y in map(ord, back)))] = x
    spell = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, counts = [], Counter()
    for text in texts:
        a, b, ends = [], [], None
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            raw_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
            raw_b = [spell(second.id_to_piece(i)) for i in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = [], []
        links, parts, i, j, na, nb, here, there = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if na <= nb and i < len(a):
                na += len(raw_a[i])
                here.append(a[i])
                i += 1
            else:
                nb += len(raw_b[j])
                there.append(b[j])
                j += 1
            if na == nb:
                links.append((here[-1], there[-1]))
                parts.append(",".join(map(str, here)) + "|" + ",".join(map(str, there)))
                here, there = [], []
        counts.update(links)
        rows.append((len(a), len(b), links, ";".join(parts)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(said.encode()).hexdigest() if x else "", said) for n_a, n_b, x, said in rows]


def invented():
    rng = random.Random(2)
    syllables = ["ba", "tion", "é", "qu", "str", "ön", " ", " ", ". ", "\n", "12", "’"]
    return TEXTS + ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 400))) for _ in range(40)]


@pytest.mark.parametrize("mapped", [True, False])
def test_equal_to_loops(spark, mapped, monkeypatch):
    texts = invented()
    monkeypatch.setattr(cross_tokens, "HELD", 100)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    found = cross_tokens.cross_alignment(docs, keep_groups=True, mapped=mapped)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["groups"]) for r in found.collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x[0] > 0 for x in want) > 45 and any(x[0] == 0 and t for x, t in zip(want, texts, strict=True))


def test_counts_are_sorted_and_summed_over_ranges(spark):
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(300)], SCHEMA).repartition(7)
    found = cross_tokens.align(docs)
    rows = cross_tokens.pair_counts(found).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["key"] for r in rows}) == len(rows) and all(r["n"] % 300 == 0 for r in rows)
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)


def test_query_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, "one two", "x"), (None, "one two", "x"), (1, None, None), (2, "one two", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([r[1] for r in rows])
    got = queries.QUERIES["op11_cross_tokens"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *w[:7])) for r, w in zip(rows, want, strict=True))
    assert cross_tokens.cross_alignment(docs.limit(0)).count() == 0
