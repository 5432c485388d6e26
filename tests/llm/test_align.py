from __future__ import annotations

import hashlib
import json
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate, groupby

import pytest
from pyspark.sql import functions as F

from voxweave.llm import align as A

SCHEMA = "doc_id long, text string"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.TOKENIZERS + "/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.TOKENIZERS + "/piece_bpe_32k.model")


def brute(rows, tools):
    """Whole texts through both tokenizers, ends compared as sets."""
    a_tool, b_tool = tools
    vocab = json.load(open(A.TOKENIZERS + "/byte_bpe_50k.json", encoding="utf-8"))
    a_bytes = A._byte_level(vocab)
    out, held = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        a = a_tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        ap = [a_bytes[i] for i in a]
        bp = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tool.id_to_piece(i)]]
        if not text or b"".join(ap) != (" " + text).encode() or b"".join(bp) != (" " + text).encode():
            out.append([doc_id, 0, 0, 0, Counter(), ""])
            continue
        ae, be = list(accumulate(map(len, ap))), list(accumulate(map(len, bp)))
        cuts = sorted(set(ae) & set(be))
        of = lambda ids, ends: [[i for i, _ in g] for _, g in groupby(zip(ids, ends), key=lambda x: bisect_left(cuts, x[1]))]
        groups = list(zip(of(a, ae), of(b, be)))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        for p in links:
            held[p].add(k)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest()])
    most = defaultdict(int)
    for (x, _), docs in held.items():
        most[x] = max(most[x], len(docs))
    return [
        (d, n_a, n_b, g, sum(links.values()), sum(m for p, m in links.items() if len(held[p]) == most[p[0]]), sum(m * len(held[p]) for p, m in links.items()), s)
        for d, n_a, n_b, g, links, s in out
    ]


def same(df, rows, tools):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)
    assert got == sorted(brute(rows, tools), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a  b   c \n d\t e"), (6, "the the the cat"), (6, "the the the cat"), (None, "a null id"), (None, None),
    (7, "<|endoftext|> <s> </s> <0x41> <unk>"), (8, "x▁y keeps nothing"), (9, "é\U0001F600 你好   \x00 nul   end "), (10, "=" * 700 + " " * 50 + "-" * 33),
    (11, "it's we'll I'M 12,345.67 e-mail@x.yz"), (12, "word " * 5000), (13, " lead and trail "), (14, "é combining ﻿ bom \x1c sep"),
]


def test_odd(spark, tools):
    clash = spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumn("n_a", F.lit("mine")).withColumn("chunk", F.lit(1))
    same(A.align(clash), ODD, tools)


def test_empty(spark):
    assert A.align(spark.createDataFrame([], SCHEMA)).collect() == []
    assert A.align(spark.createDataFrame([(1, None)], SCHEMA)).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_random(spark, tools, monkeypatch):
    """Strings of awkward characters; small chunks, so that every stream has several rows."""
    rng = random.Random(5)
    alphabet = list("  ab1.,'\n\t-e") + ["é", "你", "\U0001F600", " ", "▁", "the", " the", "ing", "\u0085", "\r\n", "<s>"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    same(A.align(df), rows, tools)


def test_query(spark, sf, tools):
    """The registered query over its whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(A.op11_alignment(spark, sf), [r for r in rows], tools)


def test_wide_groups(monkeypatch):
    """Groups too wide to be listed link by link give the same pairs."""
    texts = [t for _, t in ODD if t] + ["  ".join("x" * 9 for _ in range(9))]
    found = []
    for wide in (4096, 1, 0):
        monkeypatch.setattr(A, "WIDE", wide)
        known = A.Aligner(A.TOKENIZERS)
        units = [known.of(t) for t in texts]
        known.fresh()
        n = known.numbers[:, 5]
        first = n.cumsum() - n
        found.append((units, known.texts, known.numbers.tolist(), [sorted(zip(known.pair[a : a + k].tolist(), known.times[a : a + k].tolist())) for a, k in zip(first, n)]))
    assert found[0] == found[1] == found[2]


def test_large_multiplicities(tools):
    """More than a byte holds, in one chunk and document."""
    known, counts = A.Aligner(A.TOKENIZERS), A._Counts()
    rows = A._chunk(known, counts, 0, [1], ["the " * 1000 + "the"])
    import numpy as np

    times = np.concatenate([np.frombuffer(r["times"], np.uint8) for r in rows if r["kind"] == 1])
    assert times.max() <= 255 and int(times.astype(int).sum()) == rows[0]["numbers"][3] == 1001
    assert counts.merge()[1].tolist() == [1]
