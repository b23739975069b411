"""Aligned tokens against groups by byte offsets, from both libraries."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from vecflow.llm import alignment
from vecflow.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [
    "The strawberries weren't ready,  were they?   ",
    "ends in one blank \n and  ", "\u2581 alone ", " a\n b\n  c \t d\r\n\r\n  e  f　g　 h  i",
    "café café 日本語 \U0001f600\U0001f468‍\U0001f469 1234567890 0x7f ''' ’s",
    "<|endoftext|> <s></s> <0x41> <unk>",
    "has ▁ the mark",
    "",
    None,
    " ",
    "\x00\x01 \x1f x﻿ y",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b",
    "The strawberries weren't ready,  were they?   ",
    "the the the the",
]


def by_offsets(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    own_bytes = alignment.byte_level_bytes([first.id_to_token(i) for i in range(first.get_vocab_size())])
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        xa, xb = [own_bytes[i] for i in a], [alignment.piece_bytes(second.id_to_piece(i)) for i in b]
        if not b"".join(xa) == b"".join(xb) == (" " + t).encode():
            found.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (xa, xb)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        found.append((a, b, groups))
    counts = Counter()
    links = [Counter((x, y) for g in f[2] for x in g[0] for y in g[1]) if f else Counter() for f in found]
    for x in links:
        counts.update(x.keys())
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for f, own in zip(found, links):
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in f[2])
        rows.append((len(f[0]), len(f[1]), len(f[2]), sum(own.values()), sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS chunk", "2 AS codes")
    chunk_rows = alignment.chunks(docs, A, B)
    return [tuple(x)[1:] for x in alignment.aligned(chunk_rows, alignment.pair_counts(chunk_rows)).orderBy("doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_rows_equal_offsets(spark):
    texts = TEXTS + [" ".join(t or "" for t in TEXTS if t and "▁" not in t) * 20]
    assert rows_of(spark, texts) == by_offsets(texts)


def test_whole_small_table(spark):
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert rows_of(spark, texts) == by_offsets(texts)


def test_units_by_random_texts():
    r, align = random.Random(2), alignment.Aligner(A, B)
    marks = [" ", " ", "\n", "\t", "@a0", "@200b", "@3000", "\x85", "\x1c", "a", "'s", "B", "9", "!", "é", "日", "\U0001f600", "the", "'"]
    marks = [chr(int(m[1:], 16)) if m[0] == "@" else m for m in marks]
    for _ in range(1500):
        t = "".join(r.choices(marks, k=r.randint(1, 30)))
        parts = align.encoded(align.units(t))
        assert [[i for x in side for i in x] for side in parts] == [side[0] for side in align.encoded([" " + t])]


@pytest.mark.parametrize("few", [0, 1000])
def test_transducer_steps(monkeypatch, few):
    """All units at once, or one by one."""
    monkeypatch.setattr(alignment, "FEW_UNITS", max(few, 1))
    t = alignment.Transducer([b"ab", b"c", b"d", b"abc"], [b"a", b"bc", b"d", b"x"])
    units = [([0, 1, 2], [0, 1, 2]), ([3], [0, 1]), ([0], [0]), ([0], [3]), ([2], [2, 2]), ([], []), ([2, 2], [2]), ([], [2]), ([3, 2, 0, 1], [0, 1, 2, 0, 1])]
    flat = [np.array([x for u in units for x in u[k]], np.int64) for k in (0, 1)]
    counts = [np.array([len(u[k]) for u in units]) for k in (0, 1)]
    for _ in range(2):
        a, b, good = t.groups(tuple(flat), tuple(counts))
        assert good.tolist() == [True, True, False, False, False, True, False, False, True]
        assert a[:4].tolist() == [0, 0, 1, 0] and a[-4:].tolist() == [0, 1, 2, 2]
        assert b[:5].tolist() == [0, 0, 1, 0, 0] and b[-5:].tolist() == [0, 0, 1, 2, 2]
    assert t.steps[0 << 16 | 0] == t.numbers[0][b"ab"] and t.states[0] == (1, b"")


def test_large_groups(monkeypatch):
    align = alignment.Aligner(A, B)
    units = align.units("naïve aaaaaaaaaaaaaaaaaa 日本語 the")
    want = align.aligned(units)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    got = align.aligned(units)
    for u in range(len(units)):
        pairs = [Counter(), Counter()]
        for c, x in zip(pairs, (want, got)):
            end = np.cumsum(x.n_codes)
            for code, n in zip(x.codes[end[u] - x.n_codes[u] : end[u]].tolist(), x.times[end[u] - x.n_codes[u] : end[u]].tolist()):
                c[code] += n
        assert pairs[0] == pairs[1]


def test_nothing_and_groups(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
    got = alignment.with_groups(spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id int, text string"), A, B).orderBy("doc_id").collect()
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A).encode(" the cat").ids, sentencepiece.SentencePieceProcessor(model_file=B).encode("the cat")
    assert got[0].token_groups == f"{a[0]}|{b[0]};{a[1]}|{b[1]}" and got[1].token_groups == ""


@pytest.mark.parametrize("limit", [1, 1000])
def test_chunks_do_not_show(spark, monkeypatch, limit):
    monkeypatch.setattr(alignment, "CHUNK_CHARACTERS", limit)
    texts = [t * 3 if t else t for t in TEXTS] * 3
    assert rows_of(spark, texts) == by_offsets(texts)
