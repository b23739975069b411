"""Every stage of the pipeline against brute force on its own input, and the whole run."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from vecflow.llm import mixing, queries

WORDS = [f"{a}{b}" for a in "ka lo mi ne su ta vo re".split() for b in "rin tol bek dan sor".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def toxic(text):
    return "horrid" in (text or "")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(3)
    own = [". ".join(" ".join(r.choice(WORDS) for _ in range(9)) for _ in range(6)) for _ in range(400)]
    for i in range(0, 400, 4):
        own[i] += " horrid" + r.choice(["ly", "er", "est"])
    near = own[1].split()
    near[20] = "changed"
    own += [own[2], " ".join(near), "mail a.b1@mail.example.com and card 4673763317067198", "", None, own[5] + " " + own[6] * 90]
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 2 else "fr", f"s{i % 3 if i % 4 else 0}", len(t or "")) for i, t in enumerate(own)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    docs.filter("doc_id < 390").select("doc_id", F.lit(1).alias("quality"), F.coalesce(F.col("text").contains("horrid"), F.lit(False)).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def first_of_groups(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in docs:
        for j in docs:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in docs}


def probabilities(rows, topics, keep):
    """Raking and calibration by plain loops."""
    cell = {r.doc_id: (r.source, r.lang, topics[r.doc_id]) for r in rows}
    n = {r.doc_id: len(re.findall("[^ \t\r\n]+", r.text or "")) for r in rows}
    tokens = collections.Counter()
    for i, c in cell.items():
        tokens[c] += n[i]
    weight, share = {c: float(t) for c, t in tokens.items()}, []
    for m in range(3):
        by = collections.Counter()
        for c, t in tokens.items():
            by[c[m]] += t
        share.append({v: t**0.5 / sum(x**0.5 for x in by.values()) for v, t in by.items()})
    for _ in range(60):
        for m in range(3):
            by = collections.Counter()
            for c, w in weight.items():
                by[c[m]] += w
            weight = {c: w * share[m][c[m]] / by[c[m]] if by[c[m]] > 0 else 0.0 for c, w in weight.items()}
    rate = {c: weight[c] / tokens[c] for c in tokens if tokens[c]}
    full = set()
    while True:  # cells that reach 1 give their part to the others
        rest = [c for c in rate if c not in full]
        scale = (keep * sum(tokens.values()) - sum(tokens[c] for c in full)) / sum(weight[c] for c in rest)
        over = {c for c in rest if scale * rate[c] > 1}
        if not over:
            break
        full |= {max(over, key=rate.get)}
    return {i: 1.0 if c not in rate or c in full else scale * rate[c] for i, c in cell.items()}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        kept[name] = rows
        if name != "packing":
            assert docs.columns == columns
            ids = {r.doc_id for r in rows}
            assert len(ids) == len(rows)
        text = {r.doc_id: r.text for r in before}
        if name == "toxicity":
            assert ids == {i for i, t in text.items() if not toxic(t)}
        elif name == "near_duplicates":
            assert ids == first_of_groups(text) and len(ids) < len(before)
            assert all(r.text == text[r.doc_id] for r in rows)
        elif name == "pii":
            assert ids == set(text) and all((r.text is None) == (text[r.doc_id] is None) for r in rows)
            assert all(len(r.text or "") == r.n_chars for r in rows)
            changed = [r for r in rows if r.text != text[r.doc_id]]
            assert len(changed) == 1 and "a.b1@" not in changed[0].text and "4673763317067198" not in changed[0].text
        elif name == "mixing":
            seen = spark.createDataFrame(before, SCHEMA).select("doc_id", mixing.topic_of(F.col("text")).alias("topic"), mixing.lot(F.col("doc_id")).alias("lot")).collect()
            chance = probabilities(before, {r.doc_id: r.topic for r in seen}, corpus_pipeline.KEEP)
            assert ids == {r.doc_id for r in seen if r.lot < chance[r.doc_id]}
        else:
            check_packing(rows, text)
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    pick = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert pick(ran) == pick(kept["packing"])


def check_packing(rows, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = []
    for i, x in text.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want.append((i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_on_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
