"""Word and shingle hashing, and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import jaccard_join, text
from stratum.llm.jaccard_join import ngram_jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(value, n=5):
    words = WORD.findall((value or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, n=5, threshold=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


def corpus(seed=1, base=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(base):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 30, 120, 400]))]
        texts.append(words)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
    for _ in range(60):  # a common passage in otherwise different documents
        texts.append([rnd.choice(vocabulary) for _ in range(rnd.choice([4, 12, 60]))] + passage)
    texts += [passage] * 30
    rnd.shuffle(texts)
    return [(k, rnd.choice([" ", "\n", " \t "]).join(w.upper() if rnd.random() < 0.1 else w for w in words)) for k, words in enumerate(texts)]


@pytest.mark.parametrize("common", [6, 24])
def test_join_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = [*corpus(), (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (None, "one two"), (None, None), (5, "again " * 9)]
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, component_id string, n_shingles int").repartition(3)
    got = sorted((tuple(r) for r in ngram_jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_cut_off_list_of_common_shingles_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 4)
    monkeypatch.setattr(jaccard_join, "COMMON_MOST", 10)
    rows = corpus(7, 20)
    got = sorted((tuple(r) for r in ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert ngram_jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles_of_a_block():
    texts = ["a b c d e f", None, "A  b\tc d E", "x", "", "q r s t", "ü é b c d é"]
    (at, buf, offs), = text.text_blocks(pa.array(texts))
    keys = text.shingle_keys(buf, offs)
    assert at == 0 and text.per_text(keys, len(texts)).tolist() == [len(shingles(t)) for t in texts]
    ids = [set((keys[(keys >> np.uint64(54)) == k] & text.ID_MASK).tolist()) for k in range(len(texts))]
    assert ids[2] < ids[0] and not ids[3] & ids[0]


def test_a_long_text_is_a_block_of_its_own():
    texts = ["a " * 3, "b " * 5000, "c"]
    blocks = [(at, len(offs) - 1) for at, _, offs in text.text_blocks(pa.array(texts), 100)]
    assert blocks == [(0, 1), (1, 1), (2, 1)]
