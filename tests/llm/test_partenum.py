"""Two-level signatures: subsets of ranges, shared by all pairs that reach the threshold; hot groups and long texts."""

import random

import numpy as np
import pytest

from stratum.llm import jaccard_join, text
from stratum.llm.jaccard_join import K2, N2, RANGE_FEW, SUBSETS, Signer, ngram_jaccard_components

from .test_text_and_join import brute

U = np.uint64


@pytest.mark.parametrize("threshold", [70, 80, 90])
def test_pairs_at_the_threshold_share_a_subset_signature(threshold):
    rnd = np.random.default_rng(threshold)
    sets = []
    for _ in range(400):
        size = int(np.exp(rnd.uniform(np.log(20), np.log(3000))))
        a = rnd.integers(0, 1 << text.ID_BITS, size, dtype=np.uint64)
        inter = int(rnd.integers(-(-threshold * size // 100), size + 1))
        own = max(0, 100 * inter // threshold - size)  # new shingles that the union may still hold
        b = np.concatenate([rnd.permutation(a)[:inter], rnd.integers(0, 1 << text.ID_BITS, own, dtype=np.uint64)])
        assert 100 * inter >= threshold * (size + len(b) - inter)
        sets += [a, b]
    keys = np.concatenate([np.sort(s) | (U(k) << U(text.ID_BITS)) for k, s in enumerate(sets)])
    sigs, docs, few = Signer(np.zeros(0, U), 7, threshold).sign(keys, np.array([len(s) for s in sets]), RANGE_FEW, False)
    own = [set() for _ in sets]
    for s, d in zip(sigs.tolist(), docs.tolist(), strict=True):
        own[d].add(s)
    rich = [k for k in range(0, len(sets), 2) if not (few[k] and few[k + 1])]
    assert all(own[k] & own[k + 1] for k in rich) and (threshold < 80 or len(rich) > 350)
    assert all(len(s) == N2 - K2 > 1 for s in SUBSETS)
    strangers = sum(bool(own[k] & own[k + 3]) for k in range(0, len(sets) - 3, 2))
    assert strangers == 0


def variants(seed, copies, edits, length=60):
    rnd = random.Random(seed)
    words, out = [f"v{seed}x{k}" for k in range(length)], []
    for _ in range(copies):
        own = list(words)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(length)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_large_groups_of_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    texts = [*variants(1, 70, 2), *variants(2, 70, 3), *([variants(3, 1, 0)[0]] * 40), *variants(3, 20, 1)]
    random.Random(3).shuffle(texts)
    rows = [*enumerate(texts), (3, variants(9, 1, 0)[0])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, `a.b` string").repartition(4)
    got = sorted((tuple(r) for r in ngram_jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_a_very_long_text_links_with_its_near_copy(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(5000)}" for _ in range(400_000)]
    other = [w if rnd.random() > 0.005 else "new" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "short text"), (4, " ".join(words[:100_000]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
