"""Pairs whose whole shingle sets fill few ranges share a signature and link."""

import numpy as np
import pytest

from stratum.llm import text
from stratum.llm.jaccard_join import RANGE_MANY, Signer, ngram_jaccard_components

U = np.uint64


def block_of(texts):
    data = [t.encode() for t in texts]
    return text.shingle_keys(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in data]))))


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_linked_sets_share_a_whole_set_signature(threshold):
    rnd = np.random.default_rng(5)
    missed = pairs = 0
    for _ in range(30):
        sets = []
        for _ in range(500):
            size = int(rnd.integers(4, 24))
            a = rnd.integers(0, 1 << text.ID_BITS, size, dtype=np.uint64)
            sets += [a, rnd.permutation(a)[: -(-threshold * size // 100)]]
        keys = np.concatenate([np.sort(s) | (U(k) << U(text.ID_BITS)) for k, s in enumerate(sets)])
        sigs, docs, _ = Signer(np.zeros(0, U), 7, threshold).sign(keys, np.array([len(s) for s in sets]), RANGE_MANY, True)
        own = [set() for _ in sets]
        for s, d in zip(sigs.tolist(), docs.tolist(), strict=True):
            own[d].add(s)
        pairs += len(sets) // 2
        missed += sum(not own[k] & own[k + 1] for k in range(0, len(sets), 2))
    assert (missed, pairs) == (0, 15_000)


def test_copies_of_a_short_text_link_with_those_of_its_truncation(spark):
    # nine words, five shingles, all in one of the band's three ranges
    for k in range(2000):
        words = [f"w{k}x{i}" for i in range(9)]
        ids = block_of([" ".join(words)]) & text.ID_MASK
        if len({(int(x) >> (text.ID_BITS - 32)) * 3 >> 32 for x in ids}) == 1:
            break
    else:
        raise AssertionError("no such text")
    rows = [(i, " ".join(words if i < 30 else words[:8])) for i in range(60)]
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 5 if i < 30 else 4, 0) for i in range(60)]
