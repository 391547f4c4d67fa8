"""Token ids, packing and token files against the tokenizer itself and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stratum.llm import packing, token_files
from stratum.llm.tokens import default_vocabulary, encoded

TOKENIZER = Tokenizer.from_file(default_vocabulary())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs(spark, rows):
    return spark.createDataFrame([(7, t, i, "s") for i, t in rows], "start int, text string, doc_id long, piece string").repartition(2)


def some_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta,", "Gamma.", "déjà", "日本語", "1234", "don't", "it's", "x\n\ny", " ", "<|endoftext|>"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 50, 300, 3000])))) for k in range(60)]
    return [*rows, (100, None), (101, ""), (102, "a"), (102, "a"), (None, "null id"), (103, "z" * 9000)]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9.!'\n\t é日😀 \x1c")), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizers(texts):
    got = [x.tolist() for _, x in encoded(pa.array(texts, pa.string()), default_vocabulary())]
    assert got == [ids_of(t) for t in texts]


def test_packing(spark):
    rows = some_rows()
    got = packing.pack_documents(docs(spark, rows), cap=256).collect()
    want = sorted((str(i), crc(ids_of(t)), len(ids_of(t))) for i, t in rows)
    by_place, pieces = {}, {}
    for r in got:
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"]), []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_place.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 256
    texts = dict(rows)
    for i, own in pieces.items():
        if i == 102:
            assert sorted(own) == sorted([(0, 0, 2, crc(ids_of("a")))] * 2)
            continue
        ids, own = ids_of(texts[i]), sorted(own)
        assert [p for p, *_ in own] == list(range(len(own))) and all(c == crc(ids[s : s + n]) for _, s, n, c in own)
        assert sum(n for _, _, n, _ in own) == len(ids) and (len(own) == 1 or all(n == 256 for _, _, n, _ in own[1:]))
    assert sum(r["length"] for r in got) == sum(n for *_, n in want)
    assert len(by_place) <= 1.02 * sum(n for *_, n in want) / 256 + 1


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_local_search_keeps_items_and_never_adds_bins(lengths):
    first = packing.best_fit(lengths, 40)
    bins = packing.local_search([list(b) for b in first], lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins) and len(bins) <= len(first)


def test_local_search_exchanges():
    lengths = [6, 6, 4, 3, 1]
    assert len(packing.local_search([[0, 3], [1], [2, 4]], lengths, 10)) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).collect() == [] and token_files.token_file_round_trip(none).collect() == []


@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 50_256, 65_535, 65_536, 1 << 24, (1 << 32) - 1]), max_size=700), max_size=4))
@settings(max_examples=40, deadline=None)
def test_token_file(lists):
    arrays = [np.array(x, np.uint32) for x in lists]
    names = [None if k == 1 else k * 7 - 3 for k in range(len(lists))]
    file = token_files.TokenFile(token_files.encode_file(names, arrays))
    flat = [x for own in lists for x in own]
    assert file.doc_ids == names and file.tokens().tolist() == flat and file.ends.tolist() == np.cumsum([len(x) for x in lists]).tolist()
    assert [file[i] for i in range(0, len(flat), 13)] == flat[::13]
    with pytest.raises(IndexError):
        file[len(flat)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    rows = some_rows()
    got = sorted(((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in token_files.token_file_round_trip(docs(spark, rows)).collect()))
    start = 0
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for (at, n, i, c), (j, t) in zip(got, want, strict=True):
        ids = ids_of(t)
        assert (at, n, i, c) == (start, len(ids), j, crc(ids))
        start += n


def test_the_search_lowers_the_count_through_the_operator(spark, monkeypatch):
    # best fit in falling order leaves a bin too many here; exchanges between underfull bins save it
    found = None
    for seed in range(400):
        rnd = random.Random(seed)
        lengths = [rnd.randrange(20, 70) for _ in range(14)]
        plain = packing.best_fit(lengths, 128)
        better = [b for b in packing.local_search([list(b) for b in plain], lengths, 128) if b]
        if len(better) < len(plain):
            found = lengths, len(better)
            break
    assert found
    lengths, fewest = found
    rows = [(k, " a" * (n - 1)) for k, n in enumerate(lengths)]
    assert [len(ids_of(t)) for _, t in rows] == lengths
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), cap=128).collect()
    assert len({r["sequence_id"] for r in got}) == fewest


def test_long_texts_and_clashing_names(spark):
    long = "word, another " * 60_000
    rows = spark.createDataFrame([(1, long, 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, `a.b` int, open int, mark int")
    want = {1: (len(ids_of(long)), crc(ids_of(long))), 2: (1, crc([0]))}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_round_trip(rows).collect()} == want
    packed = packing.pack_documents(rows).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == want[1][0] and max(r["length"] for r in packed) <= 2048
