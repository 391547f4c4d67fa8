"""Byte-level BPE by ranks against the tiktoken library, and the same code points through the tokenizers library."""

import base64
import hashlib
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Regex, Tokenizer, pre_tokenizers

from stratum.llm import bpe, tokens
from stratum.llm.text import text_blocks

with open(bpe.default_ranks(), "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(tokens.default_vocabulary())
ENCODER = bpe.RankEncoder(bpe.default_ranks())
#: Code points that tables of different Unicode versions class apart, and what may stand beside them.
ODD = ["\U00018e20", "\U0003267e", "\U0003d661", "՘", "࢏", "\U00011de3"]
BESIDE = ["'s", "'ll", " ", "\n", "\t", "a", "Z", "9", ".", "'", " ", "　", "\x1c", "é", "日", "<|endoftext|>"]


def lists(enc, texts):
    out = []
    for _, buf, offs in text_blocks(pa.array(texts, pa.string()), 1 << 16, 1 << 30):
        ids, ends = enc.encode_block(buf, offs)
        out += [x.tolist() for x in np.split(ids, ends)[: len(ends)]]
    return out


def random_texts(n, seed):
    rnd = random.Random(seed)

    def one():
        if (k := rnd.random()) < 0.3:
            return rnd.choice(BESIDE + ODD)
        c = rnd.randrange(0x110000 if k < 0.7 else 0x3000)
        return "" if 0xD800 <= c < 0xE000 else chr(c)

    return ["".join(one() for _ in range(rnd.randrange(1, 9))) for _ in range(n)]


def test_ids_of_all_planes_equal_both_libraries():
    texts = random_texts(8_000, 11)
    assert lists(ENCODER, texts) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert lists(tokens.Encoder(tokens.default_vocabulary()), texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_classes_of_known_code_points_are_the_libraries():
    """Every code point that isn't sent to the library's own splitter has the class that both tables give it."""
    import regex

    known = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co"))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        library = {c for x, _ in pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(known) for c in x}
        assert library == set(regex.findall(name, known))
        assert name != r"\p{L}" or library == {c for c in known if c.isalpha()}


@given(st.lists(st.lists(st.sampled_from(BESIDE + ODD), max_size=12).map("".join), max_size=8))
@settings(max_examples=80, deadline=None)
def test_pieces_beside_odd_code_points(texts):
    assert lists(ENCODER, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def plain_merge(piece, ranks):
    """The merges as stated: every round looks at all pairs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@given(st.dictionaries(st.text("abc", min_size=2, max_size=5), st.integers(0, 20), max_size=20), st.text("abc", min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_segment_tree_merges_like_the_plain_rule(tokens_, piece):
    """Ranks may tie here, where the leftmost pair goes first."""
    ranks = {b"a": 100, b"b": 101, b"c": 102} | {t.encode(): r for t, r in tokens_.items()}
    piece = piece.encode()
    assert bpe.merged(piece, ranks) == ([ranks[piece]] if piece in ranks else plain_merge(piece, ranks))


@given(st.lists(st.text("abcd", min_size=2, max_size=5), unique=True, max_size=25), st.lists(st.text("abcd", min_size=1, max_size=64), min_size=1, max_size=12))
@settings(max_examples=80, deadline=None)
def test_trees_side_by_side_merge_like_the_plain_rule(tokens_, pieces):
    ranks = {t.encode(): r for r, t in enumerate(tokens_)} | {bytes([b]): 1000 + b for b in range(256)}
    ids, ends = bpe.Forest(ranks).merged([p.encode() for p in pieces])
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [plain_merge(p.encode(), ranks) for p in pieces]


def test_long_pieces_take_about_n_log_n_steps():
    rnd = random.Random(4)
    piece = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    assert bpe.merged(piece, RANKS) == LIBRARY.encode_ordinary(piece.decode())

    def steps(n):
        """Looks at the ranks, of which each merge makes two at most."""
        count = 0

        class Counted(dict):
            def get(self, key):
                nonlocal count
                count += 1
                return RANKS.get(key)

        bpe.merged(piece[:n], Counted(RANKS))
        return count

    assert steps(20_000) <= 3 * 20_000 and sys.getrecursionlimit() < 20_000


def test_operator(spark):
    texts = [(1, None), (2, ""), (3, "It's 3 o'clock,\n\n  déjà vu 日本語 😀 <|endoftext|>"), (3, "It's 3 o'clock,\n\n  déjà vu 日本語 😀 <|endoftext|>"), (None, "\U0003d661's"), (5, "x" * 40_000 + " end " * 9000)]
    docs = spark.createDataFrame([(t, i, b"z", 7) for i, t in texts], "text string, doc_id long, ids binary, row int").repartition(3)
    got = bpe.round_trip(docs).collect()
    assert sorted((str(r["row"]["doc_id"]), r["ids"]) for r in got) == sorted((str(i), LIBRARY.encode_ordinary(t or "")) for i, t in texts)
    assert all(bytes(r["decoded"]) == (r["row"]["text"] or "").encode() and r["row"]["row"] == 7 for r in got)
    again = bpe.decode(bpe.encode(docs, columns=["doc_id"])).collect()
    assert sorted((str(r["row"]["row"]["doc_id"]), bytes(r["decoded"])) for r in again) == sorted((str(i), (t or "").encode()) for i, t in texts)
    assert bpe.round_trip(docs.limit(0)).collect() == [] and bpe.decode(docs.limit(0).selectExpr("array(1) as ids")).collect() == []
    with pytest.raises(Exception, match="doesn't have"):
        bpe.decode(spark.createDataFrame([([70_000],)], "ids array<int>")).collect()


def test_query_digests(spark, tmp_path):
    from stratum.llm.queries import op11_byte_pair_encoding

    texts = [(1, None), (2, "a b"), (3, "\U0003d661's " + "long " * 3000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(ids := LIBRARY.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in texts}
    assert {r["doc_id"]: tuple(r)[1:] for r in op11_byte_pair_encoding(spark, str(tmp_path)).collect()} == want
