"""Texts that spell an added token of the vocabulary file, against the tokenizer as loaded."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stratum.llm import packing, token_files
from stratum.llm.tokens import default_vocabulary, encoded

TOKENIZER = Tokenizer.from_file(default_vocabulary())
END = "<|endoftext|>"


def ids_of(text):
    return [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]


def ids(texts):
    return [x.tolist() for _, x in encoded(pa.array(texts, pa.string()), default_vocabulary())]


def test_an_added_token_has_its_own_id():
    assert ids([f"a {END} b"]) == [[64, 220, 50256, 275, 0]]


def test_an_added_token_never_crosses_texts():
    texts = ["x <|endo", "ftext|> y", END, "", END + END, "<|endoftext", "|>"]
    assert ids(texts) == [ids_of(t) for t in texts]


@given(st.lists(st.lists(st.sampled_from([END, "<|endoftext", "|>", "a", "Z9", " ", "\n", "\t", "é", "日", "😀", ".", "'s", "\x1c", "　"]), max_size=14).map("".join), max_size=8))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_loaded_tokenizers(texts):
    assert ids(texts) == [ids_of(t) for t in texts]


def test_operators(spark):
    texts = {k: " word," * (40 * k) + END + "\n next" * k for k in range(6)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(2)
    crc = {k: zlib.crc32(np.array(ids_of(t), "<u4").tobytes()) for k, t in texts.items()}
    files = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_round_trip(docs).collect()}
    assert files == {k: (len(ids_of(t)), crc[k]) for k, t in texts.items()}
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs, cap=2048).collect()}
    assert packed == files
