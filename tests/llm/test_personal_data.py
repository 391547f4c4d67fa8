"""The field on texts of another source than its labelled lines, and parts with many zeros."""

import os
import re

import pyarrow.parquet as pq
import pytest

from stratum.llm import pii
from stratum.llm.text import text_blocks

DOCS = "/root/testdata/sf0.01/documents.parquet"
SECRETS = re.compile(r'AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}|token = "[0-9a-f]{40}"')


def test_leading_zeros_of_an_address():
    zeros = "0" * 1500
    for text, n in ((f"{zeros}1.2.3.4", 1), (f"1.2.3.{zeros}255", 1), (f"1.2.3.{zeros}256", 0), ("1.2.3.1000", 0), (f"9{zeros}.1.1.1", 0), (f"{zeros}.0.0.0", 1)):
        assert len(pii.base_spans(text)["ip"]) == n, text[-20:]


@pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables")
def test_field_alone_on_the_documents_table():
    texts = pq.read_table(DOCS, columns=["text"])["text"].combine_chunks()
    found, crf = {}, pii.model()
    for at, buf, offs in text_blocks(texts, 1 << 20, 4096):
        for i, kind, a, b in pii.field_spans(crf, buf, offs):
            found.setdefault(at + i, []).append((kind, a, b))
    gold, hit, true, spans = {"email": 0, "phone": 0, "secret": 0}, {"email": 0, "phone": 0, "secret": 0}, 0, 0
    for i, text in enumerate(texts.to_pylist()):
        base = pii.base_spans(text or "")
        want = [(k, *s) for k in ("email", "phone") for s in base[k]] + [("secret", *m.span()) for m in SECRETS.finditer(text or "")]
        for k, a, b in want:
            gold[k] += 1
            hit[k] += any(k == kind and x < b and a < y for kind, x, y in found.get(i, ()))
        everything = want + [(k, *s) for k in ("ip", "card") for s in base[k]]
        for _, x, y in found.get(i, ()):
            spans += 1
            true += any(x < b and a < y for _, a, b in everything)
    print(gold, hit, spans, true)
    assert gold["secret"] >= 10 and hit["secret"] >= 0.95 * gold["secret"] and hit["phone"] >= 0.9 * gold["phone"] and hit["email"] >= 0.5 * gold["email"]
    assert true >= 0.97 * spans


def test_a_very_long_text_and_clashing_names(spark):
    long = "word " * 300_000 + "a@b.example.com " + "x" * 200_000
    docs = spark.createDataFrame([(1, long, 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, spans int, `a.b` int, n_chars int")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert got[1]["n_email"] == 1 and "email:1500000:1500015" in got[1]["spans"] and got[2]["spans"] == ""
    clean = pii.redact(docs, length_col="n_chars").collect()
    assert pii.redact(docs).columns == docs.columns and [r["n_chars"] for r in sorted(clean, key=lambda r: r["doc_id"])] == [len(long) - 15 + 7, None]
