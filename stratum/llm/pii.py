"""Personal data in texts: fixed patterns, plus spans from a conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship
from .crf import LABELS, Crf, features, train
from .text import text_blocks

KINDS = ("email", "ip", "card", "phone", "secret")
# Fixed patterns; each is the listed one, anchored where its leftmost match must begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            done = hit.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each fixed kind that pass its check."""
    out: dict[str, list[Span]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        # leading zeros add nothing, however many; int() wouldn't take very long parts
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out["phone"].append(m.span())
    return out


def labelled_lines(count: int = 1500, seed: int = 7) -> list[tuple[str, list[int]]]:
    """The small labelled table: made-up lines of words in several styles, some with personal data."""
    rnd = random.Random(seed)
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = "the re on er an tion ly ed ha en ou que le aux ge sch keit ado para ción é ü".split()

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def some(alphabet: str, n: int) -> str:
        return "".join(rnd.choice(alphabet) for _ in range(n))

    def digits(n: int) -> str:
        return some("0123456789", n)

    def entity() -> tuple[str, list[str]]:
        value = rnd.choice([some(hexes, rnd.choice([16, 18, 20, 24, 32, 40, 64])), some(upper + upper.lower(), rnd.randint(20, 40))])
        kind = rnd.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
        if kind == 0:
            return "AKIA" + some(upper, 16), ["secret"]
        if kind == 1:
            return rnd.choice(["password", "passwd", "pwd", "secret", "api_key", "token"]) + rnd.choice("=:") + value, ["secret"]
        if kind == 2:
            return f'{rnd.choice(["token", "secret", "api_key", "key", "password"])} {rnd.choice("=:")} "{value}"', ["secret"] * 3
        if kind == 3:
            return rnd.choice(["sk-", "ghp_", "xoxb-", ""]) + value + "0f", ["secret"]
        if kind == 4:
            return f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", ["phone"] * 3
        if kind == 5:
            return f"({digits(3)}) {digits(3)}-{digits(4)}", ["phone"] * 2
        if kind == 6:
            return f"{digits(3)}-{digits(3)}-{digits(4)}", ["phone"]
        if kind == 7:
            return f"{word()}.{digits(2)}@mail{digits(1)}.example.com", ["email"]
        return f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", ["phone"] * 4

    def plain() -> str:
        return rnd.choice([word(), word(), word(), word(), word().title(), word().upper(), f"{digits(1)}.{digits(1)}", digits(rnd.randint(1, 5)), f"version {digits(1)}.", f"{digits(4)}-{digits(2)}-{digits(2)}", "|", f"https://{word()}.example.com/{word()}", f"({digits(1)})", f"{digits(1)}%", word() + "-" + word(), f"{digits(1)}.{digits(2)}.{digits(1)}", "CC BY-NC 4.0", "2.0 Licence", f'"{word()}"', f"{word()} = {word()}", f"{word()}: {word()}", "token", "password", "key"])

    out = []
    for _ in range(count):
        ending = rnd.choice(["", "", "", "", "!!", "***", "$$$", "%%%", "###", "&&&"])
        tokens: list[tuple[str, str | None, bool]] = []
        for _ in range(rnd.randint(1, 14)):
            if rnd.random() < 0.12:
                text, kinds = entity()
                tail = rnd.choice(["", "", "", ",", "."]) if not ending else ending
                parts = (text + tail).split(" ")
                tokens += [(p, k, i == 0) for i, (p, k) in enumerate(zip(parts, kinds, strict=True))]
            else:
                tokens += [(w, None, False) for w in (plain() + rnd.choice(["", "", "", ",", "."]) + ending).split(" ")]
        out.append((" ".join(t for t, _, _ in tokens), [LABELS.index(f"{'B' if b else 'I'}-{k}") if k else 0 for _, k, b in tokens]))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    """The field fitted to the labelled table; the same on every run."""
    return train(labelled_lines())


_STRIP = b".,;:!?*$%#&|<>"


def field_spans(crf: Crf, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, kind, start, end) in code points of the spans the field finds in a block."""
    starts, ends, line, rows = features(buf, offs)
    labels = crf.decode(rows, line)
    found = np.flatnonzero(labels)
    if not len(found):
        return []
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    text = np.searchsorted(offs, starts[found], "right") - 1
    out, k = [], 0
    data = buf.tobytes()
    while k < len(found):
        i, kind, own = found[k], LABELS[labels[found[k]]][2:], text[k]
        k += 1
        while k < len(found) and found[k] == found[k - 1] + 1 and line[found[k]] == line[i] and LABELS[labels[found[k]]] == f"I-{kind}":
            k += 1
        a, b = int(starts[i]), int(ends[found[k - 1]])
        while b > a and data[b - 1] in _STRIP:
            b -= 1
        while a < b and data[a] in _STRIP:
            a += 1
        if b > a:
            out.append((int(own), kind, int(points[a] - points[offs[own]]), int(points[b] - points[offs[own]])))
    return out


def all_spans(crf: Crf, column: pa.Array) -> Iterator[tuple[int, str, dict[str, list[Span]], list[tuple[str, int, int]]]]:
    """(row, text, base spans, all spans) of each text; spans of the field that touch a base span give way."""
    for at, buf, offs in text_blocks(column, 1 << 20, 4096):
        texts = column.slice(at, len(offs) - 1).to_pylist()
        extra: dict[int, list[tuple[str, int, int]]] = {}
        for i, kind, a, b in field_spans(crf, buf, offs):
            extra.setdefault(i, []).append((kind, a, b))
        marks = np.add.reduceat(np.append(((buf >= 48) & (buf <= 57)) | (buf == 64), False), np.minimum(offs[:-1], len(buf))) if len(buf) else np.zeros(len(texts))
        for i, text in enumerate(texts):
            text = text or ""
            base = base_spans(text) if text and marks[i] else {k: [] for k in KINDS[:4]}
            spans = [(k, a, b) for k, own in base.items() for a, b in own]
            spans += [s for s in extra.get(i, ()) if all(s[2] <= a or s[1] >= b for _, a, b in spans)]
            yield at + i, text, base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs``.

    Counts and digest are of the base spans; ``spans`` has those of the field too, as
    kind:start:end in code points by kind, then start.  A null or empty text has none; very long
    texts are read whole; null ids and repeated rows are kept as they are; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    crf = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for _, _, base, found in all_spans(crf.value, batch.column(1)):
                counts.append([len(base[k]) for k in KINDS[:4]])
                digests.append(hashlib.sha256(_joined([(k, a, b) for k in KINDS[:4] for a, b in base[k]]).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>``; ``length_col``, if given, counts anew.

    Null texts stay null; very long ones are read whole; all other columns, whatever their names,
    and all rows are kept; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    crf = spark.sparkContext.broadcast(model())
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = row.flatten()
            column = columns[at]
            null = column.is_null().to_pylist()
            out = [None if null[i] else redacted(text, spans) for i, text, _, spans in all_spans(crf.value, column)]
            columns[at] = pa.array(out, column.type)
            if length_col is not None:
                j = names.index(length_col)
                columns[j] = pa.array([None if x is None else len(x) for x in out], columns[j].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], ["row"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))  # names with dots can't be passed one by one
    return rows.mapInArrow(run, rows.schema).select("row.*")
