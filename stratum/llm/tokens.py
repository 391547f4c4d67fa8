"""Byte-level BPE ids of whole texts, by way of each distinct piece.

A text is cut where the tokenizer's own pre-tokenisation always cuts: before white space that
follows a visible character, and after a single line break.  Each distinct piece of a block is
then encoded once, by the model of the ``tokenizers`` library, and remembered while it is
frequent; the ids are the same as those of the whole text.  The tokenizer file's added tokens
(``<|endoftext|>``) are cut out of a text first, as the tokenizer does, and stand for their own ids.

Words are split by ``regex``, whose tables of letters and numbers are of another Unicode version than
the library's.  Code points that Python's older table doesn't know may be classed apart, so a piece
that holds one is split by the library's own pre-tokeniser.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import text_blocks

# The byte alphabet of byte-level BPE.  Printable bytes stand for themselves, the others for 256 and up in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
#: Pieces and words kept by a worker between blocks.
KEEP_PIECES, KEEP_WORDS = 250_000, 150_000
BLOCK_BYTES = 8 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_loaded: dict[tuple[type, str], Encoder] = {}
_unknown: list[tuple[str, int]] = []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unassigned() -> tuple[str, int]:
    """A character class of the code points that Python's Unicode table leaves unassigned, and the first byte of the first of them."""
    if not _unknown:
        import unicodedata

        free = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8))).reshape(-1, 2)
        _unknown.append(("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist()) + "]", chr(edges[0, 0]).encode()[0]))
    return _unknown[0]


class Encoder:
    def __init__(self, path: str) -> None:
        import json
        import re

        import regex
        from tokenizers import models, pre_tokenizers

        file = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model, added = file["model"], file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at what stands around them are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        narrow = max([*model["vocab"].values(), *(t["id"] for t in added)], default=0) < 1 << 16
        self.code, self.dtype = ("H", np.uint16) if narrow else ("I", np.uint32)
        self.added = {t["content"].encode(): array(self.code, [t["id"]]).tobytes() for t in added}
        # the longest first: where several begin at one place, the tokenizer takes the longest
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        # Fixed value: the pre-tokenisation pattern of this vocabulary.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self._empty()

    def _empty(self) -> None:
        import re

        pattern, self.odd_from = unassigned()
        self.odd = re.compile(pattern).search
        self.pieces: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _odd(self, text: str) -> bytes:
        """Ids of a text with code points that tables of different versions may class apart."""
        return b"".join(array(self.code, [t.id for t in self.model.tokenize(plain)]).tobytes() for plain, _ in self.cut(text))

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():
                plain = word.replace(" ", "\u0120")
            else:
                plain = word.encode().decode("latin-1").translate(_ALPHABET)
            ids = self.known[word] = array(self.code, [t.id for t in self.model.tokenize(plain)]).tobytes()
        return ids

    def _added_spans(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the added tokens in a block's texts."""
        data = buf.tobytes()
        spans: list[tuple[int, int]] = []
        if any(t in data for t in self.added):
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                spans += [m.span() for m in self.find_added.finditer(data, i, j)]
        both = np.array(spans, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _encode(self, piece: bytes) -> bytes:
        if piece in self.added:
            return self.added[piece]
        text = piece.decode()
        if max(piece) >= self.odd_from and self.odd(text):
            return self._odd(text)
        if text[1:].isalpha() and text[0] == " ":
            return self._word(text)
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in ",.":
            return self._word(text[:-1]) + self._word(text[-1])
        return b"".join(map(self._word, self.words(text)))

    def _encode_all(self, pieces: list[bytes]) -> list[bytes]:
        get, encode = self.pieces.get, self._encode
        return [get(p) or encode(p) for p in pieces]

    def encode_block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids), of a block of UTF-8 texts."""
        n = len(buf)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offs) - 1, np.int64)
        space = _SPACE[buf]
        # visible: this byte surely ends a character that isn't white space; starts: it surely begins one
        lead = (buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3)
        visible = ((buf > 32) & (buf < 127)) | (buf >= 128)
        visible[1:] &= (buf[1:] < 128) | ~lead[:-1]
        visible[2:] &= (buf[2:] < 128) | ~lead[:-2]
        starts = ((buf > 32) & (buf < 127)) | ((buf >= 0xC3) & ~lead)
        cut = np.zeros(n, dtype=bool)
        cut[1:] = space[1:] & visible[:-1]
        cut[2:] |= starts[2:] & (buf[1:-1] == 10) & visible[:-2]
        begins, finish = self._added_spans(buf, offs)
        for i, j in zip(begins.tolist(), finish.tolist(), strict=True):
            cut[i:j] = False
        edges = np.concatenate((offs[:-1], begins, finish))
        edges = edges[edges < n]
        # cuts that look across the start of a text, or the edge of an added token, aren't sure
        for k in (0, 1):
            near = edges[edges + k < n] + k
            cut[near] = False
        cut[edges] = True
        bounds = np.append(np.flatnonzero(cut), n).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        which = pieces.indices.to_numpy()
        distinct = pieces.dictionary.to_pylist()
        ids = self._encode_all(distinct)
        often = np.bincount(which, minlength=len(distinct)) > 1
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        if len(self.pieces) > KEEP_PIECES:
            self.pieces.clear()
        self.pieces.update((distinct[i], ids[i]) for i in np.flatnonzero(often).tolist())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        begin = np.cumsum(sizes) - sizes
        own = sizes[which]
        ends = np.cumsum(own)
        at = np.repeat((begin[which] - (ends - own)).astype(np.int64), own)
        at += np.arange(len(at))
        first = np.searchsorted(bounds[:-1], offs[1:])
        return flat[at], np.concatenate(([0], ends))[first]


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encoded(column: pa.Array, path: str, end_id: int | None = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with ``end_id`` appended) of each text in order; a null text is empty."""
    enc = encoder(path)
    tail = [] if end_id is None else [np.array([end_id], np.uint32)]
    for at, buf, offs in text_blocks(column, BLOCK_BYTES, 1 << 30):
        ids, ends = enc.encode_block(buf, offs)
        begin = 0
        for k, end in enumerate(ends.tolist()):
            yield at + k, np.concatenate([ids[begin:end].astype(np.uint32), *tail])
            begin = end
