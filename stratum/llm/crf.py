"""A linear-chain conditional random field over word shapes, in numpy.

A token is a maximal run without white space.  Its features are indices into weight tables,
computed for a whole block of text at once: the shape of the token, the hashed lower-case
word, its first character's class and those of its neighbours.  Training is gradient ascent on
the penalised log-likelihood of a small labelled table; decoding is Viterbi over all lines of a
block together, one step for each token position, with short lines dropping out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .text import U, mix, word_hashes, word_spans

LABELS = ("O", "B-secret", "I-secret", "B-phone", "I-phone", "B-email", "I-email")
HASH_BITS = 10
_KIND = np.full(256, 6, dtype=np.int64)  # other punctuation
_KIND[48:58] = 1  # digit
_KIND[97:123] = 2  # lower
_KIND[65:91] = 3  # upper
_KIND[128:] = 2  # a letter, mostly
_KIND[[64]] = 4  # @
_KIND[[46, 44, 59, 33, 63]] = 0  # sentence marks
_KIND[[43, 45, 40, 41, 95, 61, 58, 34, 39, 47]] = 5  # joins: + - ( ) _ = : " ' /
#: Counters of the kinds digit, lower, upper, @, join and other, ten bits each.
_COUNTER = np.array([0 if k == 0 else 1 << (10 * (k - 1)) for k in _KIND.tolist()], dtype=np.uint64)
#: Sizes of the feature tables, in order.
SHAPES = 1 << 12
TABLES = (SHAPES, 1 << HASH_BITS, 64, SHAPES, SHAPES, 1 << HASH_BITS, 1 << HASH_BITS, 64)
OFFSETS = np.concatenate(([0], np.cumsum(TABLES)))


def _buckets(n: np.ndarray) -> np.ndarray:
    """0, 1, 2-3, 4 and more."""
    return np.minimum(n, 1) + (n > 1) + (n > 3)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, line of each token, feature rows) of all tokens of a block.

    Lines end at line breaks and texts.  Columns of the feature rows follow ``TABLES``.
    """
    starts, ends, counts = word_spans(buf, offs)
    if not len(starts):
        return starts, ends, starts, np.zeros((0, len(TABLES)), np.int64)
    # one running sum holds six counters of ten bits; a token of over 1023 characters may blur its shape
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_COUNTER[buf], dtype=U)))
    packed = sums[ends] - sums[starts]
    exact = [((packed >> U(10 * k)) & U(1023)).astype(np.int64) for k in range(6)]
    digit, lower, upper, at, join, other = map(_buckets, exact)
    length = ends - starts
    size = np.searchsorted([4, 8, 16], length, "right")
    shape = ((((((digit * 4 + lower) * 2 + np.minimum(upper, 1)) * 2 + np.minimum(at, 1)) * 4 + join) * 2 + np.minimum(other, 1)) * 4 + size) % SHAPES
    coarse = (digit > 0) + 2 * (lower + upper > 0) + 4 * (length >= 16) + 8 * (upper > 1) + 16 * (lower > 1) + 32 * (join > 0)
    h = (mix(word_hashes(buf, starts, ends) ^ U(77)) >> U(64 - HASH_BITS)).astype(np.int64)
    ends_in = _KIND[buf[starts]] * 8 + _KIND[buf[ends - 1]]
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))[starts]
    text = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    line = np.cumsum(new) - 1
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    hb, ha = np.zeros_like(h), np.zeros_like(h)
    same = ~new[1:]
    before[1:], after[:-1] = np.where(same, shape[:-1], 0), np.where(same, shape[1:], 0)
    hb[1:], ha[:-1] = np.where(same, h[:-1], 0), np.where(same, h[1:], 0)
    return starts, ends, line, np.stack([shape, h, ends_in, before, after, hb, ha, coarse], axis=1)


@dataclass
class Crf:
    """Weights of features (one row for each, a column for each label), transitions and starts."""

    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.weights.shape[1]), dtype=self.weights.dtype)
        for c in range(rows.shape[1]):
            out += self.weights[OFFSETS[c] + rows[:, c]]
        return out

    def viterbi(self, scores: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best label of each token, lines apart (``line`` ascends)."""
        n, k = scores.shape
        if not n:
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((n, k), dtype=np.int8)
        best = scores[first] + self.begin
        live = len(first)
        final = np.zeros(n, dtype=np.int64)
        last = np.zeros((len(first), k), dtype=scores.dtype)
        for t in range(1, int(length[0]) + 1):
            go = int(np.searchsorted(-length, -t, "left"))  # lines longer than t
            last[go:live] = best[go:live]
            if not go:
                break
            live, step = go, best[:go, :, None] + self.moves[None]
            back[first[:go] + t] = step.argmax(1)
            best = step.max(1) + scores[first[:go] + t]
        label = last.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            go = int(np.searchsorted(-length, -t, "left"))
            at = first[:go] + t
            final[at] = label[:go]
            if t:
                label[:go] = back[at, label[:go]]
        return final

    def decode(self, rows: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Labels of all tokens.

        A line whose every token prefers O by more than any path could regain is all O; the
        others, in whole, go through Viterbi.
        """
        scores = self.scores(rows)
        gain = float(self.moves.max() - self.moves.min() + self.moves.max() - self.moves.min() + self.begin.max() - self.begin.min())
        doubt = scores[:, 1:].max(1) + gain >= scores[:, 0]
        out = np.zeros(len(rows), dtype=np.int64)
        if doubt.any():
            open_ = np.zeros(int(line[-1]) + 1, dtype=bool)
            open_[line[doubt]] = True
            use = np.flatnonzero(open_[line])
            out[use] = self.viterbi(scores[use], line[use])
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(lines: Sequence[tuple[str, Sequence[int]]], rounds: int = 80, rate: float = 0.5, penalty: float = 1e-3) -> Crf:
    """Fit by full-batch adaptive gradient steps on (line, label of each token) rows."""
    blobs = [text.encode() for text, _ in lines]
    offs = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
    _, _, line, rows = features(np.frombuffer(b"".join(blobs), np.uint8), offs)
    gold = np.concatenate([np.asarray(y, dtype=np.int64) for _, y in lines])
    if len(gold) != len(line):
        raise ValueError("labels don't match tokens")
    k = len(LABELS)
    model = Crf(np.zeros((OFFSETS[-1], k)), np.zeros((k, k)), np.zeros(k))
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    length = np.diff(np.append(first, len(line)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    square = [np.full_like(p, 1e-8) for p in (model.weights, model.moves, model.begin)]
    pairs = np.flatnonzero(line[1:] == line[:-1])
    for _ in range(rounds):
        scores = model.scores(rows)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[first] = scores[first] + model.begin
        for t in range(1, int(length[0])):
            at = first[: int(np.searchsorted(-length, -t, "left"))] + t
            alpha[at] = scores[at] + _log_sum(alpha[at - 1][:, :, None] + model.moves[None], 1)
        for t in range(int(length[0]) - 2, -1, -1):
            at = first[: int(np.searchsorted(-length, -(t + 1), "left"))] + t
            beta[at] = _log_sum(model.moves[None] + (scores[at + 1] + beta[at + 1])[:, None, :], 2)
        total = np.zeros(int(line[-1]) + 1)
        ends = first + length - 1
        total[line[ends]] = _log_sum(alpha[ends], 1)
        chance = np.exp(alpha + beta - total[line][:, None])
        error = -chance
        error[np.arange(len(gold)), gold] += 1
        grad = np.zeros_like(model.weights)
        for c in range(rows.shape[1]):
            low, high = OFFSETS[c], OFFSETS[c + 1]
            for y in range(k):
                grad[low:high, y] += np.bincount(rows[:, c], error[:, y], high - low)
        joint = np.exp(alpha[pairs][:, :, None] + model.moves[None] + (scores[pairs + 1] + beta[pairs + 1])[:, None, :] - total[line[pairs]][:, None, None])
        moves = -joint.sum(0)
        np.add.at(moves, (gold[pairs], gold[pairs + 1]), 1)
        for p, g, s in zip((model.weights, model.moves, model.begin), (grad, moves, error[first].sum(0)), square, strict=True):
            g = g - penalty * len(gold) * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return Crf(model.weights.astype(np.float32), model.moves.astype(np.float32), model.begin.astype(np.float32))
