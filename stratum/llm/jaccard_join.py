"""N-gram Jaccard join by two-level PartEnum signatures.

Sizes are dealt into bands; a document is signed for its own band and, where its size allows a link
there, for the next, so two documents that can link share a band.  In a band the feature domain
(54-bit shingle ids) is partitioned into ``n1`` groups, each of them into three ranges, and the
subsets of two ranges of a group are enumerated: a signature is a hash of all of a document's
shingles in one such subset.  Two documents that reach the threshold differ in at most ``k``
shingles, so at most ``k // 2`` groups differ in two ranges or more; any other group has two equal
ranges, whose signature both share.  A signature of a subset without shingles says nothing and is
left out, so what counts is *rich* groups, those with two ranges or more that hold shingles: among
the first ``k // 2 + 1`` groups that are rich in either document, one has an equal range that isn't
empty.  A document therefore signs its groups, in the order of the domain, up to its rich group of
that number.

Shingles that stand in many documents (``common`` of them or more) would make signatures that
thousands share.  They are counted over all documents and left out of the signatures, which
loses nothing: leaving the same shingles out of both sets can only shrink the difference.  A
document with ``k // 2`` rich groups or fewer left is *plain*: pairs of two plain documents are
found by signatures over their whole sets instead.  Equal sets are one there; copies are attached
to their class at the end.  Where a whole set has too few rich groups too, it is also signed by its
first shingles in the order of the domain, as many as it may lack plus one, of which two sets that
reach the threshold share one.

Signatures that few documents share give pairs.  Those that many share, as near copies of one text
do, first link each member with the smallest; what the exact check leaves in different classes then
is compared in blocks, the members of the largest class only with those outside of it.

Links are decided by sizes of sets of 54-bit ids.  Two of the shingles of a pair of documents get
the same id with odds of about ``(shingles of both)**2 / 2**55``, 1 in 20 million for 20,000 each,
and one such clash shifts the sizes by one.  Equal sets are told by 128 bits of their ids' sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, free_shuffles, parts, ship, small
from .components import components
from .text import ID_BITS, ID_MASK, MAX_DOCS, U, mix, per_text, shingle_keys, text_blocks

#: Band width, shingles to a range at a band's lower end (without and with common shingles).
RHO, RANGE_FEW, RANGE_MANY = 1.95, 1.0, 4 / 3
#: Ranges to a group, and of them those that may differ; the subsets are of the others.
N2, K2 = 3, 1
SUBSETS = tuple(combinations(range(N2), N2 - K2))
#: Documents from which on a shingle is common; most common shingles sent to the executors.
COMMON, COMMON_MOST = 24, 2_000_000
#: Keys sent on in one go; documents to a block of a cohort.
FLUSH, BLOCK = 500_000, 256


def _domains(docs: DataFrame) -> int:
    """Bits of the number of domain slices: at least 128, and one for each input partition up to 65,536."""
    return min(16, max(7, math.ceil(math.log2(max(1, docs.rdd.getNumPartitions())))))


def _tasks(docs: DataFrame, bits: int) -> int:
    """Tasks that share the slices."""
    return min(1 << bits, max(parts(docs.sparkSession), 1 << (bits - 2)))


def _common(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """Sorted shortened ids (``bits + 32`` bits) of shingles in ``COMMON`` documents or more.

    Each task sends its sorted distinct keys as one binary a slice of the domain, repeats
    already counted, so a shingle that all documents share arrives once from each task.
    """
    shift = ID_BITS - bits - 32

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> U(shift), return_counts=True)
            held.clear()
            at = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=U) << U(32))
            once = counts == 1
            rows = [(p, keys[i:j][once[i:j]].astype(np.uint32).tobytes(), keys[i:j][~once[i:j]].astype(np.uint32).tobytes(), counts[i:j][~once[i:j]].astype(np.uint32).tobytes()) for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["p", "one", "many", "times"])

        for batch in batches:
            for _, buf, offs in text_blocks(batch.column(0)):
                keys = shingle_keys(buf, offs, n) & ID_MASK
                if len(keys):
                    held.append(keys)
                if sum(map(len, held)) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for p, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got.setdefault(p, []).append(tuple(blobs))
        for p, blobs in got.items():
            keys = np.frombuffer(b"".join(x for b in blobs for x in b[:2]), np.uint32)
            times = np.concatenate([y for b in blobs for y in (np.ones(len(b[0]) // 4, np.uint32), np.frombuffer(b[2], np.uint32))])
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sums = np.add.reduceat(times, first)
            hit = sums >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array((keys[first][hit].astype(np.int64) + (p << 32))), pa.array(sums[hit].astype(np.int64))], ["id", "times"])

    blobs = docs.select(F.col(f"`{text}`")).mapInArrow(send, "p int, one binary, many binary, times binary")
    found = blobs.repartition(_tasks(docs, bits), "p").mapInArrow(count, "id long, times long").persist()
    least, left = COMMON, 0
    steps = found.groupBy(F.floor(F.log2("times") * 8).cast("int").alias("step")).agg(F.count("*").alias("c"), F.min("times").alias("least")).orderBy(F.desc("step")).collect()
    for row in steps:
        if (left := left + row["c"]) > COMMON_MOST:
            break
        least = row["least"]
    else:
        least = COMMON
    ids = found.where(F.col("times") >= least).select("id").toArrow()["id"].to_numpy().astype(U)
    found.unpersist()
    return np.sort(ids)


class Signer:
    """Signatures of the texts of a block."""

    def __init__(self, common: np.ndarray, bits: int, threshold: int) -> None:
        self.common, self.shift, self.g, self.threshold = common, U(ID_BITS - bits - 32), threshold / 100, threshold
        self.bloom: np.ndarray | None = None

    def is_common(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=bool)
        if not len(self.common):
            return out
        if self.bloom is None:
            self.bloom = np.zeros(1 << 24, dtype=bool)
            self.bloom[(mix(self.common) >> U(40)).astype(np.int64)] = True
        short = ids >> self.shift
        maybe = np.flatnonzero(self.bloom[(mix(short) >> U(40)).astype(np.int64)])
        at = np.searchsorted(self.common, short[maybe])
        at[at == len(self.common)] = 0
        out[maybe] = self.common[at] == short[maybe]
        return out

    def sign(self, keys: np.ndarray, sizes: np.ndarray, per: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, their texts, texts with too few rich groups), from sorted keys; sizes of the whole sets.

        ``whole``: the keys are whole sets; those with too few rich groups are signed by single shingles too.
        """
        band = np.floor(np.log(np.maximum(sizes, 1)) / math.log(RHO) + 1e-9).astype(np.int64)
        docs, ids = (keys >> U(ID_BITS)).astype(np.int64), keys & ID_MASK
        all_sigs, all_docs, few = [], [], np.zeros(len(sizes), dtype=bool)
        for step in (0, 1):
            low = RHO ** (band + step)
            use = sizes > 0
            if step:
                use &= sizes / self.g + 1e-6 >= low
            most = (1 - self.g) / self.g * sizes
            if not step:
                most = np.minimum(most, (1 - self.g) / (1 + self.g) * (sizes + low * RHO))
            worst = np.floor(most + 1e-6).astype(np.int64) // (K2 + 1)  # groups that may differ in more than K2 ranges
            n1 = np.maximum(1, np.ceil(low / (N2 * per))).astype(np.int64)
            mine = use[docs]
            d, x = docs[mine], ids[mine]
            rich = np.zeros(len(sizes), dtype=np.int64)
            if len(d):
                j = ((x >> U(ID_BITS - 32)) * (N2 * n1[d]).astype(U)) >> U(32)
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (j[1:] != j[:-1]))))
                content = np.add.reduceat(mix(x), first)
                d, j = d[first], j[first].astype(np.int64)
                group, place = j // N2, j % N2
                start = np.concatenate(([True], (d[1:] != d[:-1]) | (group[1:] != group[:-1])))
                row = np.cumsum(start) - 1
                held, there = np.zeros((N2, row[-1] + 1), U), np.zeros((N2, row[-1] + 1), dtype=bool)
                held[place, row], there[place, row] = content, True
                d, group = d[start], group[start]
                more = there.sum(0) > K2
                rich = np.bincount(d, more, len(sizes)).astype(np.int64)
                before = np.cumsum(more) - more
                before -= np.append(0, np.cumsum(rich))[d]
                signed = before <= worst[d]
                for n, subset in enumerate(SUBSETS):
                    kept = signed & there[list(subset)].any(0)
                    tag = ((band[d[kept]] + step) << 34 | group[kept] * len(SUBSETS) + n).astype(U) | U(int(whole) << 60)
                    sig = mix(tag)
                    for r in subset:
                        sig = mix(sig ^ mix(held[r][kept]))
                    all_sigs.append(sig)
                    all_docs.append(d[kept])
            short = use & (rich <= worst)
            few |= short
            if whole and short[docs].any():
                lack = sizes - -(-self.threshold * sizes // 100)
                place = np.arange(len(docs)) - np.searchsorted(docs, np.arange(len(sizes)))[docs]
                kept = short[docs] & (place <= lack[docs])
                d = docs[kept]
                all_sigs.append(mix(mix(ids[kept]) ^ mix(((band[d] + step).astype(U) << U(34)) | U(2 << 60))))
                all_docs.append(d)
        if not all_sigs:
            return np.zeros(0, U), np.zeros(0, np.int64), few
        return np.concatenate(all_sigs), np.concatenate(all_docs), few


def _sketch(ids: np.ndarray, size: int) -> bytes:
    """Counts of a set's ids in 2^m ranges of the domain, about half as many as ids."""
    m = max(4, math.ceil(math.log2(max(1, size))) - 1)
    return np.minimum(np.bincount((ids >> U(ID_BITS - m)).astype(np.int64), minlength=1 << m), 255).astype(np.uint8).tobytes()


def _lists(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, starts) of a binary column of lists of numbers."""
    data, width = column.buffers()[2], np.dtype(dtype).itemsize
    starts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) // width
    values = np.frombuffer(data, dtype, (data.size if data is not None else 0) // width) if data is not None else np.zeros(0, dtype)
    return values, starts


def _could_link(a: pa.Array, b: pa.Array, threshold: int) -> np.ndarray:
    """False only where the sets behind two sketches can't reach the threshold."""
    (x, at), (y, to) = _lists(a, np.uint8), _lists(b, np.uint8)
    wide, high = np.diff(at), np.diff(to)
    out = np.ones(len(a), dtype=bool)
    for m, k in {*zip(wide.tolist(), high.tolist(), strict=True)}:
        rows, least = np.flatnonzero((wide == m) & (high == k)), min(m, k)
        for i in range(0, len(rows), 1024):
            some = rows[i : i + 1024]
            u, v = x[at[some][:, None] + np.arange(m)], y[to[some][:, None] + np.arange(k)]
            full = (u == 255).any(1) | (v == 255).any(1)
            u, v = (z.reshape(len(some), least, -1).sum(2, dtype=np.int64) for z in (u, v))
            both, apart = (u + v).sum(1), np.abs(u - v).sum(1)
            out[some] = full | (100 * (both - apart) >= threshold * (both + apart))
    return out


def _linked(a: pa.Array, b: pa.Array, threshold: int) -> np.ndarray:
    """Which pairs of sets of shingle ids reach the threshold."""
    (x, at), (y, to) = _lists(a, U), _lists(b, U)
    p, q = np.diff(at), np.diff(to)
    out, ends = np.zeros(len(a), dtype=bool), np.cumsum(p + q)
    i = 0
    while i < len(a):  # as many pairs at a time as hold a million ids
        j = min(max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")), i + 1), i + MAX_DOCS, len(a))
        owner = np.concatenate((np.repeat(np.arange(j - i, dtype=U), p[i:j]), np.repeat(np.arange(j - i, dtype=U), q[i:j])))
        keys = np.sort((owner << U(ID_BITS)) | np.concatenate((x[at[i] : at[j]], y[to[i] : to[j]])))
        inter = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> U(ID_BITS)).astype(np.int64), minlength=j - i)
        out[i:j] = (100 * inter >= threshold * (p[i:j] + q[i:j] - inter)) & (np.minimum(p[i:j], q[i:j]) > 0)
        i = j
    return out


def _where(pairs: DataFrame, test) -> DataFrame:  # noqa: ANN001
    """(a, b) of the rows (a, b, x, y) whose x and y pass ``test``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(test(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _features(docs: DataFrame, id_col: str, text: str, n: int, signer: Signer, bits: int) -> DataFrame:
    """One row for each document: size, sketch, signatures without common shingles; of plain ones print and whole-set signatures."""

    def lists(sigs: np.ndarray, owner: np.ndarray, texts: int) -> list[np.ndarray]:
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(texts + 1))
        return [sigs[order[i:j]] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, buf, offs in text_blocks(batch.column(1)):
                texts = len(offs) - 1
                keys = shingle_keys(buf, offs, n)
                sizes = per_text(keys, texts)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                x = keys & ID_MASK
                sigs, owner, few = signer.sign(keys[~signer.is_common(x)], sizes, RANGE_FEW, False)
                # what of a signature is looked at: its slice, and 32 bits after those of the slice
                light = [(s >> U(32 - bits)).astype(np.uint32).tobytes() + (s >> U(64 - bits)).astype(np.uint16).tobytes() for s in lists(sigs, owner, texts)]
                plain = np.flatnonzero(few & (sizes > 0))
                whole: list[np.ndarray | None] = [None] * texts
                prints: list[bytes | None] = [None] * texts
                if len(plain):
                    sigs, owner, _ = signer.sign(keys[few[(keys >> U(ID_BITS)).astype(np.int64)]], sizes, RANGE_MANY, True)
                    all_ = lists(sigs, owner, texts)
                    for i in plain:
                        own = x[ends[i] : ends[i + 1]]
                        whole[i] = np.unique(all_[i]).astype(np.int64)
                        prints[i] = np.array([mix(own).sum(), mix(mix(own)).sum()], U).tobytes()
                sketches = [_sketch(x[i:j], j - i) if j > i else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, texts), pa.array(sizes.astype(np.int64)), pa.array(sketches, pa.binary()), pa.array(light, pa.binary()), pa.array(prints, pa.binary()), pa.array(whole, pa.list_(pa.int64()))], ["id", "n_shingles", "sketch", "light", "print", "sigs"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`")).mapInArrow(run, "id long, n_shingles long, sketch binary, light binary, print binary, sigs array<long>")


def _pairs(feats: DataFrame, g: float, bits: int, tasks: int) -> DataFrame:
    """(a, b, wide): documents that share a signature without common shingles and whose sizes allow a link.

    Groups of more than ``2 * COMMON`` members exist only where the list of common shingles is
    cut off at ``COMMON_MOST``; they give (a, b) = (smallest member, member), with ``wide`` set.
    """
    reach = math.ceil(1000 * -math.log(g)) + 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            s, p, d, q = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((d, p))
            at = np.searchsorted(p[order], np.arange((1 << bits) + 1))
            s, d, q = s[order], d[order], q[order]
            # steps between sorted ids compress, ids don't
            rows = [(k, s[i:j].tobytes(), np.diff(d[i:j], prepend=0).tobytes(), q[i:j].tobytes()) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["p", "sig", "doc", "size"])

        waiting = 0
        for batch in batches:
            for i, size, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if m := len(blob) // 6:
                    held.append((np.frombuffer(blob, np.uint32, m), np.frombuffer(blob, np.uint16, m, 4 * m), np.full(m, i, np.int64), np.full(m, int(1000 * math.log(size)), np.uint16)))
                    waiting += m
                if waiting > FLUSH:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for p, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got.setdefault(p, []).append(tuple(blobs))
        found = []
        for p in list(got):
            blobs = got.pop(p)
            s, q = (np.frombuffer(b"".join(b[c] for b in blobs), t) for c, t in ((0, np.uint32), (2, np.uint16)))
            d = np.concatenate([np.cumsum(np.frombuffer(b[1], np.int64)) for b in blobs])
            order = np.lexsort((d, s))
            s, d, q = s[order], d[order], q[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            counts = np.diff(np.append(first, len(s)))
            size = np.repeat(counts, counts)
            wide = size > 2 * COMMON
            for step in range(1, min(int(counts.max()), 2 * COMMON)):
                i = np.flatnonzero((s[step:] == s[:-step]) & ~wide[step:])
                if not len(i):
                    break
                i = i[(d[i] != d[i + step]) & (np.abs(q[i] - q[i + step]) <= reach)]
                found.append(np.stack([d[i], d[i + step], np.zeros(len(i), np.int64)]))
            lead = np.repeat(d[first], counts)[wide]
            found.append(np.stack([lead, d[wide], np.ones(len(lead), np.int64)]))
            if sum(x.shape[1] for x in found) > FLUSH:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            for k in range(0, pairs.shape[1], 100_000):
                a, b, w = pairs[:, k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w == 1)], ["a", "b", "wide"])

    blobs = feats.where("id is not null and n_shingles > 0").select("id", "n_shingles", "light").mapInArrow(send, "p int, sig binary, doc binary, size binary")
    return blobs.repartition(tasks, "p").mapInArrow(match, "a long, b long, wide boolean").distinct()


def _sets(docs: DataFrame, id_col: str, text: str, n: int, wanted: DataFrame, rows: int) -> DataFrame:
    """(id, ids): whole shingle sets of the documents in ``wanted`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offs in text_blocks(batch.column(1)):
                keys = shingle_keys(buf, offs, n)
                ends = np.concatenate(([0], np.cumsum(per_text(keys, len(offs) - 1))))
                x = keys & ID_MASK
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offs) - 1), pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "ids"])

    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`")).join(small(wanted, rows), "id", "left_semi")
    return mine.mapInArrow(run, "id long, ids binary")


def _block_links(docs: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All links between two blocks of a cohort, or within one, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[col]
    owner, col = owner[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == side.max()))
    inter = np.zeros((len(left), len(right)), dtype=np.float64)
    row = np.full((2, len(sets)), -1)
    row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
    wide = 8192
    edges = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + 1 + wide, wide))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        mats = []
        for s, m in ((0, len(left)), (1, len(right))):
            mat = np.zeros((m, wide), dtype=np.float32)
            r = row[s, owner[i:j]]
            ok = r >= 0
            mat[r[ok], col[i:j][ok] - k * wide] = 1
            mats.append(mat)
        inter += mats[0] @ mats[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    hit = (100 * inter >= threshold * union) & (docs[left][:, None] != docs[right][None, :])
    a, b = np.nonzero(hit)
    return docs[left][a], docs[right][b]


def _cohort_links(sets: DataFrame, cohorts: DataFrame, threshold: int) -> DataFrame:
    """Links between the classes of each cohort, rows (component, node, class).

    The members of a cohort's largest class are compared with the others only, those with one another too.
    """
    each = cohorts.groupBy("component", "class").agg(F.count("*").alias("n"))
    main = each.groupBy("component").agg(F.max_by("class", F.struct("n", F.negative("class"))).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = cohorts.join(main.where("outside > 0"), "component").select("component", "node", (F.col("class") == F.col("main")).alias("in_main"), blocks("inside").alias("ins"), blocks("outside").alias("outs"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(node), case when in_main then ins else outs end) as int)"))
    # blocks of the others are numbered from 0, those of the main class from -1 down
    met = F.when(F.col("in_main"), F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(-F.col("ins"), F.col("outs") - 1))
    dealt = rows.select("component", F.col("node").alias("id"), F.when(F.col("in_main"), -1 - F.col("own")).otherwise(F.col("own")).alias("own"), F.explode(met).alias("other"))
    dealt = dealt.select("component", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def run(part: pa.Table) -> pa.Table:
        side = (part["own"].to_numpy() != part["i"].to_numpy()).astype(int)
        return _forest(*_block_links(part["id"].to_numpy(), side, [np.frombuffer(x, U) for x in part["ids"].to_pylist()], threshold))

    return dealt.join(sets, "id").groupBy("component", "i", "j").applyInArrow(run, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A star to the smallest member for each class that the edges make."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = [x for x in up if top(x) != x]
    return pa.table({"a": pa.array([top(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs``.

    Two documents link when ``100 * intersection >= threshold * union`` of their word ``n``-gram
    sets; ``component_id`` is the smallest id reachable by links, itself included.

    A null or wordless text has no shingles and links with nothing.  Rows that share an id are
    one document for links (it has the links of each of its texts).  A row whose id is null is
    kept, links with nothing and has a null component.  Other columns of ``docs`` are ignored;
    an empty table gives an empty result.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 50 to 100")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    bits = _domains(docs)
    signer = Signer(_common(docs, text_col, n, bits), bits, threshold)
    free_shuffles(spark)
    shared = spark.sparkContext.broadcast(signer)

    class Held:
        """The signer by way of its broadcast."""

        g = signer.g

        def sign(self, *a):  # noqa: ANN002, ANN202
            return shared.value.sign(*a)

        def is_common(self, ids):  # noqa: ANN001, ANN202
            return shared.value.is_common(ids)

    feats = scratch.write(_features(docs, id_col, text_col, n, Held(), bits), "features")
    shared_pairs = scratch.write(_pairs(feats, signer.g, bits, _tasks(docs, bits)), "pairs")
    free_shuffles(spark)

    plain = feats.where("print is not null and id is not null").select("id", "print", "sigs")
    firsts = scratch.write(plain.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "firsts")
    equal = plain.select("id", "print").join(firsts.where("copies > 1"), "print").where("id <> first").select("id", "first").distinct()
    equal = scratch.write(equal, "copies")
    signed = scratch.write(plain.join(equal.select("id").distinct(), "id", "left_anti").select("id", F.explode("sigs").alias("sig")).distinct(), "signed")
    counts = scratch.write(signed.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1"), "counts")
    few = signed.join(counts.where(F.col("n") <= 2 * COMMON).select("sig"), "sig").groupBy("sig").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    many = counts.where(F.col("n") > 2 * COMMON).select("sig", "a")
    hot = signed.join(small(many, many.count()), "sig").select("a", F.col("id").alias("b")).unionByName(shared_pairs.where("wide").select("a", "b")).where("a <> b").distinct()
    hot = scratch.write(hot, "hot")

    sketches = feats.where("id is not null and sketch is not null").select("id", "sketch")
    near = shared_pairs.where("not wide").select("a", "b").unionByName(few).unionByName(hot).distinct()
    near = near.join(sketches.withColumnsRenamed({"id": "a", "sketch": "x"}), "a").join(sketches.withColumnsRenamed({"id": "b", "sketch": "y"}), "b")
    near = scratch.write(_where(near, lambda x, y: _could_link(x, y, threshold)), "near")
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).union(hot.select("a")).union(hot.select("b")).distinct()
    sets = scratch.write(_sets(docs, id_col, text_col, n, wanted, wanted.count()), "sets")
    links = near.join(sets.withColumnsRenamed({"id": "a", "ids": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "ids": "y"}), "b")
    links = _where(links, lambda x, y: _linked(x, y, threshold))
    classes = scratch.write(components(links, scratch, "links"), "classes")
    if not hot.isEmpty():
        cohorts = components(hot, scratch, "cohorts").join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
        later = scratch.write(_cohort_links(sets, scratch.write(cohorts, "members"), threshold), "later")
        if not later.isEmpty():
            known = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            classes = scratch.write(components(known.unionByName(later), scratch, "all-links"), "all-classes")
    # an id that stands for several texts may be a copy of several first documents
    ties = equal.join(equal.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi")
    ties = ties.unionByName(equal.join(classes.select(F.col("node").alias("id")), "id", "left_semi"))
    if not ties.isEmpty():
        known = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = scratch.write(components(known.unionByName(ties.select(F.col("id").alias("a"), F.col("first").alias("b"))), scratch, "tied"), "tied-classes")
    copies = equal.groupBy("id").agg(F.min("first").alias("node"))
    attached = copies.join(classes, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    placed = classes.withColumnRenamed("node", "id").join(copies.select("id"), "id", "left_anti").unionByName(attached)
    for name in ("pairs", "firsts", "signed", "counts", "hot", "near", "sets", "links", "members", "later"):
        scratch.drop(name)
    out = feats.select("id", "n_shingles").join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


#: The same in SQL, over ``documents``, for five words and 80 percent.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, (SELECT MIN(seen) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
