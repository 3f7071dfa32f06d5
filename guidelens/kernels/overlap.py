"""Merging of read pairs by their overlap, a batch of pairs at once.

Bases are three bits, held as bit planes: a word of a plane has the bits of the 64 bases
from a position on, so two mates laid at an offset differ where xor of their words has
ones, and counting ones compares all offsets of all pairs at once. Only the first
OVERLAP_PROTECTED bases decide, which a word holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import OVERLAP_BASES, OVERLAP_DIFFERENCES, OVERLAP_IDENTITY, OVERLAP_PROTECTED

PLANES = 3
_BITS = np.full(256, 255, np.uint8)
_BITS[np.frombuffer(b"ACGTN", np.uint8)] = range(5)
_FIRST = np.uint64((1 << OVERLAP_PROTECTED) - 1)
CELLS = 1 << 21  # words of a plane of one batch, at most


@dataclass(frozen=True)
class Merged:
    seq: str
    qual: list[int]
    merged: bool
    overlap: int
    identity: float


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


def _agreement(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bases, known, wrong) of two mates laid at an offset."""
    p, q = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(p), len(q))
    p, q = p[:n], q[:n]
    known = (p != ord("X")) & (q != ord("X"))
    return n, known, known & (p != q)


def _allowed(known: np.ndarray, identity: float) -> np.ndarray:
    return np.minimum(OVERLAP_DIFFERENCES, np.floor(known * (1 - identity) + 1e-9).astype(np.int64))


def _words(rows: list[np.ndarray], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The planes of padded sequences, and which bases are known, as words from each position on."""
    codes = np.full((len(rows), width), ord("X"), np.uint8)
    for row, seq in zip(codes, rows, strict=True):
        row[: len(seq)] = seq
    known, bits = codes != ord("X"), np.where(codes == ord("X"), 0, _BITS[codes])

    def from_each(ones: np.ndarray) -> np.ndarray:
        word = ones.astype(np.uint64)
        for k in (1, 2, 4, 8, 16, 32):
            word[:, :-k] |= word[:, k:] << np.uint64(k)
        return word

    return [from_each((bits >> k) & 1) for k in range(PLANES)], from_each(known)


def _first_offsets(a: list[np.ndarray], b: list[np.ndarray], least: int, identity: float) -> list[int | None]:
    """The first admissible offset of each pair: 0 upward, then -1 downward."""
    la, lb = (np.array([len(x) for x in side]) for side in (a, b))
    wide_a, wide_b = int(la.max(initial=0)) + 1, int(lb.max(initial=0)) + 1
    (pa, ka), (pb, kb) = _words(a, wide_a), _words(b, wide_b)
    up, down = np.arange(wide_a)[None, :], np.arange(1, wide_b)[None, :]
    bases = np.concatenate([np.minimum(la[:, None] - up, lb[:, None]), np.minimum(lb[:, None] - down, la[:, None])], 1)

    def laid(x: np.ndarray, y: np.ndarray, join) -> np.ndarray:
        return np.concatenate([join(x, y[:, :1]), join(y[:, 1:], x[:, :1])], 1)

    known = laid(ka, kb, np.bitwise_and) & _FIRST
    differ = np.zeros_like(known)
    for x, y in zip(pa, pb, strict=True):
        differ |= laid(x, y, np.bitwise_xor)
    seen, wrong = np.bitwise_count(known).astype(np.int64), np.bitwise_count(differ & known).astype(np.int64)
    good = (bases >= least) & (wrong <= _allowed(seen, identity))
    unsure = good & (seen < least)  # enough known bases may follow the first ones
    for i, j in zip(*np.nonzero(unsure), strict=True):
        _, k, _ = _agreement(a[i], b[i], int(j) if j < wide_a else int(wide_a - 1 - j))
        good[i, j] = k.sum() >= least
    at = good.argmax(1)
    return [None if not good[i, j] else int(j) if j < wide_a else int(wide_a - 1 - j) for i, j in enumerate(at)]


def _one_by_one(a: np.ndarray, b: np.ndarray, least: int, identity: float) -> int | None:
    for offset in [*range(len(a) - least + 1), *range(-1, least - len(b) - 1, -1)]:
        n, known, wrong = _agreement(a, b, offset)
        if n >= least and known.sum() >= least and wrong[:OVERLAP_PROTECTED].sum() <= _allowed(known[:OVERLAP_PROTECTED].sum(), identity):
            return offset
    return None


def overlaps(ones: list[str], others: list[str], least: int = OVERLAP_BASES, identity: float = OVERLAP_IDENTITY) -> list[tuple[int, int, int, int] | None]:
    """For each pair (offset of the second in the first, bases, comparable bases, differences) of the first offset, 0 upward and then -1 downward, at which they agree.

    The first OVERLAP_PROTECTED bases decide: differences up to the share that identity leaves, and OVERLAP_DIFFERENCES at most.
    """
    a, b = [_codes(s) for s in ones], [_codes(s) for s in others]
    offsets: list[int | None] = [None] * len(a)
    plain = [i for i in range(len(a)) if not ((_BITS[a[i]] == 255) & (a[i] != ord("X"))).any() and not ((_BITS[b[i]] == 255) & (b[i] != ord("X"))).any()]
    for i in set(range(len(a))) - set(plain):  # letters beyond three bits
        offsets[i] = _one_by_one(a[i], b[i], least, identity)
    plain.sort(key=lambda i: len(a[i]) + len(b[i]))  # alike in length, so little is padded
    at = 0
    while at < len(plain):
        widest, stop = 1, at
        while stop < len(plain) and (stop - at + 1) * (widest := max(widest, len(a[plain[stop]]), len(b[plain[stop]]))) <= CELLS:
            stop += 1
        part = plain[at : max(stop, at + 1)]
        for i, offset in zip(part, _first_offsets([a[i] for i in part], [b[i] for i in part], least, identity), strict=True):
            offsets[i] = offset
        at += len(part)
    out: list[tuple[int, int, int, int] | None] = []
    for i, offset in enumerate(offsets):
        if offset is None:
            out.append(None)
            continue
        n, known, wrong = _agreement(a[i], b[i], offset)
        out.append((offset, n, int(known.sum()), int(wrong.sum())))
    return out


def merged_pairs(pairs: list[tuple[str, np.ndarray, str, np.ndarray]], window: int, least: int = OVERLAP_BASES, identity: float = OVERLAP_IDENTITY) -> list[tuple[str, np.ndarray, bool, int, float]]:
    """(seq, qual, merged, overlap, identity) of each (seq1, qual1, seq2rc, qual2rc): consensus by higher quality over the overlap; without one, both mates with X between them."""
    ups = [(a.upper(), x, b.upper(), y) for a, x, b, y in pairs]
    found = overlaps([p[0] for p in ups], [p[2] for p in ups], max(1, int(least)), identity)
    out = []
    for (a, qual1, b, qual2), hit in zip(ups, found, strict=True):
        if hit is None:
            gap = max(1, window)
            out.append((a + "X" * gap + b, np.concatenate([qual1, np.zeros(gap, qual1.dtype), qual2]), False, 0, 0.0))
            continue
        offset, n, compared, wrong = hit
        at, there = max(0, offset), max(0, -offset)
        q = np.zeros((2, n), qual1.dtype)
        for row, values, low in ((q[0], qual1, at), (q[1], qual2, there)):
            part = values[low : low + n]
            row[: len(part)] = part
        if wrong or compared < n:
            x, y = _codes(a[at : at + n]), _codes(b[there : there + n])
            core = np.where((x == y) | (q[0] >= q[1]), x, y).tobytes().decode("latin-1")
        else:
            core = a[at : at + n]
        rest = offset >= 0
        qual = np.concatenate([qual1[:at], q.max(0), qual2[there + n :] if rest else qual2[:0]])
        out.append((a[:at] + core + (b[there + n :] if rest else ""), qual, True, n, (compared - wrong) / compared))
    return out


def find_overlap(a: str, b: str, least: int = OVERLAP_BASES, identity: float = OVERLAP_IDENTITY) -> tuple[int, int, int, int] | None:
    return overlaps([a], [b], least, identity)[0]


def merge_pair(seq1: str, qual1: list[int], seq2rc: str, qual2rc: list[int], window: int, least: int = OVERLAP_BASES, identity: float = OVERLAP_IDENTITY) -> Merged:
    ((seq, qual, merged, overlap, share),) = merged_pairs([(seq1, np.array(qual1, np.int64), seq2rc, np.array(qual2rc, np.int64))], window, least, identity)
    return Merged(seq, qual.tolist(), merged, overlap, share)
