"""Open reading frames of a sequence or of a chunk of one, found from the places of start and stop codons."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.sequence import AMINO_ACIDS, IUPAC, IUPAC_COMPLEMENT

_INDEX = {c: i for i, c in enumerate("TCAG")}
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(b"TCAG", np.uint8)] = range(4)
_STOPS = np.array([a == "*" for a in AMINO_ACIDS])
_ATG = 16 * _INDEX["A"] + 4 * _INDEX["T"] + _INDEX["G"]
_TURNED = np.array([16 * (i % 4 ^ 2) + 4 * (i // 4 % 4 ^ 2) + (i // 16 ^ 2) for i in range(64)])  # of the other strand: T, C, A, G are 0 to 3, so a complement flips the second bit


def normalized(seq: str | None) -> str:
    return (seq or "").upper().replace("U", "T")


def reverse_strand(text: str) -> str:
    return text[::-1].translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))


def protein(dna: str) -> str:
    """Whole codons of the known bases."""
    clean = "".join(c for c in dna if c in _INDEX)
    return "".join(AMINO_ACIDS[16 * _INDEX[clean[j]] + 4 * _INDEX[clean[j + 1]] + _INDEX[clean[j + 2]]] for j in range(0, len(clean) - 2, 3))


def codon_places(text: str, own: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By strand: where start codons and stop codons stand, by their leftmost base on the top strand, of those that begin among the first `own` bases."""
    codes = _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.int16)
    n = max(0, min(own, len(codes) - 2))
    if not n:
        return {1: (np.empty(0, np.int64),) * 2, -1: (np.empty(0, np.int64),) * 2}
    a, b, c = codes[:n], codes[1 : n + 1], codes[2 : n + 2]
    known = (a < 4) & (b < 4) & (c < 4)
    codon = np.where(known, 16 * a + 4 * b + c, 0)
    turned = _TURNED[codon]
    return {s: (np.flatnonzero(known & (x == _ATG)), np.flatnonzero(known & _STOPS[x])) for s, x in ((1, codon), (-1, turned))}


@dataclass(frozen=True)
class Frame:
    """What one frame of a chunk does to an open reading frame, in its strand's own direction."""

    spans: list[tuple[int, int]]  # begin and stop codon, both within
    first_stop: int | None  # ends one that is open before
    left_open: int | None  # start codon that no stop follows: after the last stop, or at all


def frame_of(starts: np.ndarray, stops: np.ndarray) -> Frame:
    """starts, stops: rising places, in reading direction, of one frame's codons. A frame opens at its first start codon after a stop."""
    after = np.concatenate([[-1], stops[:-1]]) if len(stops) else np.empty(0, np.int64)
    at = np.searchsorted(starts, after, "right")
    held = np.flatnonzero(at < len(starts))
    begin = starts[at[held]]
    ok = begin < stops[held]
    spans = list(zip(begin[ok].tolist(), stops[held][ok].tolist(), strict=True))
    tail = np.searchsorted(starts, stops[-1], "right") if len(stops) else 0
    return Frame(spans, int(stops[0]) if len(stops) else None, int(starts[tail]) if tail < len(starts) else None)


def frames_of(text: str, own: int, at: int, total: int) -> Iterator[tuple[int, int, Frame]]:
    """(strand, frame, what it does) of a chunk that begins at `at` of a sequence; places are of the strand's own reading, from its start."""
    for strand, (starts, stops) in codon_places(text, own).items():
        if strand < 0:
            starts, stops = (total - 3 - at - x[::-1] for x in (starts, stops))
        else:
            starts, stops = starts + at, stops + at
        for frame in range(3):
            yield strand, frame, frame_of(starts[starts % 3 == frame], stops[stops % 3 == frame])


def orfs(seq: str | None, least: int = 30) -> Iterator[tuple[int, int, int, int, str]]:
    """(start, end, frame, strand, protein) from the first ATG to a stop, in six frames; length with the stop of at least 3 * least."""
    top = normalized(seq)
    n, back = len(top), None
    for strand, frame, f in frames_of(top, n, 0, n):
        for begin, stop in f.spans:
            if stop + 3 - begin < 3 * least:
                continue
            if strand < 0 and back is None:
                back = reverse_strand(top)
            dna = (top if strand > 0 else back)[begin : stop + 3]
            span = (begin, stop + 3) if strand > 0 else (n - stop - 3, n - begin)
            yield (*span, strand * (frame + 1), strand, protein(dna))
