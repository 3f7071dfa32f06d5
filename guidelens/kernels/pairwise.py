"""Whole-sequence comparisons: identity of references, homoeolog projection, and pairwise alignment."""

from __future__ import annotations

import numpy as np

from ..config import REFERENCE_CELLS
from .matching import matcher, opcodes


def half_up(x: float, digits: int) -> float:
    return float(np.floor(x * 10**digits + 0.5) / 10**digits)


def edit_matrix(a: str, b: str) -> np.ndarray:
    """Levenshtein distances of all prefixes; one row at a time, insertions by a running minimum."""
    if len(a) * len(b) > REFERENCE_CELLS:
        raise ValueError("the references are too long to compare")
    y, span = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(len(b) + 1)
    out = np.empty((len(a) + 1, len(b) + 1), np.int32)
    out[0] = span
    for i, c in enumerate(a, 1):
        row = out[i]
        row[0] = i
        row[1:] = np.minimum(out[i - 1, :-1] + (y != ord(c)), out[i - 1, 1:] + 1)
        row[:] = np.minimum.accumulate(row - span) + span
    return out


def compare_references(a: str, b: str) -> tuple[float, list[tuple[str, int, int, int, int]]]:
    """Identity in per cent (matches / columns, one decimal) and opcodes; the same for (b, a), mirrored."""
    if a == b:
        return (100.0 if a else 0.0), opcodes(a, b)
    if a > b:
        score, ops = compare_references(b, a)
        mirror = {"delete": "insert", "insert": "delete"}
        return score, [(mirror.get(t, t), j1, j2, i1, i2) for t, i1, i2, j1, j2 in ops]
    d, i, j, steps = edit_matrix(a, b), len(a), len(b), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            steps.append(["equal" if a[i] == b[j] else "replace", i, i + 1, j, j + 1])
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            steps.append(["delete", i, i + 1, j, j])
        else:
            j -= 1
            steps.append(["insert", i, i, j, j + 1])
    out: list[list] = []
    for s in steps[::-1]:
        if out and out[-1][0] == s[0]:
            out[-1][2], out[-1][4] = s[2], s[4]
        else:
            out.append(s)
    same = sum(s[0] == "equal" for s in steps)
    return half_up(same / max(1, len(steps)) * 100, 1), [tuple(s) for s in out]


def clean(seq: str) -> str:
    return "".join(seq.split()).upper()


def homoeolog_similarity(a: str, b: str) -> float:
    a, b = clean(a), clean(b)
    if not a or not b:
        return 0.0
    return 100.0 if a == b else half_up(matcher(a, b).ratio() * 100, 1)


def difference_bp(a: str, b: str) -> int:
    """Columns in which two windows differ, by matching blocks; 0 without two windows."""
    if not a or not b:
        return 0
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in opcodes(a, b) if tag != "equal")


def project_position(reference: str, anchor: str, position: int) -> int | None:
    """A coordinate of a reference on a similar one, by linear interpolation inside differing stretches."""
    ref, base = clean(reference), clean(anchor)
    if not ref or not base or not 0 <= position <= len(ref):
        return None
    if ref == base:
        return min(position, len(base))
    for _, i1, i2, j1, j2 in opcodes(ref, base):
        if i1 <= position <= i2:
            share = min(1.0, (position - i1) / max(1, i2 - i1))
            return int(np.floor(j1 + share * (j2 - j1) + 0.5))
    return 0 if position <= 0 else len(base)


def align_pairwise(a: str, b: str, kind: str = "global", match: int = 1, mismatch: int = -1, gap: int = -2) -> tuple[str, str, int, float]:
    """Both sequences with gaps, the score, and the identity in per cent of the columns; kind: global or local."""
    a, b, local = a.upper(), b.upper(), kind == "local"
    y, span = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(len(b) + 1)
    s = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    if not local:
        s[0] = gap * span
    for i, c in enumerate(a, 1):
        row = s[i]
        row[0] = 0 if local else gap * i
        row[1:] = np.maximum(s[i - 1, :-1] + np.where(y == ord(c), match, mismatch), s[i - 1, 1:] + gap)
        if local:
            np.maximum(row, 0, out=row)
        row[:] = np.maximum.accumulate(row - gap * span) + gap * span
    i, j = np.unravel_index(int(s.argmax()), s.shape) if local else (len(a), len(b))
    i, j, score, x, z = int(i), int(j), int(s[i, j]), [], []
    while (s[i, j] > 0) if local else (i or j):
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(a[i])
            z.append(b[j])
        elif i and s[i, j] == s[i - 1, j] + gap:
            i -= 1
            x.append(a[i])
            z.append("-")
        else:
            j -= 1
            x.append("-")
            z.append(b[j])
    same = sum(p == q for p, q in zip(x, z, strict=True))
    return "".join(x[::-1]), "".join(z[::-1]), score, same / max(1, len(x)) * 100
