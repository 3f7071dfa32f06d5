"""Sequence primitives: reverse complement, matching blocks, bounded edit distance, exact occurrences."""

from __future__ import annotations

from difflib import SequenceMatcher

_COMPLEMENT = bytes.maketrans(bytes(range(256)), bytes(dict(zip(b"ACGTNX", b"TGCANX", strict=True)).get(c, ord("N")) for c in range(256)))


def reverse_complement(seq: str) -> str:
    """Of upper-cased bases; anything but A, C, G, T, N and X counts as N."""
    return seq.upper().encode("latin-1", "replace").translate(_COMPLEMENT)[::-1].decode("latin-1")


def matcher(a: str, b: str) -> SequenceMatcher:
    return SequenceMatcher(None, a, b, autojunk=False)


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    if a == b:
        return [("equal", 0, len(a), 0, len(b))] if a else []
    return matcher(a, b).get_opcodes()


def blocks(a: str, b: str, least: int = 1) -> list[tuple[int, int, int]]:
    """Matching blocks of at least so many bases, as (start in a, start in b, length)."""
    return [tuple(m) for m in matcher(a, b).get_matching_blocks() if m.size >= least]


def occurrences(text: str, pattern: str) -> list[int]:
    """All starts of pattern, overlapping ones too."""
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def within_edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (ca != cb))
        if min(row) > most:
            return most + 1
    return row[-1]


def mismatches(a: str, b: str) -> int:
    """Hamming distance plus the difference in length."""
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))


def x_runs(seq: str) -> tuple[int, int]:
    """Lengths of the leading and trailing runs of X; all of an all-X sequence leads."""
    lead = len(seq) - len(seq.lstrip("X"))
    return lead, 0 if lead == len(seq) else len(seq) - len(seq.rstrip("X"))
