"""Guides in references: where they match, where they cut, and the window round the cut."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from ..config import Gene, Target
from .matching import occurrences, reverse_complement

_RIGHT_PAM, _LEFT_PAM = re.compile("[ACGT]GG"), re.compile("CC[ACGT]")


@dataclass(frozen=True)
class CutSite:
    strand: str
    start: int
    end: int
    cut: int
    pam: str
    pam_found: bool


def _slice(text: str, a: int, b: int) -> str:
    """text[a:b]; a negative start counts from the end, as slices do."""
    return text[a:b]


def cut_of_match(ref: str, start: int, length: int, strand: str) -> CutSite:
    """Cut of a guide that matches at start: three bases inside its motif, beside the match or (23 bases or more) at its own end."""
    end = start + length
    if strand == "forward":
        places, pattern = ((end, end + 3, end - 3), (end - 3, end, end - 6)), _RIGHT_PAM
        plain = end - 3
    else:
        places, pattern = ((start - 3, start, start + 3), (start, start + 3, start + 6)), _LEFT_PAM
        plain = start + 3
    for k, (a, b, cut) in enumerate(places):
        pam = _slice(ref, a, b)
        if (k == 0 or length >= 23) and pattern.fullmatch(pam):
            return CutSite(strand, start, end, cut, pam, True)
    return CutSite(strand, start, end, plain, "NOT_FOUND", False)


def find_cut_site(reference: str, guide: str) -> CutSite:
    """First hit of: forward match beside its motif; reverse match beside its motif; a long guide that holds the motif; any match; else the middle."""
    ref, fwd = reference.upper(), guide.upper()
    rev, n = reverse_complement(fwd), len(guide)
    if not n:
        return CutSite("unknown", -1, -1, len(ref) // 2, "N/A", False)
    by_strand = {"forward": fwd, "reverse": rev}
    for strand, query in by_strand.items():
        for at in occurrences(ref, query):
            site = cut_of_match(ref, at, n, strand)
            if site.pam_found and at < len(ref) - n:
                return site
    if n >= 23:
        for query, strands in ((fwd, ("forward", "reverse")), (rev, ("reverse", "forward"))):
            if (at := ref.find(query)) >= 0:
                for strand in strands:
                    if (site := cut_of_match(ref, at, n, strand)).pam_found:
                        return site
    for strand, query in by_strand.items():
        if (at := ref.find(query)) >= 0:
            return CutSite(strand, at, at + n, at + n - 3 if strand == "forward" else at + 3, "NOT_FOUND", False)
    return CutSite("unknown", -1, -1, len(ref) // 2, "N/A", False)


def window_bounds(length: int, cut: int, size: int, left: int | None = None, right: int | None = None) -> tuple[int, int]:
    if left is None or right is None:
        left = right = size // 2
    return max(0, cut - max(0, left)), min(length, cut + max(0, right))


@dataclass(frozen=True)
class Window:
    """The reference round one target's cut; number is the order over genes and targets."""

    number: int
    gene_ix: int
    target_ix: int
    gene: str
    target_id: str
    guide: str
    ref: str
    cut: int  # index in ref
    guide_found: bool

    @property
    def anchor(self) -> int:
        return min(15, max(1, len(self.ref) // 2))


def window_of(gene: Gene, target: Target, number: int = 0, gene_ix: int = 0, target_ix: int = 0) -> Window:
    site = find_cut_site(gene.sequence, target.guide)
    a, b = window_bounds(len(gene.sequence), site.cut, target.window_size, target.window_left, target.window_right)
    return Window(number, gene_ix, target_ix, gene.gene, target.target_id, target.guide.upper(), gene.sequence[a:b].upper(), max(0, site.cut - a), site.start >= 0)


def windows_of(genes: tuple[Gene, ...]) -> list[Window]:
    """All windows; a guide that isn't found has the window round the middle, flagged by guide_found."""
    out: list[Window] = []
    for g, gene in enumerate(genes):
        for t, target in enumerate(gene.targets):
            out.append(window_of(gene, target, len(out), g, t))
    return out


@dataclass(frozen=True)
class GuideMatch:
    matched: bool
    exact: bool
    mismatches: int
    identity: float
    strand: str
    start: int
    end: int
    cut: int
    pam: str
    pam_found: bool
    spacer: str
    guide: str


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _motif(ref: str, at: int, n: int, back: bool) -> str:
    """The motif beside a match, or nothing."""
    text = ref[max(0, at - 3) : at] if back else ref[at + n : at + n + 3]
    return text if len(text) == 3 and (text[:2] == "CC" if back else text[1:] == "GG") else ""


def _fewest(ref: str, query: str) -> tuple[int, int, bool]:
    """(mismatches, start, on the other strand) of the best place: fewest mismatches, then with a motif, then leftmost, then forward."""
    codes, n = _codes(ref), len(query)
    places = len(codes) - n + 1
    wrong = np.zeros((2, places), np.int64)
    for row, text in zip(wrong, (query, reverse_complement(query)), strict=True):
        for k, c in enumerate(_codes(text)):
            row += codes[k : k + places] != c
    strand, start = np.nonzero(wrong == wrong.min())
    m, _, at, back = min((int(wrong.min()), not _motif(ref, at, n, bool(s)), at, s) for s, at in zip(strand.tolist(), start.tolist(), strict=True))
    return m, at, bool(back)


def find_homoeolog_site(reference: str, guide: str, rate: float = 0.25) -> GuideMatch:
    """The exact site, else the position and strand with fewest mismatches (then with a motif, then leftmost, then forward)."""
    ref, query = ("".join(s.split()).upper() for s in (reference, guide))
    n = len(query)
    if not ref or not query or n > len(ref):
        return GuideMatch(False, False, n, 0.0, "unknown", -1, -1, -1, "N/A", False, "", query)
    site = find_cut_site(ref, query)
    if site.start >= 0:
        spacer = ref[site.start : site.end]
        return GuideMatch(True, True, 0, 100.0, site.strand, site.start, site.end, site.cut, site.pam, site.pam_found, spacer, reverse_complement(spacer) if site.strand == "reverse" else spacer)
    m, at, back = _fewest(ref, query)
    strand, spacer = "reverse" if back else "forward", ref[at : at + n]
    motif = _motif(ref, at, n, back)
    no_pam, pam = not motif, motif or "NOT_FOUND"
    identity = (n - m) / n * 100
    if m > max(1, int(n * rate)):
        return GuideMatch(False, False, m, identity, "unknown", -1, -1, -1, "N/A", False, "", query)
    return GuideMatch(True, False, m, int(identity * 10 + 0.5) / 10, strand, at, at + n, at + 3 if back else at + n - 3, pam, not no_pam, spacer, reverse_complement(spacer) if back else spacer)
