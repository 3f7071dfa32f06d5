"""Parameters of an analysis, and constants of the method."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values of the method.
CUT_FLANK = 15  # bases that must be observed on either side of the cut
ANCHOR = 15  # bases of a terminal anchor
ANCHOR_ERRORS = 4
PLACEMENT = 10  # bases of an exact block that places an observation
CELLS = 65_536  # of a dynamic programming matrix, at most
REFERENCE_CELLS = 64_000_000
OVERLAP_BASES, OVERLAP_IDENTITY, OVERLAP_DIFFERENCES, OVERLAP_PROTECTED = 10, 0.80, 5, 50
FAILURES = ("quality", "no_anchor", "no_coverage", "no_alignment")  # by priority


@dataclass(frozen=True)
class Target:
    target_id: str
    guide: str
    window_size: int = 90
    window_left: int | None = None
    window_right: int | None = None


@dataclass(frozen=True)
class Gene:
    gene: str
    sequence: str
    targets: tuple[Target, ...]
    display: str | None = None
    homoeolog_group: str | None = None


@dataclass(frozen=True)
class AnalysisConfig:
    """genes in order; thresholds: Phred, share of an allele in per cent, score margin as a fraction."""

    genes: tuple[Gene, ...]
    phred: float = 10.0
    indel_percent: float = 1.0
    margin: float = 0.05
    rescue: bool = False
    rescue_reads: int = 20
    analyze_ambiguous: bool = False
    distance_weight: float = 0.0
    exclusion_flank: int = 0
    paired_window: int = 90
    overlap_bases: int = OVERLAP_BASES
    overlap_identity: float = OVERLAP_IDENTITY
    by_input: dict[str, tuple[Gene, ...]] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        for genes in (self.genes, *self.by_input.values()):
            if not genes:
                raise ValueError("at least one gene is needed")
            for g in genes:
                if not g.sequence or not g.targets or not all(t.guide for t in g.targets):
                    raise ValueError(f"gene {g.gene} needs a sequence and a guide")
            if len({g.gene for g in genes}) != len(genes):
                raise ValueError("gene names must differ")
