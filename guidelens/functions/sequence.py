"""Functions of sequences, qualities and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
IUPAC, IUPAC_COMPLEMENT = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"
#: Bases that each ambiguity code stands for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
#: The standard genetic code, codons in order of T, C, A, G at each position.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def half_up(x: Column, digits: int) -> Column:
    """Rounding half up on doubles: floor(x * 10^digits + 0.5) / 10^digits."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; A, C, G, T, N and X have complements, anything else becomes N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(seq)), "[^ACGTNX]", "N"), "ACGT", "TGCA")


def complement_iupac(seq: Column) -> Column:
    """Of all IUPAC codes, in the case they have; other letters stay, U gives A."""
    return F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def reverse_complement_iupac(seq: Column) -> Column:
    return F.reverse(complement_iupac(seq))


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: Column) -> Column:
    """Per cent of G, C and S in either case; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, count_of(seq, "GCSgcs") / F.length(seq) * 100.0).otherwise(0.0)


def gc_of_read(seq: Column) -> Column:
    """Per cent of G and C only; 0 for an empty read."""
    return F.when(F.length(seq) > 0, count_of(seq, "GCgc") / F.length(seq) * 100.0).otherwise(0.0)


def phred_values(qual: Column) -> Column:
    """Phred scores (ASCII less 33) of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_sum(qual: Column) -> Column:
    return F.aggregate(phred_values(qual), F.lit(0).cast("bigint"), lambda a, x: a + x)


def avg_phred(qual: Column) -> Column:
    """Mean Phred score; 40 where there is none, so that a read without qualities passes."""
    return F.when(F.coalesce(F.length(qual), F.lit(0)) > 0, phred_sum(qual) / F.length(qual)).otherwise(40.0)


def pair_quality_passes(qual1: Column, qual2: Column, threshold: float) -> Column:
    """The mean over both mates' bases reaches the threshold; no bases pass."""
    n = F.coalesce(F.length(qual1), F.lit(0)) + F.coalesce(F.length(qual2), F.lit(0))
    return (n == 0) | ((F.coalesce(phred_sum(qual1), F.lit(0)) + F.coalesce(phred_sum(qual2), F.lit(0))) / n >= threshold)


def melting_temp(seq: Column) -> Column:
    """2 a pair of A or T and 4 of G or C below 14 clean bases; else 64.9 + 41 (GC - 16.4) / length of the sequence as given."""
    clean = F.regexp_replace(F.upper(seq), "[^ATCG]", "")
    short = (count_of(clean, "AT") * 2 + count_of(clean, "CG") * 4).cast("double")
    return F.when(F.length(clean) < 14, short).otherwise((count_of(seq, "CG") - F.lit(16.4).cast("double")) * 41.0 / F.length(seq) + F.lit(64.9).cast("double"))


def frame(inserted: Column, deleted: Column) -> Column:
    """no_indel without gaps; in_frame if the net change is a multiple of three, else out_of_frame."""
    return F.when((inserted == 0) & (deleted == 0), "no_indel").when((inserted - deleted) % 3 == 0, "in_frame").otherwise("out_of_frame")


def seagull_weight(d: Column, reach: Column, strength: float) -> Column:
    """1 near the cut, up to 1 + strength far from it, along a logistic curve (slope 0.35, middle at 10 bases)."""
    if strength <= 0:
        return F.lit(1.0)
    curve = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.35).cast("double") * (x - 10)))
    at0 = curve(F.lit(0.0))
    share = (curve(d) - at0) / (curve(reach) - at0)
    return F.lit(1.0) + F.lit(float(strength)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def window_start(cut: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), cut - F.floor(size / 2))


def window_end(length: Column, cut: Column, size: Column) -> Column:
    return F.least(length, cut + F.floor(size / 2))


def offset_of(seq: Column, window: str, guide: str) -> Column:
    """Read position (0-based) of the window's first base, from the guide, its reverse complement, or an end of 15 bases."""
    rc = guide.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    ways = []
    for query in (guide.upper(), rc):
        if query and query in window:
            ways.append(F.when(F.instr(seq, query) > 0, F.instr(seq, query) - 1 - window.index(query)))
    ways.append(F.when(F.instr(seq, window[:15]) > 0, F.instr(seq, window[:15]) - 1))
    ways.append(F.when(F.instr(seq, window[-15:]) > 0, F.instr(seq, window[-15:]) - 1 - (len(window) - 15)))
    return F.coalesce(*ways)


def bounded_distance(a: Column, b: Column, most: int = 4) -> Column:
    """Levenshtein distance; most + 1 when it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance plus the difference in length."""
    n = F.least(F.length(a), F.length(b))
    common = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))).otherwise(0)
    return common + F.abs(F.length(a) - F.length(b))


def _starts(seq: Column, pattern: str) -> Column:
    """0-based starts of all matches of a pattern, from one split before each of them: linear in the sequence."""
    parts = F.split(seq, f"(?={pattern})", -1)
    sums = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(p))))
    # a match at the very start makes no empty part
    return F.when(seq.rlike(f"^(?:{pattern})"), F.concat(F.array(F.lit(0)), sums)).otherwise(sums)


def positions(seq: Column, motif: str) -> Column:
    """All 0-based starts of a motif, overlapping ones too."""
    return _starts(seq, motif)


def iupac_regex(motif: str, escape: bool = False) -> str:
    """A regular expression for an IUPAC motif; other characters stand for themselves (escape: literally)."""
    import re

    return "".join(AMBIGUITY.get(c, re.escape(c) if escape else c) for c in motif.upper())


def motif_positions(seq: Column, motif: str) -> Column:
    """All 0-based starts of an IUPAC motif in either case, overlapping ones too."""
    return _starts(F.upper(seq), iupac_regex(motif))


def translate_dna(seq: Column) -> Column:
    """Protein of the cleaned sequence (A, C, G, T, U only), whole codons."""
    clean = F.translate(F.upper(F.regexp_replace(seq, "(?i)[^ATCGU]", "")), "U", "T")
    codons = F.regexp_extract_all(F.translate(clean, "TCAG", "0123"), F.lit("([0-3]{3})"), 1)
    return F.array_join(F.transform(codons, lambda c: F.substring(F.lit(AMINO_ACIDS), F.conv(c, 4, 10).cast("int") + 1, F.lit(1))), "")


def observed_segments(seq: Column) -> Column:
    """Maximal stretches without X, upper-cased."""
    return F.regexp_extract_all(F.upper(seq), F.lit("([^X]+)"), 1)


def segments(seq: Column, qual: Column | None = None) -> Column:
    """The stretches without X as an array of (start, end, seq, qual): offsets from 0, end exclusive, each with its part of the qualities (null without any). A null sequence gives null; runs are taken to be few, since each one's start is the sum of the lengths before it."""
    runs = F.regexp_extract_all(F.upper(seq), F.lit("([^X]+|X+)"), 1)
    start = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, r: a + F.length(r))
    part = lambda r, i: F.substring(qual, start(i) + 1, F.length(r)) if qual is not None else F.lit(None).cast("string")
    each = F.transform(runs, lambda r, i: F.struct(start(i).alias("start"), (start(i) + F.length(r)).alias("end"), r.alias("seq"), part(r, i).alias("qual")))
    return F.filter(each, lambda x: ~x["seq"].startswith("X"))


def leading_x(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "^X+", 0))


def trailing_x(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "X+$", 0))


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of at most `width` characters."""
    return F.regexp_replace(F.regexp_replace(seq, "(.{%d})" % width, "$1\n"), "\n$", "")


def highlighted(seq: Column, motif: str) -> Column:
    return F.regexp_replace(seq, f"(?i)({iupac_regex(motif, True)})", "<mark>$1</mark>")


def token_length(tokens: Column, kind: str) -> Column:
    """Bases of all tokens of one kind, of an array of (type, val)."""
    return F.aggregate(F.filter(tokens, lambda t: t["type"] == kind), F.lit(0), lambda a, t: a + F.length(t["val"]))


def normalized_sequence(seq: Column) -> Column:
    return F.upper(F.regexp_replace(seq, r"\s+", ""))
