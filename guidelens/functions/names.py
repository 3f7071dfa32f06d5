"""Names of reads, files, samples, genes and results, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of file names.
FASTQ_SUFFIX = r"(?i)\.(?:fastq|fq)(?:\.gz)?$"
_MATE_WORD, _MATE_END = r"(?i)(^|[._-])R([12])(?=([._-]|$))", r"([_-])([12])$"


def is_fastq(name: Column) -> Column:
    return name.rlike(FASTQ_SUFFIX)


def read_id(identifier: Column) -> Column:
    """Without @, first word, without a closing /1 or /2."""
    return F.regexp_replace(F.get(F.split(F.trim(F.regexp_replace(identifier, "^@", "")), r"\s+"), F.lit(0)), "/[12]$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, FASTQ_SUFFIX, "")


def mate(name: Column) -> Column:
    """r1, r2, or null: a word R1 or R2 between . _ -, else a closing _1, -1, _2 or -2."""
    s = stem(name)
    digit = F.when(s.rlike(_MATE_WORD), F.regexp_extract(s, _MATE_WORD, 2)).when(s.rlike(_MATE_END), F.regexp_extract(s, _MATE_END, 2))
    return F.when(digit == "1", "r1").when(digit == "2", "r2")


def without_mate(name: Column) -> Column:
    """The stem without its mate word, a closing lane number, and separators at its ends."""
    s = stem(name)
    first = F.regexp_extract(s, r"(?i)^((?:(?!(?:^|[._-])R[12](?:[._-]|$)).)*?(?:^|[._-]))R[12](?=[._-]|$)(.*)$", 1)
    rest = F.regexp_extract(s, r"(?i)^((?:(?!(?:^|[._-])R[12](?:[._-]|$)).)*?(?:^|[._-]))R[12](?=[._-]|$)(.*)$", 2)
    cut = F.when(s.rlike(_MATE_WORD), F.concat(first, rest)).otherwise(F.regexp_replace(s, r"[12]$", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"[._-]00\d$", ""), "[._-]+$", ""), "^[._-]+", "")


def sample_key(name: Column) -> Column:
    key = F.lower(F.regexp_replace(without_mate(name), "[._-]+", "_"))
    return F.when(mate(name).isNull() | (key == ""), F.lower(stem(name))).otherwise(key)


def humanized(value: Column) -> Column:
    """Words apart, digits apart from letters, each word's first letter upper-cased and the rest as it is."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[._-]+", " "), "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    words = F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")
    text = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(text == "", "Illumina Sample").otherwise(text)


def sample_name(name: Column) -> Column:
    plain = without_mate(name)
    return humanized(F.when(mate(name).isNull() | (plain == ""), stem(name)).otherwise(plain))


def pair_name(name1: Column, name2: Column) -> Column:
    """The sample's name when both mates agree on it, else both names; of a single mate, its own."""
    both = F.when(sample_key(name1) == sample_key(name2), sample_name(name1)).otherwise(F.concat(sample_name(name1), F.lit(" + "), sample_name(name2)))
    return F.when(name1.isNotNull() & name2.isNotNull(), both).otherwise(F.coalesce(sample_name(name1), sample_name(name2), F.lit("Illumina Sample")))


def merged_aliases(first: Column, second: Column) -> Column:
    """Distinct names of two /-joined lists, in order."""
    names = F.filter(F.split(F.concat_ws("/", first, second), "/"), lambda n: n != "")
    return F.array_join(F.array_distinct(names), "/")


def barcode(name: Column) -> Column:
    return F.regexp_replace(name, FASTQ_SUFFIX, "")


def normalized_barcode(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[\s._-]+", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sheet_name(value: Column, most: int = 31) -> Column:
    """A sheet's name: without characters that sheets can't have, single spaces, cut."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, r"[\\/?*:\[\]]", " "), r"\s+", " "))
    return F.substring(F.when(clean == "", "Barcode").otherwise(clean), 1, most)


def download_name(value: Column, fallback: str, most: int = 120) -> Column:
    """A file's name without its suffix and without characters that files can't have."""
    stemmed = F.regexp_replace(F.trim(value), r"(?i)\.xlsx?$", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(stemmed, r"[\\/:*?\"<>|]+", " "), r"\s+", " "))
    return F.substring(F.when(clean == "", fallback).otherwise(clean), 1, most)


def failure_label(reason: Column) -> Column:
    return F.when(reason == "quality", "Low quality").when(reason == "no_anchor", "No anchor").when(reason == "no_coverage", "Cut site not covered").when(reason == "no_alignment", "No alignment").otherwise("No target window")


def display_class(category: Column, has_sub: Column) -> Column:
    return F.when(category == "out_of_frame", "Out-of-frame").when(category == "in_frame", "In-frame").when(has_sub, "Substitution").otherwise("No indel")


def primary_failure(reasons: Column) -> Column:
    """The reason of highest priority in an array; no_target_window without one."""
    out = F.lit("no_target_window")
    for reason in ("no_alignment", "no_coverage", "no_anchor", "quality"):
        out = F.when(F.array_contains(reasons, reason), reason).otherwise(out)
    return out
