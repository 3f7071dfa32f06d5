"""Sequence documents: sites, motifs, reading frames, features and their edits, versions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.sequence import complement_iupac, iupac_regex, motif_positions
from ..kernels.codons import orfs


@dataclass(frozen=True)
class Enzyme:
    name: str
    site: str
    top: int
    bottom: int
    type_iis: bool = False


#: Name, recognition sequence, cuts of the top and bottom strand from its start, type IIS.
ENZYMES = (
    Enzyme("EcoRI", "GAATTC", 1, 5),
    Enzyme("BamHI", "GGATCC", 1, 5),
    Enzyme("HindIII", "AAGCTT", 1, 5),
    Enzyme("XhoI", "CTCGAG", 1, 5),
    Enzyme("NotI", "GCGGCCGC", 2, 6),
    Enzyme("SpeI", "ACTAGT", 1, 5),
    Enzyme("XbaI", "TCTAGA", 1, 5),
    Enzyme("PstI", "CTGCAG", 5, 1),
    Enzyme("NheI", "GCTAGC", 1, 5),
    Enzyme("KpnI", "GGTACC", 5, 1),
    Enzyme("SacI", "GAGCTC", 5, 1),
    Enzyme("BsaI", "GGTCTC", 7, 11, True),
    Enzyme("BsmBI", "CGTCTC", 7, 11, True),
    Enzyme("Esp3I", "CGTCTC", 7, 11, True),
)


def _reverse(motif: str) -> str:
    from ..functions.sequence import IUPAC, IUPAC_COMPLEMENT

    return motif[::-1].translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))


def _hit(strand: int, size: int):
    """The row of a motif's hit at a position."""
    return lambda p: F.struct(p.alias("start"), (p + size).alias("end"), F.lit(strand).alias("strand"), F.substring(F.col("seq"), p + 1, F.lit(size)).alias("match"))


ORF = "start int, end int, frame int, strand int, protein string"
SITE = "enzyme string, start int, end int, cut_top int, cut_bottom int, strand int, type_iis boolean"


def spots(seq: str, motif: str) -> list[int]:
    """Starts of all matches of an IUPAC motif, overlapping ones too, in one pass over the sequence."""
    if set(motif) - set("ACGT"):
        return [m.start() for m in re.finditer(f"(?={iupac_regex(motif)})", seq)]
    out, at = [], seq.find(motif)
    while at >= 0:
        out.append(at)
        at = seq.find(motif, at + 1)
    return out


def restriction_sites(docs: DataFrame, circular: bool = False, enzymes: tuple[Enzyme, ...] = ENZYMES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, enzyme, start, end, cut_top, cut_bottom, strand, type_iis of every site in column seq; sites over the origin of circular sequences too.

    One pass over the sequences without a shuffle; each distinct motif is searched once, and sites leave document by document.
    """
    wanted: dict[str, list[tuple]] = {}
    for e in enzymes:
        wanted.setdefault(e.site, []).append((e.name, len(e.site), e.top, e.bottom, 1, e.type_iis))
        if _reverse(e.site) != e.site:  # on the other strand the cuts change places
            wanted.setdefault(_reverse(e.site), []).append((e.name, len(e.site), e.bottom, e.top, -1, e.type_iis))
    reach = max(len(e.site) for e in enzymes) - 1 if circular else 0
    rows = docs.select(*keys, F.translate(F.upper(F.col("seq")), "U", "T").alias("_seq"))
    schema = StructType([*rows.schema.fields[: len(keys)], *_parse_datatype_string(SITE).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, seq in enumerate(map(pa.StringScalar.as_py, batch.column(len(keys)))):
                size, found = len(seq or ""), []
                for motif, sites in wanted.items() if size else ():
                    at = [p for p in spots(seq + seq[:reach], motif) if p < size]
                    if at:
                        found += [(name, at, n, top, bottom, strand, iis) for name, n, top, bottom, strand, iis in sites]
                if not found:
                    continue
                times = [len(f[1]) for f in found]
                p, n, top, bottom, strand = np.concatenate([f[1] for f in found]), *(np.repeat([f[c] for f in found], times) for c in (2, 3, 4, 5))
                own = [pa.repeat(batch.column(c)[i], len(p)) for c in range(len(keys))]
                cols = [np.repeat([f[0] for f in found], times).tolist(), p, (p + n) % size, (p + top) % size, (p + bottom) % size, strand, np.repeat([f[6] for f in found], times)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c).cast(f.type) for c, f in zip(cols, list(arrow)[len(keys) :], strict=True))], schema=arrow)

    return rows.mapInArrow(run, schema)


def motif_search(docs: DataFrame, query: str, both_strands: bool = True, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, start, end, strand, match of an IUPAC motif, overlapping hits too; a palindrome is found on both strands."""
    parts = []
    for strand, motif in ((1, query.upper()), (-1, _reverse(query.upper()))):
        if strand > 0 or both_strands:
            parts.append(F.transform(motif_positions(F.col("seq"), motif), _hit(strand, len(query))))
    return docs.select(*keys, "seq", F.explode(F.concat(*parts)).alias("m")).select(*keys, "m.*")


def register_functions(spark: SparkSession) -> None:
    """find_orfs(seq, least) as a table function for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=ORF)
    class FindOrfs:
        def eval(self, seq: str, least: int):
            yield from orfs(seq or "", least)

    spark.udtf.register("find_orfs", FindOrfs)


def find_orfs(docs: DataFrame, least: int = 30, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, start, end, frame, strand, protein of every open reading frame."""
    kept = docs.select(*keys, "seq")
    extra = _parse_datatype_string(ORF)
    schema = StructType([*(kept.schema[k] for k in keys), *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *o) for i, seq in enumerate(batch.column("seq").to_pylist()) for o in orfs(seq or "", least)]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(k).take(at) for k in keys] + [pa.array([r[1 + i] for r in rows], arrow.field(f.name).type) for i, f in enumerate(extra.fields)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return kept.mapInArrow(run, schema)


def inserted(seq: Column, at: Column, bases: Column) -> Column:
    return F.concat(F.substring(seq, F.lit(1), at), bases, F.substring(seq, at + 1, F.length(seq)))


def deleted(seq: Column, at: Column, count: Column) -> Column:
    return F.concat(F.substring(seq, F.lit(1), at), F.substring(seq, at + count + 1, F.length(seq)))


def shifted_features(features: DataFrame, at: Column, removed: Column, added: Column) -> DataFrame:
    """Features after an edit: moved, shortened to its start, or gone when nothing is left."""
    end_of = at + removed
    start = F.when(F.col("start") >= end_of, F.col("start") + added - removed).when(F.col("start") >= at, at).otherwise(F.col("start"))
    end = F.when(F.col("end") > end_of, F.col("end") + added - removed).when(F.col("end") > at, at).otherwise(F.col("end"))
    same = (added == removed) & (removed == 0)
    return features.withColumns({"start": F.when(same, F.col("start")).otherwise(start), "end": F.when(same, F.col("end")).otherwise(end)}).where(same | (F.col("start") < F.col("end")))


def upserted(features: DataFrame, changes: DataFrame, key: str = "feature_id") -> DataFrame:
    """Features with changed ones replaced and new ones added."""
    return features.join(changes.select(key), key, "left_anti").unionByName(changes)


def without(features: DataFrame, removed: DataFrame, key: str = "feature_id") -> DataFrame:
    return features.join(removed.select(key), key, "left_anti")


def row_strips(docs: DataFrame, width: int = 60, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, row, start, end, bases, complement: a sequence in strips of `width`."""
    strips = F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{width}}})"), 1)  # one pass, however long the sequence is
    rows = docs.select(*keys, F.posexplode(strips).alias("row", "bases"))
    start = F.col("row") * width
    return rows.select(*keys, "row", start.alias("start"), (start + F.length("bases")).alias("end"), "bases", complement_iupac(F.col("bases")).alias("complement"))


def features_in_rows(features: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """Each feature once for every strip that it touches, clipped: an interval join with fixed strips needs no join."""
    f = features.where("end > start").withColumn("row", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return f.select(key, "feature_id", F.col("row").cast("bigint").alias("row"), F.greatest("start", F.col("row") * width).alias("clip_start"), F.least("end", (F.col("row") + 1) * width).alias("clip_end"))


def stacked(clips: DataFrame, key: str = "doc_id") -> DataFrame:
    """clips with level: the lowest line of a strip on which a feature touches no earlier one; a strip has a screenful of features."""

    def levels(pdf):
        pdf = pdf.sort_values(["clip_start", "feature_id"])
        free: list[int] = []
        out = []
        for a, b in zip(pdf["clip_start"], pdf["clip_end"], strict=True):
            at = next((i for i, end in enumerate(free) if end <= a), len(free))
            free[at : at + 1] = [b]
            out.append(at)
        return pdf.assign(level=out)

    from pyspark.sql.types import IntegerType, StructField, StructType

    return clips.groupBy(key, "row").applyInPandas(levels, StructType([*clips.schema.fields, StructField("level", IntegerType())]))


def latest(items: DataFrame, key: str = "id", order: str = "saved_at") -> DataFrame:
    """The last saved version of each item."""
    return items.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def annotation_cut(ref: Column, guide: Column, start: Column, reverse: Column, saved: Column) -> Column:
    """Where a result's cut marker stands: by the motif beside or at the end of the shown guide, the given strand first; else as saved."""
    r, g = (F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) for c in (ref, guide))
    n, end = F.length(g), start + F.length(g)
    right = F.substring(r, end + 1, F.lit(3)).rlike("^[ACGT]GG$")
    left = (start >= 3) & F.substring(r, F.greatest(start - 2, F.lit(1)), F.lit(3)).rlike("^CC[ACGT]$")
    fwd = F.when(right, end - 3).when((n > 3) & g.rlike("[ACGT]GG$"), end - 6)
    rev = F.when(left, start + 3).when((n > 3) & g.rlike("^CC[ACGT]"), start + 6)
    found = F.when(F.coalesce(reverse, F.lit(False)), F.coalesce(rev, fwd)).otherwise(F.coalesce(fwd, rev))
    valid = (F.length(r) > 0) & (n > 0) & (start >= 0) & (end <= F.length(r)) & found.between(0, F.length(r))
    return F.when(valid, found).otherwise(saved)
