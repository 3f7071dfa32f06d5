"""Searches of very long sequences: dealt as chunks that overlap by what a match needs, each chunk a row of its own.

A site or motif begins in one chunk and ends in its halo, so chunks find each once. An
open reading frame may span any number of chunks: in each of six frames a chunk either
has a stop, which ends what is open before it, or leaves it open, so what is open at each
chunk's start follows from a small row of every chunk before it (strand -1 reads chunks
from the last). What spans chunks is put together from their own bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.sequence import motif_positions
from ..kernels.codons import frames_of, normalized, protein, reverse_strand
from ..sources.shared import written
from .workspace import ENZYMES, ORF, SITE, Enzyme, _reverse, restriction_sites

CHUNK = 1 << 20
TOGETHER = 1 << 20  # bases of chunks that leave in one batch
PIECE = "_total long, _at long, _own int, seq string"


def pieces(docs: DataFrame, keys: tuple[str, ...], size: int, halo: int, circular: bool = False) -> DataFrame:
    """keys, _total, _at, _own, seq: each sequence in chunks of size bases and up to halo more, dealt over all tasks; null and empty ones have none."""
    rows = docs.select(*keys, "seq").where(F.length("seq") > 0)
    schema = StructType([*rows.schema.fields[: len(keys)], *_parse_datatype_string(PIECE).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, held = [], 0  # (row, _total, _at, _own, text) of some chunks, and their bases

            def flushed() -> pa.RecordBatch:
                where = pa.array([c[0] for c in cut], pa.int64())
                cols = [pa.array([c[1 + j] for c in cut], f.type) for j, f in enumerate(list(arrow)[len(keys) :])]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(keys))), *cols], schema=arrow)

            for i in range(batch.num_rows):
                seq = batch.column(len(keys))[i].as_py()
                turn = seq[:halo] if circular else ""
                for at in range(0, len(seq), size):
                    own = min(size, len(seq) - at)
                    text = seq[at : at + size + halo]
                    text += turn[: max(0, at + own + halo - len(seq))]
                    cut.append((i, len(seq), at, own, text))
                    held += len(text)
                    if held >= TOGETHER:
                        yield flushed()
                        cut, held = [], 0
            if cut:
                yield flushed()

    return rows.mapInArrow(run, schema).repartition(*keys, "_at")


def chunked_sites(docs: DataFrame, circular: bool = False, enzymes: tuple[Enzyme, ...] = ENZYMES, keys: tuple[str, ...] = ("doc_id",), size: int = CHUNK) -> DataFrame:
    """restriction_sites() of sequences of any length. Circular sequences are searched over their ends; one shorter than a site has none over more than one turn."""
    halo = max(len(e.site) for e in enzymes) - 1
    cut = pieces(docs, keys, size, halo, circular)
    found = restriction_sites(cut, False, enzymes, (*keys, "_total", "_at", "_own")).where(F.col("start") < F.col("_own"))
    # in a chunk's own coordinates ends and cuts are taken modulo its length, so they come from the enzyme here
    n, reverse = F.lit(None).cast("int"), F.col("strand") < 0
    size_of, top, bottom = n, n, n
    for e in enzymes:
        here = F.col("enzyme") == e.name
        size_of = F.when(here, len(e.site)).otherwise(size_of)
        top = F.when(here, F.when(reverse, e.bottom).otherwise(e.top)).otherwise(top)
        bottom = F.when(here, F.when(reverse, e.top).otherwise(e.bottom)).otherwise(bottom)
    start = F.col("_at") + F.col("start")
    place = lambda c, name: ((start + c) % F.col("_total")).cast("int").alias(name)
    return found.select(*keys, "enzyme", start.cast("int").alias("start"), place(size_of, "end"), place(top, "cut_top"), place(bottom, "cut_bottom"), "strand", "type_iis")


def chunked_motifs(docs: DataFrame, query: str, both_strands: bool = True, keys: tuple[str, ...] = ("doc_id",), size: int = CHUNK) -> DataFrame:
    """motif_search() of sequences of any length."""
    cut, n = pieces(docs, keys, size, len(query) - 1), len(query)

    def hit(strand: int):
        return lambda p: F.struct(p.alias("p"), F.lit(strand).alias("strand"), F.substring(F.col("seq"), p + 1, F.lit(n)).alias("match"))

    both = [(1, query.upper()), (-1, _reverse(query.upper()))][: 1 + both_strands]
    parts = [F.transform(motif_positions(F.col("seq"), motif), hit(strand)) for strand, motif in both]
    hits = cut.select(*keys, "_at", "_own", F.explode(F.concat(*parts)).alias("m")).where(F.col("m.p") < F.col("_own"))
    start = F.col("_at") + F.col("m.p")
    return hits.select(*keys, start.cast("int").alias("start"), (start + n).cast("int").alias("end"), "m.strand", "m.match")


def chunked_orfs(docs: DataFrame, least: int = 30, keys: tuple[str, ...] = ("doc_id",), size: int = CHUNK) -> DataFrame:
    """find_orfs() of sequences of any length; keys tell sequences apart. Chunks are cut and searched at once, and written; only the bases of frames over several of them are read again."""
    cut = written(pieces(docs, keys, size, 2), "chunks")
    orf = _parse_datatype_string(ORF).fields
    effect = _parse_datatype_string("_total long, _at long, first_begin long, first_stop long, left_open long").fields
    own = cut.schema.fields[: len(keys)]
    inner, both = StructType([*own, *orf]), StructType([*own, *orf, *effect])
    arrow_inner, arrow = to_arrow_schema(inner), to_arrow_schema(both)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frames within a chunk; and, without a protein, what each frame of a chunk among several does to those over chunks."""
        for batch in batches:
            rows = []
            for i, (total, at, mine, seq) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_total", "_at", "_own", "seq")), strict=True)):
                text = normalized(seq)
                for strand, frame, f in frames_of(text, mine, at, total):
                    first, first_begin = at == 0 if strand > 0 else at + mine == total, None
                    for begin, stop in f.spans:
                        if stop == f.first_stop and not first:
                            first_begin = begin  # an earlier chunk may have opened it
                            continue
                        if stop + 3 - begin >= 3 * least:
                            a, b = (begin, stop + 3) if strand > 0 else (total - stop - 3, total - begin)
                            dna = text[a - at : b - at]
                            rows.append((i, a, b, strand * (frame + 1), strand, protein(dna if strand > 0 else reverse_strand(dna)), *[None] * 5))
                    if total > size and (f.first_stop is not None or f.left_open is not None):
                        rows.append((i, None, None, strand * (frame + 1), strand, None, total, at, first_begin, f.first_stop, f.left_open))
            where = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in keys), *(pa.array([r[1 + j] for r in rows], arrow.field(f.name).type) for j, f in enumerate((*orf, *effect)))], schema=arrow)

    found = written(cut.mapInArrow(searched, both), "frames")
    # a stop ends what is open before it and begins a part, which the first start codon after it leaves open; places rise in reading direction
    of, stop = (*keys, "frame", "strand"), F.col("first_stop")
    reading = W.partitionBy(*of).orderBy(F.col("_at") * F.col("strand")).rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = found.where("protein IS NULL").withColumn("_part", F.count(stop).over(reading))
    parts = parts.groupBy(*of, "_part").agg(F.max("_total").alias("_total"), F.min(stop).alias("stop"), F.min("first_begin").alias("own"), F.min("left_open").alias("open"))
    begin = F.coalesce(F.lag("open").over(W.partitionBy(*of).orderBy("_part")), "own")
    ended = parts.withColumn("begin", begin).where(F.col("stop") + 3 - F.col("begin") >= 3 * least)
    forward, end = F.col("strand") > 0, F.col("stop") + 3
    over = ended.select(*keys, F.when(forward, F.col("begin")).otherwise(F.col("_total") - end).alias("start"), F.when(forward, end).otherwise(F.col("_total") - F.col("begin")).alias("end"), "frame", "strand")
    # their bases, chunk by chunk
    wanted = over.withColumn("_at", F.explode(F.sequence(F.col("start") - F.col("start") % size, F.col("end") - 1, F.lit(size).cast("long"))))
    parts = cut.where(F.col("_total") > size).select(*keys, "_at", "_own", "seq").join(wanted, [*keys, "_at"])
    low = F.greatest(F.col("start") - F.col("_at"), F.lit(0))
    text = F.substring(F.substring("seq", F.lit(1), F.col("_own")), low.cast("int") + 1, (F.col("end") - F.col("_at") - low).cast("int"))
    joined = parts.groupBy(*keys, "start", "end", "frame", "strand").agg(F.sort_array(F.collect_list(F.struct("_at", text.alias("text")))).alias("texts"))
    whole = joined.select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "frame", "strand", F.array_join("texts.text", "").alias("seq"))

    def read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("strand").to_pylist(), map(normalized, batch.column("seq").to_pylist()), strict=True)
            found = pa.array([protein(t if s > 0 else reverse_strand(t)) for s, t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(arrow_inner)[:-1]), found], schema=arrow_inner)

    return found.where("protein IS NOT NULL").select(*inner.names).unionByName(whole.mapInArrow(read_out, inner))
