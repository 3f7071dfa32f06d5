"""Paired files: mates by name, mates by record, overlap merging, and what becomes of the molecules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FAILURES, AnalysisConfig
from ..functions import names
from ..functions.sequence import pair_quality_passes
from ..kernels.cutsite import windows_of
from ..kernels.locate import Evidence, best_evidence, candidates, segments
from ..kernels.matching import reverse_complement
from ..kernels.overlap import merged_pairs
from ..kernels.seeds import SeedIndex
from .assign import CACHE, SLICE_ROWS

MERGED = "seq string, qual string, merged boolean, overlap int, overlap_identity double"


def scores(qual: str | None) -> np.ndarray:
    """Phred scores of a quality line."""
    return np.frombuffer((qual or "").encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33


def distinct(batch: pa.RecordBatch, columns: tuple[str, ...]) -> tuple[dict[tuple, int], pa.Array]:
    """The different rows of some columns with their numbers, in order, and the number of each row of the batch."""
    number: dict[tuple, int] = {}
    at = [number.setdefault(row, len(number)) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
    return number, pa.array(at, pa.int32())


def file_pairs(files: DataFrame) -> DataFrame:
    """files (ordinal, name) -> pair, r1, r2, pair_name: mates with one sample key, in order; a second file for a slot starts another pair."""
    f = files.withColumn("mate", names.mate(F.col("name"))).withColumn("key", names.sample_key(F.col("name")))
    slot = W.partitionBy("key", "mate").orderBy("ordinal")
    f = f.withColumn("nth", F.when(F.col("mate").isNotNull(), F.row_number().over(slot)))
    alone = f.where("mate is null").select(F.col("ordinal").alias("pair"), F.col("name").alias("r1"), F.lit(None).cast("string").alias("r2"))
    both = f.where("mate is not null").groupBy("key", "nth").agg(F.min("ordinal").alias("pair"), F.max(F.when(F.col("mate") == "r1", F.col("name"))).alias("r1"), F.max(F.when(F.col("mate") == "r2", F.col("name"))).alias("r2"))
    out = both.select("pair", "r1", "r2").unionByName(alone)
    return out.withColumn("pair_name", names.pair_name(F.col("r1"), F.col("r2")))


def moved_mate(pairs: DataFrame, source: int, source_slot: str, target: int, target_slot: str) -> DataFrame:
    """Swap two slots of pairs (pair, r1, r2); pairs without a file go."""
    pick = lambda pair, slot: F.max(F.when(F.col("pair") == pair, F.col(slot))).over(W.partitionBy())
    held = pairs.withColumn("_s", pick(source, source_slot)).withColumn("_t", pick(target, target_slot))

    def slot(name: str) -> Column:
        new = F.when((F.col("pair") == source) & F.lit(name == source_slot), F.col("_t")).when((F.col("pair") == target) & F.lit(name == target_slot), F.col("_s"))
        return F.when(F.col("_s").isNotNull() & (((F.col("pair") == source) & F.lit(name == source_slot)) | ((F.col("pair") == target) & F.lit(name == target_slot))), new).otherwise(F.col(name))

    out = held.withColumns({"r1": slot("r1"), "r2": slot("r2")}).drop("_s", "_t").where("r1 is not null or r2 is not null")
    return out.withColumn("pair_name", names.pair_name(F.col("r1"), F.col("r2")))


def mate_records(r1: DataFrame, r2: DataFrame, keys: tuple[str, ...] = ("pair_id", "read_index")) -> DataFrame:
    """Records of both mates by position; a missing record, or ids that differ, raise an error when read."""
    side = lambda df, n: df.select(*keys, F.col("read_id").alias(f"r{n}_id"), F.col("seq").alias(f"r{n}_seq"), F.col("qual").alias(f"r{n}_qual"), F.lit(True).alias(f"_{n}"))
    both = side(r1, 1).join(side(r2, 2), list(keys), "full")
    one, two = names.read_id(F.col("r1_id")), names.read_id(F.col("r2_id"))
    wrong = (F.coalesce(one, F.lit("")) != "") & (F.coalesce(two, F.lit("")) != "") & (one != two)
    checked = F.when(F.col("_1").isNull() | F.col("_2").isNull(), F.raise_error(F.lit("the mates' files have different numbers of records"))).when(wrong, F.raise_error(F.concat(F.lit("mates differ: "), one, F.lit(" and "), two))).otherwise(F.col("r1_seq"))
    return both.withColumn("r1_seq", checked).drop("_1", "_2")


def merged(pairs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """pairs (r1_seq, r1_qual, r2_seq, r2_qual, ...) with the columns of MERGED: consensus, or both mates with X between."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(MERGED)
    schema = StructType([*pairs.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}  # what pairs give, by their bases and qualities
        for batch in batches:
            if len(held) > CACHE:
                held.clear()
            number, at = distinct(batch, ("r1_seq", "r1_qual", "r2_seq", "r2_qual"))
            new = [pair for pair in number if pair not in held]
            for low in range(0, len(new), SLICE_ROWS):
                part = new[low : low + SLICE_ROWS]
                mates = [(s1 or "", scores(q1), reverse_complement(s2 or ""), scores(q2)[::-1]) for s1, q1, s2, q2 in part]
                for pair, (seq, qual, *rest) in zip(part, merged_pairs(mates, config.paired_window, config.overlap_bases, config.overlap_identity), strict=True):
                    held[pair] = (seq, (np.clip(qual, 0, 93) + 33).astype(np.uint8).tobytes().decode("latin-1"), *rest)
            cols = [pa.array([held[pair][i] for pair in number], arrow.field(f.name).type).take(at) for i, f in enumerate(extra.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    return pairs.mapInArrow(run, schema)


def judged(molecules: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Merged molecules with passes (a window is usable) and the reason where none is, also of each mate alone."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string("passes boolean, reason string, r1_reason string, r2_reason string")
    schema = StructType([*molecules.schema.fields, *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [w for w in windows_of(config.genes) if w.guide_found]
        by_number, seeds = {w.number: w for w in windows}, SeedIndex(windows)
        # what a sequence shows is remembered; only the quality gate differs between its reads
        located = lru_cache(CACHE)(lambda seq: {n: candidates(seq, by_number[n]) for n in seeds([text for _, text in segments(seq)])})

        def judge(seq: str, qual: str) -> tuple[bool, str]:
            found, sums = located(seq.upper()), np.concatenate(([0], np.cumsum(scores(qual))))
            end, reasons, passes = len(sums) - 1, {"no_alignment"} if len(windows) > len(located(seq.upper())) else set(), False
            for cands, why in found.values():
                good = lambda c: (n := min(c.qual_end, end) - min(c.qual_start, end)) <= 0 or (sums[min(c.qual_end, end)] - sums[min(c.qual_start, end)]) / n >= config.phred
                e = best_evidence(seq.upper(), cands, [bool(good(c)) for c in cands], why)
                passes |= isinstance(e, Evidence)
                reasons |= set() if isinstance(e, Evidence) else {e}
            return passes, next((r for r in FAILURES if r in reasons), "no_target_window")

        for batch in batches:
            rows, (number, at) = [], distinct(batch, ("seq", "qual", "r1_seq", "r1_qual", "r2_seq", "r2_qual"))
            for seq, qual, s1, q1, s2, q2 in number:
                passes, reason = judge(seq, qual)
                mates = (None, None) if passes else (judge(s1 or "", q1 or "")[1], judge(reverse_complement(s2 or ""), (q2 or "")[::-1])[1])
                rows.append((passes, None if passes else reason, *mates))
            cols = [pa.array([r[i] for r in rows], arrow.field(f.name).type).take(at) for i, f in enumerate(extra.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=arrow)

    return molecules.mapInArrow(run, schema)


def preprocess_stats(molecules: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Molecules: all, with good mean quality, kept, merged, padded, filtered, and by reason; of judged() rows."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    passes, good = F.col("passes"), pair_quality_passes(F.col("r1_qual"), F.col("r2_qual"), config.phred)
    reasons = [n(F.col("reason") == r, f"fail_{r}") for r in ("quality", "no_anchor", "no_coverage", "no_alignment", "no_target_window")]
    return molecules.agg(F.count(F.lit(1)).alias("input_molecules"), n(good, "phred_passed"), n(passes, "normalized"), n(passes & F.col("merged"), "consensus"), n(passes & ~F.col("merged"), "padded"), n(~passes, "filtered"), *reasons)


def merge_stats(molecules: DataFrame) -> DataFrame:
    """Pairs, consensus and padded ones, and the mean length of the consensus reads."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    return molecules.agg(F.count(F.lit(1)).alias("pairs"), n(F.col("merged"), "consensus"), n(~F.col("merged"), "padded"), F.avg(F.when(F.col("merged"), F.length("seq"))).alias("mean_length"))


def mate_score(r1: Column, r2: Column) -> Column:
    """Mean of both mates' scores; the only one where one is missing."""
    return F.coalesce((r1 + r2) / 2, r1, r2)


def consensus_evidence(evidence: DataFrame, margin: float) -> DataFrame:
    """evidence (read_index, gene, target_id, r1_score, r2_score, ordinal) -> the target of each read whose gene and target lead by the margin."""
    scored = evidence.withColumn("score", mate_score(F.col("r1_score"), F.col("r2_score"))).where("score is not null")
    best = W.partitionBy("read_index", "gene").orderBy(F.desc("score"), "ordinal")
    rows = scored.withColumn("nth", F.row_number().over(best)).withColumn("second", F.lead("score").over(best)).where("nth = 1")
    among = W.partitionBy("read_index").orderBy(F.desc("score"), "ordinal")
    rows = rows.withColumn("place", F.row_number().over(among)).withColumn("rival", F.lead("score").over(among)).where("place = 1")
    clear = lambda c: F.col(c).isNull() | (F.col("score") - F.col(c) >= margin)
    return rows.where(clear("rival") & clear("second")).select("read_index", "gene", "target_id", "score")
