"""Reads to genes: one Arrow pass over the reads, no shuffle.

The kernel sees one read and all windows of its reference set, since the choice
among genes compares windows within a read; an index of seeds names those that the
read can observe, so a large panel costs a read no more than a small one. Locating depends on the bases alone,
and scores on the bases and on which observations pass the quality gate; both are
remembered for CACHE sequences a task, so repeated reads cost a lookup and reads
aren't shuffled to find their repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import AnalysisConfig, Gene
from ..kernels.cutsite import windows_of
from ..kernels.locate import Evidence, best_evidence, candidates, segments
from ..kernels.score import Panel, window_score
from ..kernels.seeds import SeedIndex

CACHE = 16_384
SLICE_ROWS = 2048
HIT = "window int, gene_ix int, target_ix int, reason string, read_window string, left_x int, right_x int, is_rc boolean, recovered boolean, score double, whole_score double"
CALL = f"outcome string, gene_ix int, top1 double, top2 double, gap double, hits array<struct<{', '.join(x.replace(' ', ':', 1) for x in HIT.split(', '))}>>"


class Assigner:
    """Classifies reads against the windows of one reference set.

    outcome: assigned, ambiguous or filtered; gene_ix of an assigned read; top scores
    as they are (rounding is for reports); hits: every window of the assigned gene, or
    of all genes for other reads, with the reason where it isn't usable.
    """

    def __init__(self, genes: tuple[Gene, ...], config: AnalysisConfig, by_target: bool = False, with_hits: bool = True):
        self.with_hits = with_hits
        self.windows, self.genes, self.config = windows_of(genes), len(genes), config
        self.panel, self.seeds = Panel(self.windows, config.distance_weight, config.exclusion_flank), SeedIndex(self.windows)
        # what competes for a read: genes by their best window, or single windows
        self.rival = {w.number: w.number if by_target else w.gene_ix for w in self.windows}
        self.of_rival: dict[int, list] = {}
        for w in self.windows:
            self.of_rival.setdefault(self.rival[w.number], []).append(w)
        self.lone = by_target and len(self.windows) > 1  # a single usable window still has to lead nothing by the margin
        self.located = lru_cache(CACHE)(self._located)
        self.called = lru_cache(CACHE)(self._called)

    def _located(self, seq: str) -> dict[int, tuple]:
        """Candidates and reasons by window, of the windows that have a seed in the read; the others have no alignment."""
        return {n: candidates(seq, self.windows[n]) for n in self.seeds([text for _, text in segments(seq)])}

    def evidence(self, seq: str, passes: tuple[tuple[bool, ...], ...]) -> dict[int, Evidence | str]:
        return {n: best_evidence(seq, found, list(ok), reasons) for (n, (found, reasons)), ok in zip(self.located(seq).items(), passes, strict=True)}

    def _called(self, seq: str, passes: tuple[tuple[bool, ...], ...]) -> tuple:
        c, plain = self.config, self.evidence(seq, passes)
        usable = self.panel.completed(plain)
        scores = self.panel.scores(usable)
        best: dict[int, float] = {}
        for n in sorted(scores):
            best[self.rival[n]] = max(best.get(self.rival[n], -1.0), scores[n])
        ranked = sorted(best, key=lambda g: -best[g])
        top1 = best[ranked[0]] if ranked else None
        top2 = best[ranked[1]] if len(ranked) > 1 else 0.0 if ranked and self.lone else None
        gap = top1 - top2 if top2 is not None else None
        outcome = "filtered" if not ranked else "assigned" if gap is None or gap >= c.margin else "ambiguous"
        winner = ranked[0] if outcome == "assigned" else None
        gene = next((w.gene_ix for w in self.windows if self.rival[w.number] == winner), None)
        hits = []
        for w in () if not self.with_hits else self.windows if winner is None else self.of_rival[winner]:
            # outside the gene that a read was assigned to, only its own observations count
            e = usable.get(w.number) if gene is not None else None
            e = plain.get(w.number, "no_alignment") if e is None else e
            row = {"window": w.number, "gene_ix": w.gene_ix, "target_ix": w.target_ix, "reason": "ok", "read_window": None, "left_x": None, "right_x": None, "is_rc": None, "recovered": None, "score": scores.get(w.number), "whole_score": None}
            if isinstance(e, Evidence):
                row |= {"read_window": e.read_window, "left_x": e.left_x, "right_x": e.right_x, "is_rc": e.is_rc, "recovered": e.recovered}
                if outcome == "ambiguous":
                    row["whole_score"] = window_score(seq, w.ref)
            else:
                row["reason"] = e
            hits.append(row)
        return outcome, gene, top1, top2, gap, hits

    def __call__(self, seq: str | None, qual: str | None) -> tuple:
        seq = (seq or "").upper()
        found = self.located(seq)
        if qual:
            sums = np.concatenate(([0], np.cumsum(np.frombuffer(qual.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33)))
            good = lambda x: (n := min(x.qual_end, len(qual)) - min(x.qual_start, len(qual))) <= 0 or (sums[min(x.qual_end, len(qual))] - sums[min(x.qual_start, len(qual))]) / n >= self.config.phred
        else:
            good = lambda x: True
        return self.called(seq, tuple(tuple(bool(good(x)) for x in cands) for cands, _ in found.values()))


def assigned(reads: DataFrame, config: AnalysisConfig, config_key: str | None = None, by_target: bool = False, with_hits: bool = True) -> DataFrame:
    """reads (seq, qual and any other columns) with the columns of CALL.

    by_target: single targets compete, not genes; hits then hold the one that won.
    with_hits: without them a large panel's windows don't travel with every read of no gene.

    config_key: a column that names the input, for reference sets of its own
    (config.by_input; others use config.genes). Null sequences are filtered reads,
    null qualities pass.
    """
    call = _parse_datatype_string(CALL)
    own = [n for n in reads.columns if n not in call.names]
    call = call if with_hits else StructType([f for f in call.fields if f.name != "hits"])
    names = call.names
    schema = StructType([*(reads.schema[n] for n in own), *call.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key: dict[str | None, Assigner] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS if with_hits else max(1, batch.num_rows)):
                part = batch.slice(at, SLICE_ROWS) if with_hits else batch
                seqs, quals = part.column("seq").to_pylist(), part.column("qual").to_pylist()
                keys = part.column(config_key).to_pylist() if config_key else [None] * len(seqs)
                number: dict[tuple, int] = {}  # equal reads are one
                where = pa.array([number.setdefault(read, len(number)) for read in zip(seqs, quals, keys, strict=True)], pa.int32())
                rows = []
                for seq, qual, key in number:
                    key = key if key in config.by_input else None
                    if key not in by_key:
                        by_key[key] = Assigner(config.by_input.get(key, config.genes), config, by_target, with_hits)
                    rows.append(by_key[key](seq, qual))
                cols = {n: pa.array([r[i] for r in rows], arrow.field(n).type).take(where) for i, n in enumerate(names)}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else part.column(f.name) for f in arrow], schema=arrow)

    return reads.select(*own).mapInArrow(run, schema)
