"""Kernels as functions for SQL text: vectorised over Arrow batches, null where an argument is null."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig, Gene, Target
from ..kernels import cutsite, matching, mutate, pairwise
from ..operators.assign import Assigner
from ..operators.workspace import register_functions


@lru_cache(256)
def _one_target(reference: str, guide: str, phred: float) -> Assigner:
    genes = (Gene("gene", reference, (Target("target", guide),)),)
    return Assigner(genes, AnalysisConfig(genes, phred=phred))


def _located(seq: str, qual: str, reference: str, guide: str, phred: float) -> tuple:
    hit = _one_target(reference, guide, float(phred))(seq, qual)[5][0]
    return hit["reason"], hit["read_window"], hit["is_rc"]


def _cut(reference: str, guide: str) -> tuple:
    site = cutsite.find_cut_site(reference, guide)
    return site.strand, site.cut, site.start, site.end, site.pam_found


def _edit(reference: str, read: str) -> tuple:
    c = mutate.call(reference.upper(), read.upper(), *matching.x_runs(read.upper()))
    return c.category, c.has_sub, c.net_indel


#: Name in SQL: number of arguments, kernel, result.
FUNCTIONS = {
    "edit_distance_within": (3, matching.within_edits, "int"),
    "base_mismatches": (2, matching.mismatches, "int"),
    "reference_identity": (2, lambda a, b: pairwise.compare_references(a, b)[0], "double"),
    "homoeolog_similarity": (2, pairwise.homoeolog_similarity, "double"),
    "difference_bp": (2, pairwise.difference_bp, "int"),
    "project_position": (3, pairwise.project_position, "int"),
    "guide_cut_site": (2, _cut, "strand string, cut int, guide_start int, guide_end int, pam_found boolean"),
    "locate_target": (5, _located, "reason string, read_window string, is_rc boolean"),
    "edit_call": (2, _edit, "category string, has_sub boolean, net_indel int"),
}


def vectorised(kernel, returns: str):
    """A pandas UDF of any number of columns from a function of values."""
    names = [c.split()[0] for c in returns.split(", ")] if " " in returns else None

    def values(columns):
        known: dict[tuple, object] = {}  # of one batch
        out = []
        for row in zip(*columns, strict=True):
            if row not in known:
                known[row] = None if any(pd.isna(x) for x in row) else kernel(*row)
            out.append(known[row])
        return out

    def one(*columns: pd.Series) -> pd.Series:
        return pd.Series(values(columns), dtype=object)

    def several(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([r if r is not None else (None,) * len(names) for r in values(columns)], columns=names, dtype=object)

    return F.pandas_udf(several if names else one, returns)


def register(spark: SparkSession) -> None:
    """All of FUNCTIONS, and the table function find_orfs, in the session."""
    register_functions(spark)
    for name, (_, kernel, returns) in FUNCTIONS.items():
        spark.udf.register(name, vectorised(kernel, returns))
