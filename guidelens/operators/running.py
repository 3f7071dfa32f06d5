"""Ranks and running sums over one very large group, in many tasks.

Rows are ordered by falling count, then by a read number. A cell holds the rows of one
count whose numbers share a block of BLOCK; cells of a group, in order, are few, so
a first level adds them up, and a second numbers the rows within their cells. Rows of a
cell have one count, so its running sum needs no more than their numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 20  # rows of a cell at most, where read numbers differ


def with_running(table: DataFrame, scope: tuple[str, ...], count: str, order: str, block: int = BLOCK) -> DataFrame:
    """table with _rank (from 1) and _running (the counts up to and with the row) within scope, by falling count and rising order (an integer).

    Null scopes and orders are values like any other; null counts come last and add
    nothing. Ties in order are broken arbitrarily.
    """
    cell = [*scope, count, "_block"]
    cut = table.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    within = cut.withColumn("_nth", F.row_number().over(W.partitionBy(*cell).orderBy(order)))
    sizes = within.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*scope).orderBy(F.desc(count), "_block").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in cell), F.coalesce(F.sum("_n").over(before), none).alias("_before"), F.coalesce(F.sum(F.col("_n") * F.col(count)).over(before), none).alias("_sum"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell))
    out = within.join(starts, same)
    rank, total = F.col("_before") + F.col("_nth"), F.col("_sum") + F.col("_nth") * F.coalesce(F.col(count), none)
    return out.select(*table.columns, rank.alias("_rank"), total.alias("_running"))
