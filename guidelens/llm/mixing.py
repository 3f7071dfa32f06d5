"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

The rates r_i of the documents of a source are the ones nearest to 1 in relative
entropy, between 0 and MOST, under which the source's words come to its target:

    min sum_i r_i log r_i - r_i   with   sum_i size_i r_i = target,  r_i <= MOST

The convex dual has one multiplier a source; its solution tilts rates
exponentially, r_i = min(MOST, exp(m * size_i)). Newton steps on the dual (on the
logarithm of its gradient, held inside a bracket that halves when a step leaves
it) run over distinct sizes by source, summed in a distributed aggregation each.
Rates become copies by a threshold on r_i plus a hash, moved for each source until
the words taken meet the target within a bin, and by single documents after that.

Sizes are numbers of words ([^\\x20\\x09-\\x0D]+), 0 for null texts. Targets: sources
in code-point order, null last, weigh WEIGHTS in turn, share SHARE of all words and
stop at MOST times their own; the excess is shared again by weight. Rows with equal
id, source and size are taken alike. Everything is a function of the rows, so
reruns agree. Sources without words have target 0 and take nothing. An empty table
gives no rows. A hot source is salted where its rows meet its figures. mixed() needs
doc_id, source and text only; mixture() keeps all columns, whatever their names. Texts
of any length are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, every_column, free_name, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SALTS = 64
STEPS = 4  # Newton steps a table
ROUNDS, NEAR = 12, 1e-9  # tables of steps, at most; relative error at which they end
BINS = 1024  # of the rounding threshold
REPAIRS = 6  # single documents moved a source, at most


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, total -> with target: by weight in turn, held at MOST times the total.

    Filling by weight stops sources in the order of room / weight, so the common
    level c comes from running sums in that order: the first c that holds for the
    sources after it. These windows see one row a source.
    """
    ranked = totals.withColumn("turn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("turn", F.lit(len(weights))) + 1)).withColumn("room", F.col("total") * F.lit(MOST))
    order = W.orderBy(F.col("room") / F.col("weight"), "turn")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("total").over(everything) * F.lit(share) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level is that of the first source, in filling order, that isn't filled up
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    filled = filled.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct("place", "level"))).over(everything))
    return filled.select("source", "total", "weight", F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("room")).otherwise(F.least(F.col("open.level") * F.col("weight"), F.col("room"))).alias("target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def rate(multiplier: Column, size: Column) -> Column:
    """min(MOST, exp(multiplier * size)), without overflow."""
    return F.exp(F.least(multiplier * size, F.lit(math.log(MOST))))


def with_figures(rows: DataFrame, figures: DataFrame, salt: Column) -> DataFrame:
    """rows with their source's figures; each source's rows meet them in SALTS groups."""
    kept = [c for c in figures.columns if c != "source"]
    dealt = figures.select(F.col("source").alias("_of"), *kept).withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_in", F.pmod(salt, F.lit(SALTS)).cast("int")).join(dealt, same("source", "_of") & (F.col("_in") == F.col("_salt"))).drop("_of", "_in", "_salt")


def balanced(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, multiplier: Newton's method on the dual over (source, size, n)."""
    low = F.when(F.col("target") < F.col("total"), F.log(F.col("target") / F.col("total"))).otherwise(0.0)
    high = F.when(F.col("target") < F.col("total"), 0.0).otherwise(math.log(MOST))
    mean = F.col("total") / F.col("n")
    counts = sizes.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("n"))
    first = F.log(F.col("target") / F.col("total")) / mean
    state = wanted.where((F.col("target") > 0) & (F.col("total") > 0)).join(counts, same("source", "_s")).select("source", F.col("total").cast("double").alias("total"), "target", low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, first)).alias("m"), F.lit(None).cast("double").alias("error"))
    state = written(state, "multipliers")
    for _ in range(ROUNDS):
        at = state
        for _ in range(STEPS):
            both = with_figures(sizes, at, F.xxhash64("size"))
            r = rate(F.col("m"), F.col("size")) * F.col("size") * F.col("n")
            slope = F.when(F.col("m") * F.col("size") < math.log(MOST), r * F.col("size")).otherwise(0.0)
            firsts = [F.first(c).alias(c) for c in ("total", "target", "low", "high")]
            at = both.groupBy("source", "m").agg(*firsts, F.sum(r).alias("g"), F.sum(slope).alias("h"))
            over = F.col("g") >= F.col("target")
            at = at.withColumn("low", F.when(over, F.col("low")).otherwise(F.col("m"))).withColumn("high", F.when(over, F.col("m")).otherwise(F.col("high")))
            newton = F.col("m") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("h")
            inside = (F.col("h") > 0) & (newton >= F.col("low")) & (newton <= F.col("high"))
            error = F.abs(F.col("g") / F.col("target") - 1)
            at = at.withColumn("error", error).withColumn("next", F.when(error <= NEAR, F.col("m")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)).select("source", "total", "target", "low", "high", F.col("next").alias("m"), "error")
        new = written(at, "multipliers")
        dropped(state)
        state = new
        if (state.agg(F.max("error")).first()[0] or 0.0) <= NEAR:
            return state.select("source", "m")
    raise ArithmeticError(f"rates haven't converged after {ROUNDS * STEPS} Newton steps")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken, source of every document."""
    units = written(sized(docs).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    sizes = written(units.groupBy("source", "size").agg(F.sum("times").alias("n")), "size-counts")
    wanted = written(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))), "targets")
    multipliers = balanced(sizes, wanted)
    figures = wanted.join(multipliers.select(F.col("source").alias("_s"), "m"), same("source", "_s"), "left").drop("_s", "weight")

    salt = F.xxhash64("doc_id", "size")
    full = F.when(F.col("target") >= F.col("total") * MOST, F.lit(MOST)).otherwise(rate(F.col("m"), F.col("size")))
    rated = with_figures(units, figures, salt).withColumn("rate", F.when(F.col("target") > 0, F.coalesce(full, F.lit(0.0))).otherwise(0.0))
    # 53 bits of a hash of the id, in [0, 1)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "size"), 11) * F.lit(2.0**-53)
    base = F.floor("rate").cast("bigint")
    # the copy beyond the whole ones is taken where edge >= a threshold; 1 is the unbiased one
    rated = rated.withColumn("base", base).withColumn("edge", F.when(F.col("rate") >= MOST, F.lit(-1.0)).otherwise(F.col("rate") - base + unit))
    rated = written(rated.withColumn("words", F.col("size") * F.col("times")), "rates")

    # the threshold bin at which a source's words come nearest to its target
    bins = rated.groupBy("source", F.floor(F.col("edge") * (BINS / 2)).alias("bin")).agg(F.sum(F.when(F.col("edge") >= 0, F.col("words")).otherwise(0)).alias("extra"), F.sum(F.col("words") * F.col("base")).alias("sure"))
    down = W.partitionBy("source").orderBy(F.desc("bin"))  # BINS rows a source at most
    sums = bins.withColumn("taken", F.sum("extra").over(down) + F.sum("sure").over(W.partitionBy("source")))
    first = bins.groupBy("source").agg(F.sum("sure").alias("taken")).withColumn("bin", F.lit(BINS + 1).cast("bigint"))
    cut = sums.where("bin >= 0").select("source", "taken", "bin").unionByName(first.select("source", "taken", "bin"))
    cut = cut.join(wanted.select(F.col("source").alias("_s"), "target"), same("source", "_s")).groupBy("source").agg(F.min_by(F.struct("bin", "taken"), F.struct(F.abs(F.col("taken") - F.col("target")), F.abs(F.col("bin") - BINS // 2))).alias("cut"))
    cut = cut.select("source", F.col("cut.bin").alias("cut"), F.col("cut.taken").alias("so_far"))
    copies = F.col("base") + F.when((F.col("edge") >= 0) & (F.floor(F.col("edge") * (BINS / 2)) >= F.col("cut")), 1).otherwise(0)
    rounded = written(with_figures(rated, cut, salt).select("doc_id", "source", "size", "times", F.col("total").alias("source_size"), "target", "rate", "words", copies.cast("bigint").alias("copies")), "copies")

    # what is still missing, by the single documents whose words fit it best
    moved = None
    gap = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("words") * F.col("copies"))).alias("gap"))
    for _ in range(REPAIRS):
        gap = written(gap, "gaps")
        free = with_figures(rounded.where("words > 0"), gap, salt)
        room = F.when(F.col("gap") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        better = F.abs(F.abs("gap") - F.col("words")) < F.abs("gap")
        free = free.where(room & better)
        if moved is not None:
            free = free.join(moved.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z")), same("doc_id", "_d") & same("source", "_s") & (F.col("size") == F.col("_z")), "left_anti")
        pick = free.groupBy("source").agg(F.min_by(F.struct("doc_id", "size", "words", F.signum("gap").cast("bigint").alias("change")), F.struct(F.abs(F.abs("gap") - F.col("words")), "doc_id", "size")).alias("p"))
        pick = written(pick.select("source", "p.*"), "moved")
        gap = gap.join(pick.select(F.col("source").alias("_s"), (F.col("words") * F.col("change")).alias("by")), same("source", "_s"), "left").select("source", (F.col("gap") - F.coalesce("by", F.lit(0))).alias("gap"))
        moved = pick if moved is None else moved.unionByName(pick)
    change = moved.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "change")
    out = rounded.join(change, same("doc_id", "_d") & same("source", "_s") & (F.col("size") == F.col("_z")), "left")
    out = out.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies", "source")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as its copies, with all its columns, whatever their names."""
    doc_id, source, size, copies, copy = (free_name(x, docs) for x in ("d", "s", "size", "copies", "copy"))
    taken = mixed(docs).where("copies > 0").select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).distinct()
    words_of = free_name("words", docs)
    out = docs.withColumn(words_of, words(F.col("text"))).join(taken, same("doc_id", doc_id) & same("source", source) & (F.col(words_of) == F.col(size)))
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*every_column(docs))
