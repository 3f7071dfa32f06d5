"""Chat formatting: one rendering of a dialogue for each of its speakers; DataFrame functions only.

Every distinct role of a conversation, other than NARRATORS, is a participant. Its
rendering shows its own turns as the assistant's, other participants' as turns of
named users, and narrators' as they are. The mask lists the stretches (code points,
end exclusive) that are trained on: the text and end mark of the assistant's turns.

Turns are ordered by turn (null ones last), role and text. A rendering comes in rows of
up to SEGMENT turns, so that no row or task holds an unbounded dialogue: its texts in
order of segment, one after the other, are the whole rendering; first is where a row's
text begins in it, and masks are of the whole rendering too, so masks are joined by commas
likewise. A dialogue of up to SEGMENT turns is its segment 0. Only the turns of longer ones
are numbered, by common.numbered(), which spreads equal and null turn numbers as well.

Null roles are the speaker `unknown`; null texts are empty; a null conv_id is one
conversation; repeated rows are repeated turns, and ties are equal turns. `<|` in a
text is written `< |`, so that no text can open a turn. Texts of any length are taken
whole. Conversations of narrators only, and empty tables, give no rows. Columns other
than conv_id, turn, role and text, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked, numbered, written

SEGMENT = 4096  # turns of a row, at most
NARRATORS = ("system",)
ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"
SALTS = 64
LAST = (1 << 63) - 1  # where null turns stand
FEW = 200_000  # long conversations that are broadcast; more are joined by shuffle


def piece(role: Column, speaker: Column, text: Column) -> tuple[Column, Column]:
    """A turn's opening mark, and its text with the end mark."""
    opening = F.when(role == speaker, F.lit(ASSISTANT)).when(role.isin(*NARRATORS), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
    return opening, F.concat(text, F.lit(END))


def opening_as_user(role: Column) -> Column:
    return F.length(piece(role, F.lit(None).cast("string"), F.lit(""))[0])


def long_segments(cut: DataFrame, line: Column, is_speaker: Column) -> DataFrame:
    """conv_id, segment, speaker, turns, first of the dialogues in cut, which are long."""
    salted = cut.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    rows = written(numbered(salted, ["conv_id"], ["place", "role", "text", "salt"], "chat-order").withColumn("segment", F.floor(F.col("number") / SEGMENT)), "chat-turns")
    turned = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    # where a segment begins: everyone shown as a user, put right by the speaker's own turns before
    size = opening_as_user(F.col("role")) + F.length("text") + len(END)
    before = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "segment").agg(F.sum(size).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    speakers = rows.where(is_speaker).groupBy("conv_id", F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("_"))
    own = rows.where(is_speaker).groupBy(F.col("conv_id").alias("of"), F.col("segment").alias("in"), F.col("role").alias("by")).agg(F.count(F.lit(1)).alias("n"))
    both = sizes.join(speakers.select(F.col("conv_id").alias("of"), "speaker"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    both = both.join(own, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("in")) & (F.col("speaker") == F.col("by")), "left")
    earlier = W.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    change = F.lit(len(ASSISTANT)) - opening_as_user(F.col("speaker"))
    first = F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0)) * change
    starts = both.select(F.col("conv_id").alias("of"), F.col("segment").alias("in"), "speaker", first.alias("first"))
    return turned.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("in"))).select("conv_id", "segment", "speaker", "turns", "first")


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, speaker, n_turns, n_assistant, first, text, mask (start:end, comma-joined)."""
    place = F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("place")
    turns = conversations.select("conv_id", place, F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    line, is_speaker = F.struct("place", "role", "text"), ~F.col("role").isin(*NARRATORS)
    long = written(turns.groupBy(F.col("conv_id").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SEGMENT).select("of"), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    if long.isEmpty():
        short, both = turns, None
    else:
        few = checked(long, FEW)
        short, both = turns.join(few, same, "left_anti"), long_segments(turns.join(few, same, "left_semi"), line, is_speaker)
    whole = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    names = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t.role.isin(*NARRATORS)), lambda t: t.role))
    whole = whole.select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.explode(names).alias("speaker"), "turns", F.lit(0).cast("bigint").alias("first"))
    both = whole if both is None else whole.union(both)

    def one(t: Column) -> Column:
        opening, rest = piece(t.role, F.col("speaker"), t.text)
        return F.struct(opening.alias("opening"), rest.alias("rest"), (t.role == F.col("speaker")).alias("own"))

    lines = both.withColumn("lines", F.transform("turns", one))
    start = F.struct(F.col("first").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        a = s.at + F.length(t.opening)
        b = a + F.length(t.rest)
        return F.struct(b.alias("at"), F.when(t.own, F.concat(s.spans, F.array(F.concat_ws(":", a.cast("string"), b.cast("string"))))).otherwise(s.spans).alias("spans"))

    return lines.select(
        "conv_id", "segment", "speaker", F.size("turns").cast("bigint").alias("n_turns"), F.size(F.filter("lines", lambda t: t.own)).cast("bigint").alias("n_assistant"), "first",
        F.array_join(F.transform("lines", lambda t: F.concat(t.opening, t.rest)), "").alias("text"), F.array_join(F.aggregate("lines", start, step, lambda s: s.spans), ",").alias("mask"),
    )


#: DuckDB SQL for the same rows.
PERSPECTIVES_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // {SEGMENT} AS segment FROM r),
s AS (SELECT DISTINCT conv_id AS of_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (SELECT t.*, speaker, CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS opening,
    text || '<|end|>' || chr(10) AS rest FROM t JOIN s ON conv_id IS NOT DISTINCT FROM of_id),
y AS (SELECT *, sum(length(opening) + length(rest)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM x)
SELECT conv_id, segment, speaker, count(*) AS n_turns, count(*) FILTER (role = speaker) AS n_assistant,
  CAST(min(stop - length(opening) - length(rest)) AS BIGINT) AS first, string_agg(opening || rest, '' ORDER BY stop) AS text,
  coalesce(string_agg(CAST(stop - length(rest) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop) FILTER (role = speaker), '') AS mask
FROM y GROUP BY conv_id, segment, speaker"""
