"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines) are cut into pieces of PIECE_WORDS words; the set of
the pieces' 64-bit digests is hashed into cells of (count, xor of keys, xor of
checks), three cells a key. Two sketches of one size subtract cell by cell; what is
left holds only the keys that differ, and peeling cells with a single key recovers
them. When peeling stops early, both sketches are made again GROW times larger.
The likeness of two texts is shared / all keys, from the recovered differences.

A fingerprint is the sketch with CELLS cells: a fixed size, whatever the text's.
Null and empty texts have no keys; two empty sets have likeness 1. Words over
LONG_WORD bytes are cut into pieces of their own. Equal texts have equal
fingerprints. Whole slices of texts are sketched and peeled at once in numpy.

successors() gives each document the next one by id without one global sort: ids, of
the whole 64-bit range, are cut at quantiles, and the first document of each range is also dealt to the
range before it (that of the first range to the last). Null ids come first; rows
with one id are ordered by text, and each of them has a next document. An empty table
gives no rows. Columns other than doc_id and text, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import SLICE_ROWS, slices_of

CELLS, GROW = 15, 4
PIECE_WORDS, LONG_WORD = 8, 64
RANGES_EACH, MAX_RANGES = 4, 8192  # ranges of ids: so many a shuffle partition, at most so many
FIRST_ID = -(1 << 63)


def pieces(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(line, piece) of a text in order."""
    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if len(line) > LONG_WORD and words and max(map(len, words)) > LONG_WORD:
            words = [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]
        for i in range(0, len(words), PIECE_WORDS):
            yield at, b" ".join(words[i : i + PIECE_WORDS])


def keys(text: str | None) -> np.ndarray:
    """Distinct digests of a text's pieces, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(p) for _, p in pieces(text)], np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _check(x: np.ndarray) -> np.ndarray:
    return _mix(x, 77) & np.uint64(0xFFFFFFFF)


class Sketches:
    """Many sketches side by side; each has `cells` cells (a multiple of three)."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def places(self, owner: np.ndarray, x: np.ndarray, j: int) -> np.ndarray:
        third = self.cells // 3
        return owner * self.cells + j * third + (_mix(x, 1000 * j + self.cells) % np.uint64(third)).astype(np.int64)

    def add(self, owner: np.ndarray, x: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        c = _check(x)
        for j in range(3):
            at = self.places(owner, x, j)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, x)
            np.bitwise_xor.at(self.check, at, c)
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of what is recovered, and which sketches came out empty; uses self up."""
        owners, found, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_check(self.key[at]) == self.check[at]]
            if not len(at):
                break
            owner, x, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((x, owner))
            owner, x, sign = owner[order], x[order], sign[order]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])))
            owner, x, sign = owner[new], x[new], sign[new]
            self.add(owner, x, -sign)
            owners.append(owner)
            found.append(x)
            signs.append(sign)
        left = (self.count != 0) | (self.key != 0)
        empty = ~left.reshape(self.n, self.cells).any(1)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return cat(owners, np.int64), cat(found, np.uint64), cat(signs, np.int64), empty

    def strings(self, sizes: list[int]) -> list[str]:
        """Number of keys, then count (int32), key (64 bits) and check (32 bits) of all cells in base 64."""
        packed = np.zeros(self.n * self.cells, np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        packed["count"], packed["key"], packed["check"] = self.count, self.key, self.check
        rows = packed.reshape(self.n, self.cells)
        return [f"{k}:{base64.b64encode(r.tobytes()).decode()}" for k, r in zip(sizes, rows, strict=True)]


def sketched(sets: list[np.ndarray], cells: int) -> Sketches:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return Sketches(len(sets), cells).add(owner, np.concatenate(sets) if sets else np.zeros(0, np.uint64))


def differences(a: list[np.ndarray], b: list[np.ndarray], start: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sets: keys only in the first, and only in the second, from sketches alone."""
    out: list = [None] * len(a)
    todo, cells = np.arange(len(a)), CELLS
    while len(todo):
        if start is None or cells > CELLS:
            start = sketched([a[i] for i in todo], cells), sketched([b[i] for i in todo], cells)
        owner, x, sign, empty = start[0].minus(start[1]).peel()
        order = np.argsort(owner, kind="stable")
        owner, x, sign = owner[order], x[order], sign[order]
        edge = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(empty):
            own, s = x[edge[k] : edge[k + 1]], sign[edge[k] : edge[k + 1]]
            out[todo[k]] = (own[s > 0], own[s < 0])
        todo, cells = todo[~empty], cells * GROW
    return out


def likeness(n: int, only: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared / all keys, from the size of the first set and the differences."""
    every = n + len(only[1])
    return (n - len(only[0])) / every if every else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter (floor) of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def bound_list(bounds: list[int]) -> F.Column:
    return F.array(*(F.lit(b).cast("bigint") for b in bounds))


def last_bound(bounds: list[int]) -> F.Column:
    """Number of the last bound that isn't above the column at, by binary search."""
    every, count = bound_list(bounds), len(bounds)

    def step(s: F.Column, _: F.Column) -> F.Column:
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        up = F.get(every, middle) <= F.col("at")
        return F.when(s.lo + 1 >= s.hi, s).otherwise(F.struct(F.when(up, middle).otherwise(s.lo).alias("lo"), F.when(up, s.hi).otherwise(middle).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, count.bit_length()))), F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi")), step, lambda s: s.lo)


def successors(docs: DataFrame, run) -> DataFrame | None:
    """Rows sorted so that run() sees, in each range of ids, the documents in order and at last the next range's first one."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(FIRST_ID)).alias("at"))
    wanted = min(MAX_RANGES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # quantiles are doubles, so they only say where about to cut; the least ids above them are exact
    cuts = rows.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    near = sorted({FIRST_ID, *(min(int(c), -FIRST_ID - 1) for c in cuts)})
    lows = rows.select(last_bound(near).alias("range"), "at").groupBy("range").agg(F.min("at").alias("low")).collect()
    if not lows:
        return None
    bounds = sorted(r["low"] for r in lows)
    count = len(bounds)
    dealt = rows.withColumn("range", last_bound(bounds))
    first = F.get(bound_list(bounds), F.col("range")) == F.col("at")
    both = F.array(F.struct(F.col("range"), F.lit(0).alias("ahead")), F.struct(F.pmod(F.col("range") - 1, F.lit(count)).alias("range"), F.lit(1).alias("ahead")))
    dealt = dealt.select("doc_id", "text", "at", F.explode(F.when(first, both).otherwise(F.slice(both, 1, 1))).alias("in")).select("doc_id", "text", "at", "in.range", "in.ahead")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "at", "text").select("doc_id", "text", "range", "ahead").mapInArrow(run, OUT)


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    empty = docs.sparkSession.createDataFrame([], OUT)
    schema = to_arrow_schema(empty.schema)

    def compared(pairs: list[tuple]) -> pa.RecordBatch:
        """pairs: (doc_id, text, its keys, next text, its keys)."""
        own, following = [p[2] for p in pairs], [p[4] for p in pairs]
        texts = [edited(p[1], p[3]) for p in pairs]
        changed = [keys(t) for t in texts]
        a, b, c = sketched(own, CELLS), sketched(changed, CELLS), sketched(following, CELLS)
        near_edited = [likeness(len(k), d) for k, d in zip(own, differences(own, changed, (a, b)), strict=True)]
        near_next = [likeness(len(k), d) for k, d in zip(own, differences(own, following, (a, c)), strict=True)]
        cols = [[p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], a.strings([len(k) for k in own]), b.strings([len(k) for k in changed]), near_edited, near_next]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, pairs = batch.slice(at, SLICE_ROWS).to_pydict(), []
                for doc_id, text, where, ahead in zip(part["doc_id"], part["text"], part["range"], part["ahead"], strict=True):
                    if ahead and (held is None or held[3] != where):
                        continue  # a further row with the first id of the next range
                    k = keys(text)
                    if held is not None and held[3] == where:
                        pairs.append((*held[:3], text, k))
                    held = None if ahead else (doc_id, text, k, where)
                if pairs:
                    yield compared(pairs)

    out = successors(docs, run)
    return empty if out is None else out


CHANGES = "side string, digest string, paragraph int, piece string"


def changes(versions_of: DataFrame, id_column: str = "doc_id", old: str = "old_text", new: str = "new_text") -> DataFrame:
    """id_column, side (removed or added), digest, paragraph (line, from 0) and piece: what differs between two versions of each text, by peeling the difference of their sketches.

    A piece that a version holds several times is shown for each of its places. Null
    texts are empty; equal versions have no rows; repeated ids are rows of their own.
    """
    rows = versions_of.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{old}`").alias("old"), F.col(f"`{new}`").alias("new"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *_parse_datatype_string(CHANGES).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches):
            before, after = part.column("old").to_pylist(), part.column("new").to_pylist()
            found = []
            for i, only in enumerate(differences([keys(t) for t in before], [keys(t) for t in after])):
                for side, text, digests in (("removed", before[i], only[0]), ("added", after[i], only[1])):
                    wanted = set(digests.tolist())
                    for at, piece in pieces(text) if wanted else ():
                        if (digest := xxhash.xxh64_intdigest(piece)) in wanted:
                            found.append((i, side, f"{digest:016x}", at, piece.decode("utf-8", "replace")))
            where = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(where), *(pa.array([f[1 + k] for f in found], f_.type) for k, f_ in enumerate(list(arrow)[1:]))], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
