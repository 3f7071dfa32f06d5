"""FASTQ files of any size, each in many tasks, with the rows and numbers that one task gives.

Lines come in blocks: byte ranges that Spark's text reader cuts an uncompressed file
into, on any file system that Spark reads; ranges of a block-gzip file, whose members
are cut at their own headers (block_gzip, on storage that executors mount); or a whole
file of another compression. A record has four lines and any line can begin with @, so
where a block's first record starts depends on all lines before it. But a block is a
function of four cases only, the lines that its first record has had already: each
gives the case at the block's end and the records between. A first pass finds these
functions, which run through a file's blocks in order (one small row a block); so do
the records' numbers, and the records that blocks cut are put together from the blocks'
first and last three lines. The second pass parses every block from its own first record.

Null-free output for any input: empty files and files without records give no rows,
lines that open no record are passed over, an incomplete last record is dropped, and
equal names in different folders stay apart by their numbers only.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fastq import SCHEMA, batches, records
from .shared import written

LINES = "path string, start long, value binary"
BLOCK = "path string, start long, n long, outs array<int>, counts array<long>, head array<binary>, tail array<binary>"
PLACED = "path string, start long, skip int, first long, read_id string, seq string, qual string"
MOST_BLOCKS = 1_000_000  # of one read, whose starts travel to every task (some 100 bytes each); larger splits make fewer
MEMBER = b"\x1f\x8b\x08\x04"  # a gzip member with an extra field, as block-gzip has


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of files, in order within their blocks. The relation is one object, so both passes see the same files in the same splits."""
    df = spark.read.text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def members(path: str, start: int, end: int) -> Iterator[bytes]:
    """The unpacked block-gzip members that begin in a byte range, an empty text, and those after it, for who still needs a line's end."""
    with open(path, "rb") as f:
        at = start
        if start:  # members are at most 64 KB, so one begins within twice that, or the range has none
            f.seek(start)
            near, at = f.read(1 << 17), None
            for k in range(len(near) - 18):
                if near[k : k + 4] == MEMBER and near[k + 12 : k + 16] == b"BC\x02\x00":
                    size = int.from_bytes(near[k + 16 : k + 18], "little") + 1
                    after = near[k + size : k + size + 4]
                    if after == MEMBER or not after:
                        at = start + k
                        break
            if at is None:
                return
        told = False
        while True:
            if at >= end and not told:
                told = True
                yield b""
            f.seek(at)
            head = f.read(18)
            if len(head) < 18:
                return
            if head[:4] != MEMBER or head[12:16] != b"BC\x02\x00":
                raise ValueError(f"{path} isn't block-gzip at {at}")
            size = int.from_bytes(head[16:18], "little") + 1
            f.seek(at + 18)
            text = zlib.decompress(f.read(size - 18), -15)
            at += size
            if text:
                yield text


def range_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a block-gzip file that begin in the members of a byte range, other than in its first one's broken start."""
    held, own, first = b"", True, start > 0
    for text in members(path, start, end):
        if not text:  # the range's own members end here; the line that begins just there is the last one, since the next range leaves out its first
            own = False
            if first:
                return
            continue
        *whole, held = (held + text).split(b"\n")
        if first and whole:
            whole, first = whole[1:], False  # it began in an earlier member
        if not own:
            if whole:
                yield whole[0].removesuffix(b"\r")
                return
            continue
        for line in whole:
            yield line.removesuffix(b"\r")
    if held and not first:
        yield held.removesuffix(b"\r")


def block_gzip_lines(spark: SparkSession, paths: list[str], split: int) -> DataFrame:
    """lines_of() for block-gzip files: a task a range of about split bytes."""
    ranges = [(p, at, min(at + split, size)) for p in paths for size in [os.path.getsize(p)] for at in range(0, size, split)]
    dealt = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(max(1, len(ranges)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start, stop in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found: list[bytes] = []
                lines, path = range_lines(path, start, stop), quote(path)
                for line in lines:
                    found.append(line)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([start] * len(found), pa.int64()), pa.array(found, pa.binary())], ["path", "start", "value"])
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([start] * len(found), pa.int64()), pa.array(found, pa.binary())], ["path", "start", "value"])

    return dealt.mapInArrow(run, LINES)


def by_block(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[list[bytes]]]]:
    """Each block of lines, as lists of them that are made when asked for."""
    ended = object()

    def slices() -> Iterator[tuple[tuple[str, int], list[bytes]]]:
        for part in parts:
            if not part.num_rows:
                continue
            path, start, value = (part.column(n) for n in ("path", "start", "value"))
            names, starts = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
            new = np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1
            for low, high in zip([0, *new], [*new, part.num_rows], strict=True):
                yield (path[int(low)].as_py(), int(starts[low])), value.slice(low, high - low).to_pylist()

    rest = slices()
    held = next(rest, ended)
    while held is not ended:
        key = held[0]

        def mine() -> Iterator[list[bytes]]:
            nonlocal held
            while held is not ended and held[0] == key:
                lines = held[1]
                held = next(rest, ended)
                yield lines

        block = mine()
        yield key, block
        for _ in block:
            pass


class BlockFunction:
    """What a block does to each of the four cases, told line by line: a few lines are held, however many a block has.

    Case c: the block's first record has had c lines. `at` is the line at which a case
    looks for its next record; cases that look at the same one go on as one.
    """

    def __init__(self) -> None:
        self.n = 0  # lines so far
        self.at = [(4 - c) % 4 for c in range(4)]
        self.counts = [0] * 4
        self.flags = [np.empty(0, bool)] * 3  # of the lines held: opens a record, has bases, has qualities

    def add(self, heads: np.ndarray, bases: np.ndarray, quals: np.ndarray, keep_empty: bool) -> None:
        """The block's next lines. heads: lines that can open a record; bases, quals: those that aren't empty as one or the other."""
        heads, bases, quals = (np.concatenate(both) for both in zip(self.flags, (heads, bases, quals), strict=True))
        low = self.n - len(self.flags[0])  # the first line held
        n = self.n = low + len(heads)
        whole = max(0, len(heads) - 3)  # lines whose record would end here
        kept = np.ones(whole, bool) if keep_empty else bases[1 : whole + 1] & quals[3:]
        going: dict[int, tuple[int, int]] = {}
        for case, start in enumerate(self.at):
            if start not in going:
                going[start] = self._through(start, low, heads, kept)
            self.at[case], more = going[start]
            self.counts[case] += more
        stay = min(3, len(heads))  # a case that waits does so at one of the last three lines, or after them
        self.flags = [x[len(x) - stay :] for x in (heads, bases, quals)]

    def _through(self, start: int, low: int, heads: np.ndarray, kept: np.ndarray) -> tuple[int, int]:
        """Where a case that looks from line `start` looks after these lines, and the kept records it passes."""
        at, count, n = start - low, 0, len(heads)
        while at < n:
            if not heads[at]:
                found = int(heads[at:].argmax())
                at = at + found if heads[at + found] else n
                continue
            if at + 4 > n:
                break
            row = heads[at : n - 3 : 4]  # the next records, if each begins where the last one ends
            run = len(row) if row.all() else int(row.argmin())
            count += int(kept[at : at + 4 * run : 4].sum())
            at += 4 * run
        return low + at, count

    def result(self) -> tuple[list[int], list[int]]:
        """For 0 to 3 lines that the first record has had: those that the last one has had at the block's end, and the kept records that begin and end within."""
        return [c + self.n if at > self.n and c else self.n - at for c, at in enumerate(self.at)], list(self.counts)


def functions(lines: DataFrame, keep_empty: bool) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), block in by_block(parts):
            function, head, tail = BlockFunction(), [], []
            for found in block:
                texts = [x.decode("latin-1").strip() for x in found]
                function.add(np.array([x.startswith("@") for x in texts], bool), np.array([bool(x) for x in texts], bool), np.array([bool(x) for x in found], bool), keep_empty)
                head = (head + found[:3])[:3]
                tail = (tail + found[-3:])[-3:]
            n, (outs, counts) = function.n, function.result()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([outs], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64())), pa.array([head], pa.list_(pa.binary())), pa.array([tail], pa.list_(pa.binary()))], ["path", "start", "n", "outs", "counts", "head", "tail"])

    return lines.mapInArrow(run, BLOCK)


def placed(blocks: DataFrame, keep_empty: bool, token_ids: bool) -> DataFrame:
    """For each block how many lines to skip and the number of its first record; and the records that blocks cut, with their numbers (skip is null)."""

    def run(file: pd.DataFrame) -> pd.DataFrame:
        rows, case, number, cut = [], 0, 0, []
        for b in file.sort_values("start").itertuples():
            skip = (4 - case) % 4
            if skip > b.n:
                rows.append((b.path, b.start, skip, number, None, None, None))
                cut += list(b.head)[: b.n]
                case += b.n
                continue
            if skip:
                cut += list(b.head)[:skip]
                for found in records((x.decode("latin-1") for x in cut), keep_empty, token_ids):
                    rows.append((b.path, b.start, None, number, *found))
                    number += 1
            rows.append((b.path, b.start, skip, number, None, None, None))
            number += b.counts[case]
            case = b.outs[case]
            cut = list(b.tail)[-case:] if case else []
        return pd.DataFrame(rows, columns=["path", "start", "skip", "first", "read_id", "seq", "qual"]).astype({"skip": "Int32"})

    return blocks.groupBy("path").applyInPandas(run, PLACED)


def base_name(path: str) -> str:
    """Of a path as Spark gives it, escaped."""
    return unquote(path).rsplit("/", 1)[-1]


def read(spark: SparkSession, paths: list[str], keep_empty: bool = False, token_ids: bool = False, block_gzip: bool = False, split: int = 64 << 20) -> DataFrame:
    """The records of FASTQ files, as the source "fastq" gives them, each file in as many tasks as it has blocks.

    paths: files or folders, as Spark's readers take them; with block_gzip files on
    storage that the driver and all executors mount, in ranges of split bytes. The
    first pass runs at once, the second when the result is read.
    """
    lines = block_gzip_lines(spark, paths, split) if block_gzip else lines_of(spark, paths)
    found = written(placed(functions(lines, keep_empty), keep_empty, token_ids), "fastq-blocks")
    starts = found.where("skip IS NOT NULL").select("path", "start", "skip", "first")
    if (n := starts.count()) > MOST_BLOCKS:
        raise ValueError(f"{n} blocks: raise spark.sql.files.maxPartitionBytes")
    known = spark.sparkContext.broadcast({(r.path, r.start): (r.skip, r.first) for r in starts.collect()})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in by_block(parts):
            if key not in known.value:
                raise RuntimeError(f"{key} is no block of the first pass: files or split sizes changed since")
            skip, first = known.value[key]
            text = (x.decode("latin-1") for some in block for x in some)
            for _ in range(skip):
                next(text, None)
            yield from batches(base_name(key[0]), records(text, keep_empty, token_ids), first)

    cut = found.where("skip IS NULL").select("path", F.col("first").alias("read_index"), "read_id", "seq", "qual")
    name = F.url_decode(F.replace(F.regexp_extract("path", "[^/]*$", 0), F.lit("+"), F.lit("%2B")))
    return lines.mapInArrow(run, SCHEMA).unionByName(cut.select(name.alias("file"), "read_index", "read_id", "seq", "qual"))
