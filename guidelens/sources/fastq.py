"""FASTQ files as a data source: one partition a file, records numbered in file order.

The driver lists files and executors open them as local paths, so they must be on
storage that all of them mount. splits.read() gives the same rows from any file system
that Spark reads, and large files in many tasks; read_binary() takes small files whole, and
stream() those that arrive in a folder.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, read_index bigint, read_id string, seq string, qual string"
BATCH = 10_000
WHOLE = 8 << 20  # bytes of a file that is read as one row


def records(lines: Iterable[str], keep_empty: bool = False, token_ids: bool = False) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) of four-line records.

    A line that opens no record (blank, or not @) is passed over; a record takes four
    lines whatever they start with, so a quality line may begin with @. An incomplete
    last record is dropped, and so are records without bases or qualities (unless
    keep_empty).
    """
    rows = iter(lines)
    for line in rows:
        head = line.rstrip("\r\n")
        if not head.strip().startswith("@"):
            continue
        rest = [next(rows, None) for _ in range(3)]
        if rest[2] is None:
            return
        name, seq, qual = head.strip()[1:], rest[0].strip(), rest[2].rstrip("\r\n")
        name = (name.split() or [""])[0] if token_ids else name
        if keep_empty or (seq and qual):
            yield name, seq.upper(), qual


def opened(path: str):
    return io.TextIOWrapper(gzip.open(path) if path.endswith(".gz") else open(path, "rb"), encoding="latin-1", newline="")


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    names = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sorted(n for n in names if os.path.isfile(n) and n.lower().endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz")))


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def batches(name: str, found: Iterator[tuple[str, str, str]], first: int = 0) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    names = ["file", "read_index", "read_id", "seq", "qual"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for i, r in enumerate(found, first):
        rows.append((name, i, *r))
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path); options keepEmpty, idMode=token."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))


def _flags(options: dict[str, str]) -> dict[str, bool]:
    low = {k.lower(): v for k, v in options.items()}
    return {"keep_empty": low.get("keepempty", "").lower() == "true", "token_ids": low.get("idmode", "") == "token"}


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.flags = options["path"], _flags(options)

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            yield from batches(os.path.basename(partition.path), records(f, **self.flags))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def parsed(files: DataFrame, keep_empty: bool = False, token_ids: bool = False) -> DataFrame:
    """The records of files (path, content)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for p, content in zip(part.column("path"), part.column("content"), strict=True):
                path, content = p.as_py(), content.as_py()
                raw = io.BytesIO(content)
                text = io.TextIOWrapper(gzip.open(raw) if path.endswith(".gz") else raw, encoding="latin-1", newline="")
                yield from batches(path.rsplit("/", 1)[-1], records(text, keep_empty, token_ids))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_binary(spark: SparkSession, path: str, keep_empty: bool = False, token_ids: bool = False, whole: int = WHOLE) -> DataFrame:
    """The same rows through Spark's binaryFile reader: any file system that Spark reads, a file of at most `whole` bytes a row in memory.

    Larger files are never held: splits.read() takes them, line by line.
    """
    from . import splits

    files = spark.read.format("binaryFile").load(path)
    out = parsed(files.where(F.col("length") <= whole), keep_empty, token_ids)
    large = [_literal(r.path) for r in files.where(F.col("length") > whole).select("path").collect()]
    return out.unionByName(splits.read(spark, large, keep_empty, token_ids)) if large else out


def _literal(path: str) -> str:
    """A path as Spark's readers take it, which otherwise read *, [a] and {a,b} in it as patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


NAMES = "*.{fastq,fq,fastq.gz,fq.gz}"


def arrivals(spark: SparkSession, folder: str, files_a_batch: int, names: str = NAMES) -> DataFrame:
    """The files of a folder as a stream of (path, modificationTime, length, content), each exactly once.

    A query's checkpoint holds the log of files seen, which Spark compacts: a file is new
    if it isn't in the log, whatever its name or time, so one that is renamed in late
    with an old time is read; a batch that is run again has the same files.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return source.option("maxFilesPerTrigger", files_a_batch).option("maxFileAge", "36500d").option("pathGlobFilter", names).load(folder)


def stream(spark: SparkSession, folder: str, files_a_batch: int = 1000, keep_empty: bool = False, token_ids: bool = False) -> DataFrame:
    """Streaming records of the files that arrive in a folder; a file must come whole, by a rename, and is one row in memory."""
    return parsed(arrivals(spark, folder, files_a_batch), keep_empty, token_ids)
