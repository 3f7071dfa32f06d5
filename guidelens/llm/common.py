"""Shared plumbing: reading a table, batches of texts, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_ROWS = 512  # rows of an Arrow batch that Python objects are made of at once
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a new local one where it is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="guidelens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing lazy reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of SLICE_ROWS rows at most, so that long texts don't fill a task's memory.

    The limit is a setting of the session; it is lowered there, and stays so.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= SLICE_ROWS:
        conf.set(BATCH, str(SLICE_ROWS))
    if not any(set(c) & {".", "`"} for c in df.columns):
        return df.mapInArrow(run, schema)
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]  # mapInArrow can't name such columns
    made = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, made.names)

    return df.toDF(*plain).mapInArrow(renamed, made).toDF(*schema.names)


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_slices(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow over slices of SLICE_ROWS rows.

    make() runs once a task and returns a function from a dict of column lists to a
    dict of column lists, so that memory holds one slice whatever the batch size is. If
    the function has an attribute end, that is called when the task ends.
    """
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, function = to_arrow_schema(spark_schema), make()
        for part in slices_of(batches):
            out = function(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        getattr(function, "end", lambda: None)()

    return map_batches(df, run, spark_schema)


def id_crc(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def checked(df: DataFrame, most: int) -> DataFrame:
    """df, a written table, marked for broadcasting if it has no more than so many rows; more of them are joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores before it, that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """df with number (from 0, within its group) and members (of the group); a written table in that order, and a join of counts."""
    place, part = F.monotonically_increasing_id(), F.shiftright("_place", 33)
    laid = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_place", place), name)
    counts = laid.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_rows")
    starts = counts.select(F.col("_part"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(W.partitionBy(*group)).alias("members"), *(F.col(c).alias(f"of_{c}") for c in group))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group), part == F.col("_part"))
    return laid.join(starts, same).withColumn("number", F.col("_place") + F.col("_shift")).drop("_part", "_shift", "_place", *(f"of_{c}" for c in group))


def every_column(df: DataFrame) -> list[F.Column]:
    """The columns of df by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
