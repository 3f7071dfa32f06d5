"""A table in versions, one a batch: readers see whole versions only, and a batch counts once however often it runs.

A batch's rows go to a folder of their own; then a manifest names it, put in place by
one rename. What has no manifest doesn't exist: a crash before leaves the last version
readable, and the batch, run again, overwrites its unfinished folder; a crash after leaves
the batch done, and run again it does nothing. Old versions go when a newer one is in
place, manifest first, KEEP of them staying for those who still read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KEEP = 2


class Versions:
    """folder: on any file system that Spark writes, with atomic renames. writer: names who counts batches (a query's checkpoint)."""

    def __init__(self, spark: SparkSession, folder: str, writer: str = "") -> None:
        self.spark, self.folder, self.writer = spark, folder.rstrip("/"), writer
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of the versions in place, rising."""
        at = self.path(f"{self.folder}/manifests")
        if not self.files.exists(at):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int) -> dict:
        lines = self.spark.read.text(f"{self.folder}/manifests/{number:012d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def latest(self) -> DataFrame | None:
        """The last version whole; it can be read until KEEP newer ones are in place."""
        numbers = self.numbers()
        if not numbers:
            return None
        held = self.manifest(numbers[-1])
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.folder}/{held['rows']}")

    def commit(self, number: int, merged: Callable[[DataFrame | None], DataFrame]) -> bool:
        """Put version number in place, of what merged() makes of the last one; False, and nothing is done, where it has been before."""
        numbers = self.numbers()
        if numbers:
            held = self.manifest(numbers[-1])
            if held["writer"] != self.writer:
                raise ValueError(f"{self.folder} is written by {held['writer']!r}: its batch numbers aren't those of {self.writer!r}")
            if number <= numbers[-1]:
                return False
        rows, name = merged(self.latest()), f"rows-{number:012d}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.publish(number, {"rows": name, "writer": self.writer, "schema": rows.schema.jsonValue()})
        self.prune()
        return True

    def publish(self, number: int, held: dict) -> None:
        last = self.path(f"{self.folder}/manifests/{number:012d}.json")
        draft = self.path(f"{self.folder}/manifests/.{number:012d}.draft")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not self.files.rename(draft, last):
            raise OSError(f"{last} is there already, or can't be put there")

    def prune(self) -> None:
        """Versions but the last KEEP; and folders without a manifest that are older than these."""
        numbers = self.numbers()
        for number in numbers[:-KEEP]:
            self.files.delete(self.path(f"{self.folder}/manifests/{number:012d}.json"), False)
        stay = numbers[-KEEP:]
        for s in self.files.listStatus(self.path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("rows-") and stay and int(name.removeprefix("rows-")) < stay[0]:
                self.files.delete(s.getPath(), True)
