"""Editing histories of stored items: what can be undone and done again, over a finished log or as actions arrive.

An action is of one item: save (a version and its name), rename, undo, redo, delete or
clear. A save makes what was there before it the next to undo, keeps the last `depth` of
these, and ends what could be done again. Undo and redo move between versions with the names
they had; they do nothing without one to move to, or for a deleted item. A rename changes
the item that is there, without a step of its own; an empty name, or the same, changes nothing.
Delete and clear take the item away; clear is for a whole workspace, and as an action without an
id it is every item's. Actions are in the order of `at`; equal ones save first, by
version, and then in the order of their names.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .versions import Versions

MOST_CLEARS = 10_000
DEPTH = 20  # fixed value: edits of an item that can be undone
ACTIONS = "id bigint, at bigint, action string, version bigint, name string"
STATE = "id bigint, version bigint, name string, undo_steps int, redo_steps int"
SHOWN = Row("id", "version", "name", "undo_steps", "redo_steps")
FIELDS = dict(field.split() for field in ACTIONS.split(", "))
PACKED = "block bigint, id array<bigint>, at array<bigint>, action array<string>, version array<bigint>, name array<string>"
BLOCKS = 1 << 13  # keys of the stream's state
MOST_ACTIONS, MOST_ROWS, MOST_BYTES = 1 << 8, 1 << 19, 1 << 26  # of a packed row; of what a task packs at once


@dataclass
class History:
    """One item: (version, name) as it is, or None, with those before and after it."""

    now: tuple[int, str | None] | None = None
    past: list[tuple[int, str | None]] = field(default_factory=list)
    future: list[tuple[int, str | None]] = field(default_factory=list)

    def apply(self, action: str, version: int | None, name: str | None, depth: int = DEPTH) -> None:
        if action == "save":
            if self.now is not None:
                self.past = [*self.past, self.now][-depth:]
            self.future, self.now = [], (version, name if name is not None or self.now is None else self.now[1])
        elif action in ("delete", "clear"):
            self.now = None
        elif self.now is None:
            return
        elif action == "rename" and (new := (name or "").strip()):
            self.now = (self.now[0], new)
        elif action in ("undo", "redo"):
            source, target = (self.past, self.future) if action == "undo" else (self.future, self.past)
            if source:
                target.append(self.now)
                self.now = source.pop()

    def row(self, key: int) -> tuple:
        version, name = self.now or (None, None)
        return key, version, name, len(self.past), len(self.future)


def in_order(actions: Iterable[tuple]) -> list[tuple]:
    """Of one item: (at, action, version, name)."""
    return sorted(actions, key=lambda a: (a[0] is not None, a[0] or 0, a[1] != "save", a[1] or "", a[2] is not None, a[2] or 0, a[3] or ""))


def with_clears(actions: DataFrame) -> DataFrame:
    """actions with the clears that have no id given to every item of the log; a log has MOST_CLEARS at most."""
    own = actions.where("id IS NOT NULL")
    times = [r.at for r in actions.where("id IS NULL AND action = 'clear'").select("at").distinct().limit(MOST_CLEARS + 1).collect()]
    if len(times) > MOST_CLEARS:
        raise ValueError(f"more than {MOST_CLEARS} clears")
    if not times:
        return own
    nothing = F.lit(None)
    each = own.select("id").distinct().withColumn("at", F.explode(F.array(*(F.lit(t).cast("bigint") for t in times))))
    return own.unionByName(each.select("id", "at", F.lit("clear").alias("action"), nothing.cast("bigint").alias("version"), nothing.cast("string").alias("name")))


def after_log(actions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """STATE of each item that is there once all actions (ACTIONS) are done: one pass over actions sorted by item."""
    rank = F.when(F.col("action") == "save", 0).otherwise(1)
    rows = with_clears(actions).withColumn("_rank", rank).repartition("id").sortWithinPartitions("id", "at", "_rank", "action", "version", F.coalesce("name", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, item, done = None, History(), []

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "version", "name", "undo_steps", "redo_steps"])

        for batch in batches:
            for id_, action, version, name in zip(*(batch.column(c).to_pylist() for c in ("id", "action", "version", "name")), strict=True):
                if id_ != key:
                    if item.now is not None:
                        done.append(item.row(key))
                    key, item = id_, History()
                item.apply(action, version, name, depth)
            yield flushed()
            done = []
        if item.now is not None:
            done.append(item.row(key))
        yield flushed()

    return rows.mapInArrow(run, STATE)


class Editing(StatefulProcessor):
    """Histories as state, those of a block of items under one key, from rows of PACKED; `idle` milliseconds after an item's last action, a timer ends what could be undone and done again."""

    def __init__(self, depth: int = DEPTH, idle: int | None = None) -> None:
        self.depth, self.idle = depth, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("histories", "histories string")

    def load(self) -> dict[str, list]:
        """Of each item of the block its now, past and future, and when it is idle (None: never, or it has been)."""
        held = self.state.get()
        return json.loads(held[0]) if held else {}

    def save(self, held: dict[str, list]) -> None:
        self.state.update((json.dumps(held, separators=(",", ":")),))

    def wake(self, held: dict[str, list]) -> None:
        """A block has one timer, for the first of its items to be idle."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due := [at for *_, at in held.values() if at is not None]:
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, actions, out = self.load(), defaultdict(list), []
        due = None if self.idle is None else timerValues.getCurrentProcessingTimeInMs() + self.idle
        for _, *columns in rows:
            for id_, *one in zip(*columns, strict=True):
                actions[id_].append(one)
        for id_, mine in actions.items():
            item = History(*held.get(str(id_), (None, [], []))[:3])
            for _, action, version, name in in_order(mine):
                item.apply(action, version, name, self.depth)
            held[str(id_)] = [item.now, item.past, item.future, due]
            out.append(SHOWN(*item.row(id_)))
        self.save(held)
        if due is not None:
            self.wake(held)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, out = self.load(), []
        for id_, (now, _, _, due) in held.items():
            if due is not None and due <= timerValues.getCurrentProcessingTimeInMs():
                held[id_] = [now, [], [], None]
                out.append(SHOWN(*History(now).row(int(id_))))
        self.save(held)
        self.wake(held)
        yield from out

    def close(self) -> None:
        """Nothing is held outside the state."""


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a block as PACKED: those of a block, of some MOST_ROWS that a task has at hand, are a row for each MOST_ACTIONS of them."""

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = rows.take(pa.array(np.argsort(rows.column("block").to_numpy(), kind="stable")))
        block, at = rows.column("block").to_numpy(), np.arange(rows.num_rows)
        new = np.r_[True, block[1:] != block[:-1]]
        first = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % MOST_ACTIONS == 0))
        ends = pa.array(np.r_[first, len(block)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(block[first]), *(pa.ListArray.from_arrays(ends, rows.column(c)) for c in FIELDS)], ["block", *FIELDS])

    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= MOST_ROWS or size >= MOST_BYTES:
            yield flushed(held)
            held, rows, size = [], 0, 0
    if held:
        yield flushed(held)


def stream(actions: DataFrame, depth: int = DEPTH, idle: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """STATE of each item after every batch that has actions of it (a deleted one has a null version); in update mode, with a state store that keeps timers (RocksDB).

    A key costs some calls to the state store in each batch that has it, and a row is handed
    over value by value. So items are dealt by hash to `blocks` keys, whose calls are bounded
    however many items there are, and actions come packed. A checkpoint can be gone on
    with by the same number of blocks only."""
    rows = actions.where("id IS NOT NULL").select(*(F.col(name).cast(kind) for name, kind in FIELDS.items()))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), *FIELDS)
    return dealt.mapInArrow(packed, PACKED).groupBy("block").transformWithState(Editing(depth, idle), STATE, "Update", "ProcessingTime" if idle is not None else "None")


#: Where Spark keeps state with timers.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(spark: SparkSession, actions: DataFrame, table: str, checkpoint: str, depth: int = DEPTH):
    """The stream of a folder's actions into a table of items (Versions), each batch once; the session's state store has to be ROCKS."""
    versions = Versions(spark, table, checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        def merged(state: DataFrame | None) -> DataFrame:
            return batch if state is None else state.join(batch.select("id"), "id", "left_anti").unionByName(batch)

        versions.commit(number, merged)

    return stream(actions, depth).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
