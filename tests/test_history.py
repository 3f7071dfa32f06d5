"""Editing histories: the log in one pass and the stream agree, with renames, clears and an idle timer."""

import random
import time

import pytest

from guidelens.streaming import history

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def store(spark):
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    yield
    spark.conf.unset(STORE) if old is None else spark.conf.set(STORE, old)


def log(n, items, seed=1):
    rng = random.Random(seed)
    for at in range(n):
        action = rng.choice(["save", "save", "save", "undo", "undo", "redo", "rename", "delete", "nonsense"])
        yield rng.randrange(items), at, action, at if action == "save" else None, rng.choice([None, "", " a ", "b"]) if action in ("save", "rename") else None


def plain(rows, depth):
    """id -> (version, name, undo steps, redo steps), written out anew."""
    items = {}
    for id_, _, action, version, name in rows:
        i = items.setdefault(id_, {"now": None, "past": [], "future": []})
        if action == "save":
            if i["now"]:
                i["past"].append(i["now"])
                i["past"] = i["past"][-depth:]
            i["now"] = (version, name if name is not None else i["now"][1] if i["now"] else None)
            i["future"] = []
        elif action in ("delete", "clear"):
            i["now"] = None
        elif i["now"] and action == "rename" and name and name.strip():
            i["now"] = (i["now"][0], name.strip())
        elif i["now"] and action == "undo" and i["past"]:
            i["future"].append(i["now"])
            i["now"] = i["past"].pop()
        elif i["now"] and action == "redo" and i["future"]:
            i["past"].append(i["now"])
            i["now"] = i["future"].pop()
    return {k: (*i["now"], len(i["past"]), len(i["future"])) for k, i in items.items() if i["now"]}


def test_log(spark):
    rows = list(log(3000, 12))
    want = plain(rows, 5)
    got = {r.id: tuple(r)[1:] for r in history.after_log(spark.createDataFrame(rows, history.ACTIONS).repartition(3), 5).collect()}
    assert got == want and len(want) > 5 and {w[2] for w in want.values()} > {5}
    cleared = [*rows[:1500], (None, 1499, "clear", None, None), *rows[1500:]]
    every = [r for r in rows[:1500]] + [(k, 1499, "clear", None, None) for k in range(12)] + rows[1500:]
    got = {r.id: tuple(r)[1:] for r in history.after_log(spark.createDataFrame(cleared, history.ACTIONS), 5).collect()}
    order = sorted(every, key=lambda r: (r[1], r[2] != "save", r[2]))
    assert got == plain(order, 5)
    assert history.after_log(spark.createDataFrame([], history.ACTIONS)).count() == 0


def test_stream_agrees_with_the_log(spark, store, tmp_path):
    rows = list(log(600, 6, 2)) + [(3, 601, "clear", None, None)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        part = rows[k * 200 : (k + 1) * 200] if k < 2 else rows[400:]
        spark.createDataFrame(part, history.ACTIONS).coalesce(1).write.json(str(tmp_path / "in" / f"batch{k}"))
    source = spark.readStream.schema(history.ACTIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    seen = {}

    def keep(batch, number):
        seen.update({r.id: tuple(r)[1:] for r in batch.collect()})

    q = history.stream(source, 4).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {k: v for k, v in seen.items() if v[0] is not None} == plain(rows, 4)


def test_idle_items_lose_their_steps(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, k, "save", k, f"n{k}") for k in range(3)]
    spark.createDataFrame(rows, history.ACTIONS).coalesce(1).write.json(str(tmp_path / "in" / "a"))
    source = spark.readStream.schema(history.ACTIONS).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    seen = []
    q = history.stream(source, idle=500).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()
    end = time.time() + 120
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert seen[:2] == [(1, 2, "n2", 2, 0), (1, 2, "n2", 0, 0)]


def test_items_share_keys_of_the_state(spark, store, tmp_path):
    """However many items there are, the state has a bounded number of keys, and rows come packed; items of a block stay apart, over batches too."""
    rows = list(log(4000, 300, 3))
    (tmp_path / "in").mkdir()
    for k in range(2):
        spark.createDataFrame(rows[k * 2000 : (k + 1) * 2000], history.ACTIONS).coalesce(1).write.json(str(tmp_path / "in" / f"batch{k}"))
    source = spark.readStream.schema(history.ACTIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    seen = {}
    q = history.stream(source, 4, blocks=3).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.id: tuple(r)[1:] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {k: v for k, v in seen.items() if v[0] is not None} == plain(rows, 4) and len(seen) == 300
    assert [p.numInputRows for p in q.recentProgress if p.numInputRows] == [2000, 2000] and q.lastProgress.stateOperators[0].numRowsTotal == 3


def test_actions_come_packed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(history, "MOST_ROWS", 1000)
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 1, 1, 5]), *r) for r in log(2600, 9, 5)] + [(7, -1, None, None, None, "x" * 30)]
    names = ["block", *history.FIELDS]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names) for part in (rows[:400], rows[400:1100], rows[1100:])]
    out = [r for b in history.packed(iter([*batches[:2], batches[0].slice(0, 0), *batches[2:]])) for r in b.to_pylist()]
    got = [(r["block"], *x) for r in out for x in zip(*(r[f] for f in history.FIELDS), strict=True)]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[:3])
    assert sorted(got, key=key) == sorted(rows, key=key)
    assert max(len(r["id"]) for r in out) == history.MOST_ACTIONS and len(out) < 25
    assert list(history.packed(iter([]))) == []


def test_items_of_a_block_are_idle_by_themselves(spark, store, tmp_path):
    """One timer a block: it ends the steps of the items that are due, and is set anew for the others."""
    (tmp_path / "in").mkdir()

    def put(name, items, at):
        spark.createDataFrame([(i, at + k, "save", at + k, "n") for i in items for k in range(2)], history.ACTIONS).coalesce(1).write.json(str(tmp_path / "in" / name))

    def until(n):
        end = time.time() + 120
        while len(seen) < n and time.time() < end:
            time.sleep(0.1)

    put("a", [1, 2, 3], 0)
    source = spark.readStream.schema(history.ACTIONS).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    seen = []
    q = history.stream(source, idle=8000, blocks=1).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start()
    until(3)
    put("b", [2], 10)
    until(7)
    q.stop()
    assert sorted(seen[:3]) == [(i, 1, "n", 1, 0) for i in (1, 2, 3)]
    assert seen[3] == (2, 11, "n", 3, 0) and sorted(seen[4:6]) == [(i, 1, "n", 0, 0) for i in (1, 3)] and seen[6:] == [(2, 11, "n", 0, 0)]
