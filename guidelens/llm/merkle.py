"""Merkle manifest of a dataset with inclusion proofs by coordinate lookup; DataFrame functions only.

A row is a leaf: H (lowercase hex of SHA-256 over the concatenated inputs, digests as
hex text) of its FIELDS, each as UTF-8 byte count, ":" and value, or "-" if null.
Leaves of a group (source) ascend by id and by leaf after it; FAN consecutive nodes
become their H, level by level, until one is left, the group's subroot; subroots in
the order of their groups (null first, UTF-8 bytewise) become the root likewise.

A node's coordinates are tree, level and number. Which siblings a proof needs follows
from a number and its tree's size alone, so requesters explode coordinates and look
them up in the table of nodes by a join, order what they find and concatenate it. A
leaf's own siblings are its run of FAN. Above that, leaves of a run need the same
siblings, so they are looked up once a run for the levels below SPAN; once a block of
FAN ** SPAN leaves for the next SPAN levels, and so on, and once a tree for the tree of
subroots: no node is asked for by more than FAN ** SPAN requesters, but those of the
last tree by one for each group. A path is an array of (left, right), a level each,
which proofs concatenate and folds run through.

Numbers come from a range partitioning: rows are written in order once with their place
in their task, and each task's count by group, added up, is where the next one begins.
A hot group therefore spreads over tasks, and so does a repeated id (rows with equal
fields are alike, so their order is immaterial; a salt spreads them).

Null sources are a group, null ids come first and aren't tampered with; texts of any
length are hashed whole in their rows and never shuffled; repeated rows are leaves
each. An empty table gives no rows, and has no root. Columns beyond FIELDS are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, SHIFT = 16, 4  # SHIFT: bits of FAN
SPAN = 3  # levels a lookup
SALTS = 64
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = -1  # the tree of subroots


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length, so that neighbouring values can't be mistaken for others."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf and tampered (the leaf of the row with its text's A-Z lower-cased where TAMPER divides the id's crc32; else null)."""
    known, text = [field(F.col(c)) for c in FIELDS if c != "text"], F.col("text")
    odd = F.col("doc_id").isNotNull() & (id_crc() % TAMPER == 0)
    return docs.select("source", "doc_id", digest(*known, field(text)).alias("leaf"), F.when(odd, digest(*known, field(F.translate(text, UPPER, LOWER)))).alias("tampered"))


def at(number: Column, levels) -> Column:
    """The number of the node so many levels above a leaf (or above a node)."""
    return F.call_function("shiftright", number, (F.lit(levels) if isinstance(levels, int) else levels).cast("int") * SHIFT)


def depth(members: Column) -> Column:
    """Levels below a tree's last node."""
    return F.when(members > 1, F.length(F.hex(members - 1))).otherwise(0)


def forest(base: DataFrame, name: str) -> DataFrame:
    """Every node of every tree: tree, level, number, members (of the level), digest; a table a level. base: level 0."""
    level, out = written(base.select("tree", F.lit(0).alias("level"), "number", "members", "digest"), name), []
    while True:
        out.append(level)
        if not (level.agg(F.max("members")).first()[0] or 0) > 1:
            return reduce(DataFrame.unionAll, out)
        run = level.where("members > 1").groupBy("tree", at(F.col("number"), 1).alias("run")).agg(F.sort_array(F.collect_list(F.struct("number", "digest"))).alias("run_nodes"), F.max("members").alias("size"))
        above = F.sha2(F.array_join(F.col("run_nodes.digest"), "").cast("binary"), 256)
        level = written(run.select("tree", F.lit(len(out)).alias("level"), F.col("run").alias("number"), (at(F.col("size") - 1, 1) + 1).alias("members"), above.alias("digest")), name)


def siblings(number: Column, members: Column, low, high) -> Column:
    """Coordinates (level, number) of the siblings from level low to below high on the way up from a node of level low (or, below it, the node's first leaf)."""

    def of(level: Column) -> Column:
        own = at(number, level - F.lit(low))
        first = own - F.pmod(own, F.lit(FAN))
        every = F.sequence(first, F.least(first + (FAN - 1), at(members - 1, level)))
        return F.transform(F.filter(every, lambda x: x != own), lambda x: F.named_struct(F.lit("level"), level.cast("int"), F.lit("number"), x))

    levels = F.when(F.lit(high) > low, F.sequence(F.lit(low), F.lit(high) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(levels, of))


def way(found: Column, number: Column, low: int, high: Column) -> Column:
    """The path from level low to below high: what stands left and right of the own node, from an ordered array of looked-up (level, number, digest)."""

    def of(level: Column) -> Column:
        own = at(number, level - low)
        side = lambda test: F.array_join(F.transform(F.filter(found, lambda x: (x["level"] == level) & test(x["number"])), lambda x: x["digest"]), "")
        return F.named_struct(F.lit("left"), side(lambda n: n < own), F.lit("right"), side(lambda n: n > own))

    return F.transform(F.when(high > low, F.sequence(F.lit(low), high - 1)).otherwise(F.array().cast("array<int>")), of)


def looked_up(asked: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and found: the asked siblings' (level, number, digest) in order. asked: keys, tree and wanted (coordinates), a row for each requester."""
    each = asked.select(*keys, F.col("tree").alias("t"), F.explode("wanted").alias("w")).select(*keys, "t", F.col("w.level").alias("l"), F.col("w.number").alias("n"))
    hits = each.join(nodes, (each.t == nodes["tree"]) & (each.l == nodes["level"]) & (each.n == nodes["number"])).select(*(each[k] for k in keys), F.struct(nodes["level"], nodes["number"], nodes["digest"]).alias("hit"))
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_list("hit")).alias("found"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (H of the siblings' digests, bottom up, left to right), folded_root and verified, a row for each document.

    folded_root is what the original siblings and the tampered leaf (the leaf itself
    where nothing was tampered with) give, and verified whether that is the root.
    """
    spark = docs.sparkSession
    base = written(leaves(docs), "merkle-leaves").withColumn("salt", F.monotonically_increasing_id() % SALTS)
    rows = numbered(base, ["source"], ["doc_id", "leaf", "salt"], "merkle-order")
    sources = numbered(rows.groupBy("source").agg(F.max("members").alias("size")), [], ["source"], "merkle-sources")
    trees = written(sources.select("source", F.col("number").alias("tree"), "size", F.col("members").alias("trees")), "merkle-trees")
    own = trees.select(F.col("source").alias("of_source"), "tree")
    rows = written(rows.join(own, F.col("source").eqNullSafe(F.col("of_source"))).drop("source", "of_source", "salt"), "merkle-rows")
    nodes = forest(rows.withColumn("digest", F.col("leaf")), "merkle-nodes")
    ends = nodes.where("members = 1").select(F.col("tree").alias("number"), "digest")
    tops = trees.join(ends, trees["tree"] == ends["number"]).select("tree", "size", "trees", F.col("digest").alias("subroot"))
    tops = written(tops, "merkle-tops")
    crown = forest(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("number"), F.col("trees").alias("members"), F.col("subroot").alias("digest")), "merkle-nodes")
    last = crown.where("members = 1").select("digest").first()
    root = last[0] if last else ""

    # paths, from the top: a tree's, then blocks' of FAN ** (SPAN * stage) leaves, each with its parent's
    levels = depth(F.col("trees"))
    asked = tops.select(F.col("tree").alias("asker"), siblings(F.col("tree"), F.col("trees"), 0, levels).alias("wanted")).withColumn("tree", F.lit(TOP).cast("long"))
    found = looked_up(asked, crown, ["asker"])
    path = way(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), F.col("tree"), 0, levels)
    above = written(tops.join(found, F.col("tree") == F.col("asker"), "left").select("tree", F.lit(0).cast("long").alias("block"), "size", "subroot", path.alias("path")), "merkle-paths")
    most = tops.agg(F.max("size")).first()[0] or 1
    stage = 1
    while FAN ** (SPAN * stage) < most:
        stage += 1
    for k in range(stage - 1, 0, -1):
        low = SPAN * k
        high = F.least(depth(F.col("size")), F.lit(low + SPAN))
        blocks = tops.select("tree", "size", F.explode(F.sequence(F.lit(0).cast("long"), at(F.col("size") - 1, low))).alias("block"))
        found = looked_up(blocks.withColumn("wanted", siblings(F.col("block"), F.col("size"), low, high)), nodes, ["tree", "block"])
        here = blocks.join(found, ["tree", "block"], "left").withColumn("up", at(F.col("block"), SPAN))
        parent = above.select("tree", F.col("block").alias("up"), "subroot", F.col("path").alias("rest"))
        path = F.concat(way(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), F.col("block"), low, high), F.col("rest"))
        above = written(here.join(parent, ["tree", "up"]).select("tree", "block", "size", "subroot", path.alias("path")), "merkle-paths")

    # runs of leaves: their own rows, and what they look up below level SPAN
    high = F.least(depth(F.col("members")), F.lit(SPAN))
    asked = rows.where(F.pmod("number", F.lit(FAN)) == 0).select("tree", at(F.col("number"), 1).alias("run"), siblings(at(F.col("number"), 1), F.col("members"), 1, high).alias("wanted"))
    found = looked_up(asked, nodes.where(F.col("level").between(1, SPAN - 1)), ["tree", "run"])
    runs = rows.groupBy("tree", at(F.col("number"), 1).alias("run")).agg(F.sort_array(F.collect_list(F.struct("number", "leaf", "doc_id", "tampered"))).alias("own"))
    runs = runs.join(found, ["tree", "run"], "left").withColumn("block", at(F.col("run"), SPAN - 1))
    runs = runs.join(above, ["tree", "block"])
    high = F.least(depth(F.col("size")), F.lit(SPAN))
    rest = F.concat(way(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), F.col("run"), 1, high), F.col("path"))
    each = runs.select("size", "subroot", "own", rest.alias("rest"), F.explode("own").alias("me"))
    side = lambda test: F.array_join(F.transform(F.filter("own", lambda x: test(x["number"])), lambda x: x["leaf"]), "")
    first = F.named_struct(F.lit("left"), side(lambda n: n < F.col("me.number")), F.lit("right"), side(lambda n: n > F.col("me.number")))
    each = each.select("subroot", "me", F.when(F.col("size") > 1, F.concat(F.array(first), F.col("rest"))).otherwise(F.col("rest")).alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)
    folded = F.aggregate("path", F.coalesce("me.tampered", "me.leaf"), lambda now, x: digest(x["left"], now, x["right"]))
    out = each.select(F.col("me.doc_id").alias("doc_id"), F.col("me.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda i: ord(substr({text}, i + 1, 1))::BIGINT)),
  lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda t, j: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)))"""


def manifest_sql(levels: int = 6) -> str:
    """DuckDB SQL for the manifest of documents with sources of up to FAN ** levels rows, and so many sources; ids aren't null or repeated."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in FIELDS if c != "text")
    crc = CRC_SQL.format(text="doc_id::VARCHAR")
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"""l AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field(low)}) AS lower_leaf, xor({crc}, 4294967295) % {TAMPER} = 0 AS odd,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS number, count(*) OVER (PARTITION BY source) AS members FROM documents)""",
        "s0 AS (SELECT tree, number, members, leaf AS digest FROM l)",
    ]

    def rising(name: str, first: str) -> None:
        for k in range(levels):
            below = first if k == 0 else f"{name}{k}"
            parts.append(f"{name}{k + 1} AS (SELECT tree, number // {FAN} AS number, (any_value(members) + {FAN - 1}) // {FAN} AS members, sha256(string_agg(digest, '' ORDER BY number)) AS digest FROM {below} WHERE members > 1 GROUP BY tree, number // {FAN})")

    rising("s", "s0")
    ends = " UNION ALL ".join(f"SELECT tree, digest FROM s{k} WHERE members = 1" for k in range(levels + 1))
    parts.append(f"ends AS ({ends})")
    parts.append("t0 AS (SELECT -1 AS tree, tree AS number, count(*) OVER () AS members, digest FROM ends)")
    rising("t", "t0")
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT digest FROM t{k} WHERE members = 1" for k in range(levels + 1)) + ")")
    # left and right of each node, then folds upwards
    steps = [("s", k) for k in range(levels)] + [("t", k) for k in range(levels)]
    now = "SELECT doc_id, tree, tree AS own_tree, number, leaf, CASE WHEN odd THEN lower_leaf ELSE leaf END AS fold, '' AS proof FROM l"
    parts.append(f"f0 AS ({now})")
    for i, (name, k) in enumerate(steps):
        if name == "t" and k == 0:
            parts.append(f"g AS (SELECT doc_id, -1 AS tree, own_tree, own_tree AS number, leaf, fold, proof FROM f{i})")
        source = "g" if name == "t" and k == 0 else f"f{i}"
        parts.append(f"{name}x{k} AS (SELECT a.tree, a.number, coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (WHERE b.number < a.number), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (WHERE b.number > a.number), '') AS rgt FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.number // {FAN} = b.number // {FAN} WHERE a.members > 1 GROUP BY a.tree, a.number)")
        parts.append(f"f{i + 1} AS (SELECT doc_id, p.tree, own_tree, CASE WHEN lft IS NULL THEN p.number ELSE p.number // {FAN} END AS number, leaf, CASE WHEN lft IS NULL THEN fold ELSE sha256(lft || fold || rgt) END AS fold, proof || coalesce(lft || rgt, '') AS proof FROM {source} p LEFT JOIN {name}x{k} x ON p.tree = x.tree AND p.number = x.number)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, e.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified FROM f{len(steps)} f JOIN ends e ON f.own_tree = e.tree, root r"
