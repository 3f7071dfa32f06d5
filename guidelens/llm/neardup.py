"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles; a set's sketch holds COORDINATES minwise values.
Exact copies (equal sets) are one class from the start. Tree t has a root node for
each minwise value at coordinate t, and a class is in the node of its own value. A
node up to the weight SLICE is compared exhaustively; a larger one is dealt into
slices of that weight, each compared exhaustively, and what is linked then counts as
one component. A node with at most OUTSIDE outside its largest component is finished
exactly: every block of those outside meets every slice. Others branch: a node picks
coordinates by its own hash, 1 / similarity of them on average, and each class goes
to the child for its value there, so pairs at or above the similarity keep one path
in common on average while others part. Nodes still open at level DEPTH are finished
exactly too, however many are outside. A class weighs 1 and one more for every LONG
shingles, so that slices are bounded in bytes.

Comparing means: pairs of a cell (node, slice, or block and slice) whose sketches and
sizes allow the similarity tie classes to a group, and each group is confirmed on
full sets, per_cent of the union in common at least, in one task. There a walk from
class to class visits only what isn't reached yet, and gives a spanning forest of the
true links: fewer links than members. A pair that an earlier tree's exhaustive node
has held isn't tried again.

With 1 / similarity children the branching is critical: the chance that a pair is
still together falls about as 1 / depth. So depth is bounded, and there are as many
trees, TREES at least, as a pair exactly at the similarity needs to be missed by all
of them with 1 - RECALL at most if its nodes stay open down to the deepest level;
recall() has the chance, over what sketches may give. A sketch's estimate may lie
SLACK below the similarity, four standard deviations or more.

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles have k
words (fewer words: all of them as one). Null, empty and blank texts have no set
and link with nothing. Rows that share an id are looked at one by one, each by its
own text, but texts that share their least id share their component; a null id is a
document alone. Repeated rows get equal results; ties don't matter, since components
take their smallest id. An empty table gives no rows. Texts of any length are taken
whole. Columns other than doc_id and text don't matter; deduplicated() keeps them all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, dropped, every_column, free_name, map_slices, written

COORDINATES, TREES, DEPTH = 128, 12, 6
SLICE, LONG, OUTSIDE = 1024, 2048, 2048
RECALL = 0.99  # of pairs exactly at the similarity whose nodes are open down to the deepest level
SLACK = 0.13
PAIRS = 20_000  # pairs of classes whose sketches are compared at once
WORDS = 150_000  # word hashes that a task remembers before it starts anew
FEW = 200_000  # rows of nodes or ids that are broadcast; more are joined by shuffle
MARKED = 62  # trees whose finished nodes are remembered, in the bits of a long


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


_TIMES, _PLUS, _STEP = _odd(COORDINATES, 1), _odd(COORDINATES, 2), _odd(256, 3)


class WordHashes(dict):
    """Word to its 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    if not size:
        return h
    with np.errstate(over="ignore"):
        x = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            x = x * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(x)] * _STEP[j % 256]
            x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def sketch(x: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values of 32 bits."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            low = np.minimum(low, ((x[at : at + 512, None] * _TIMES + _PLUS) >> np.uint64(32)).min(0))
    return low.astype("<u4")


def sketches(docs: DataFrame, k: int, n_trees: int) -> DataFrame:
    """doc_id, n_shingles, digest, roots (32-bit values for the trees) and marks (the other coordinates, 16 bits each) of every document; null digest and sketch without shingles."""

    def make():
        hashes = WordHashes()

        def run(cols):
            sets = [shingles(t, k, hashes) for t in cols["text"]]
            marks = [sketch(x) if len(x) else None for x in sets]
            out = {"doc_id": cols["doc_id"], "n_shingles": [len(x) for x in sets], "digest": [digest(x) if len(x) else None for x in sets]}
            return out | {"roots": [m if m is None else m[:n_trees].tobytes() for m in marks], "marks": [m if m is None else m[n_trees:].astype("<u2").tobytes() for m in marks]}

        return run

    return map_slices(docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, digest binary, roots binary, marks binary")


def recall(similarity: float, trees: int, levels: int) -> float:
    """Chance that a pair exactly at the similarity shares a node after so many levels in one tree at least.

    Its coordinates in common are binomial, and the same in all trees; more of them may be picked twice on a path, which only helps.
    """
    whole, part = divmod(1 / similarity, 1)
    missed = 0.0
    for m in range(COORDINATES + 1):
        stays = 1.0
        for _ in range(levels):
            parts = 1 - m / COORDINATES * stays
            stays = 1 - parts**whole * (1 - part + part * parts)
        missed += math.comb(COORDINATES, m) * similarity**m * (1 - similarity) ** (COORDINATES - m) * (1 - m / COORDINATES * stays) ** trees
    return 1 - missed


def trees(similarity: float) -> int:
    """The trees that bring recall at the deepest level to RECALL, TREES at least; at most three quarters of the coordinates."""
    out = TREES
    while recall(similarity, out, DEPTH) < RECALL:
        out += 1
    if out > COORDINATES * 3 // 4:
        raise ValueError("so low a similarity needs more trees than a sketch has room for")
    return out


def branches(members: DataFrame, similarity: float, n_marks: int) -> DataFrame:
    """members (path, tree, id, weight, marks) in the children of their nodes: as many as 1 / similarity is whole, and one more with what it leaves over."""
    path = F.col("path")
    pick = lambda j: F.pmod(F.xxhash64(path, F.lit(f"coordinate {j}")), F.lit(n_marks)).cast("int")
    child = lambda at: F.xxhash64(path, at, F.substring(F.col("marks"), at * 2 + 1, F.lit(2)))
    whole, part = divmod(1 / similarity, 1)
    more = F.pmod(F.xxhash64(path, F.lit("branch")), F.lit(1_000_000)) < int(1_000_000 * part)
    every = F.array(*(child(pick(j)) for j in range(int(whole) + 1)))
    children = F.array_distinct(F.when(more, every).otherwise(F.slice(every, 1, int(whole))))
    return members.select(F.explode(children).alias("path"), "tree", "id", "weight")


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, pa.Array]]:
    """Columns of sorted rows, in parts that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(keys, keys[-1]))  # where the last key begins
        whole = held and held[0].column(key)[0].as_py() != keys[0]
        if first or whole:
            parts = [*held, *([batch.slice(0, first)] if first else [])]
            if parts:
                yield dict(zip(batch.schema.names, pa.Table.from_batches(parts).combine_chunks().itercolumns(), strict=True))
            held = [batch.slice(first)]
        else:
            held.append(batch)
    if held:
        yield dict(zip(held[0].schema.names, pa.Table.from_batches(held).combine_chunks().itercolumns(), strict=True))


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def pairs_of(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each cell, about PAIRS at a time."""
    ones, twos, n = [], [], 0
    for size in np.unique(sizes):
        at = starts[sizes == size]
        i, j = np.triu_indices(int(size), 1)
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            base = at[k : k + step, None]
            for c in range(0, len(i), PAIRS):
                ones.append((base + i[c : c + PAIRS]).ravel())
                twos.append((base + j[c : c + PAIRS]).ravel())
                n += len(ones[-1])
                if n >= PAIRS:
                    yield np.concatenate(ones), np.concatenate(twos)
                    ones, twos, n = [], [], 0
    if n:
        yield np.concatenate(ones), np.concatenate(twos)


def joined_up(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is tied to by the pairs."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def candidates(rows: DataFrame, least: float, ratio: float) -> DataFrame:
    """group, id, digest, label: classes of each cell that pairs tie together whose sketches and sizes allow a link, between different labels.

    rows: cell, tree, id, digest, n, label, before, after, roots, marks. before and after have bits for the
    trees whose root node of this class isn't compared exhaustively before and after this round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs_of(batches, "cell"):
            cell, tree, ids, n, label, before, after = (cols[c].to_numpy() for c in ("cell", "tree", "id", "n", "label", "before", "after"))
            roots, marks = matrix(cols["roots"], "<u4"), matrix(cols["marks"], "<u2")
            marked = min(MARKED, roots.shape[1])
            bits = np.int64(1) << np.arange(marked, dtype=np.int64)
            width = roots.shape[1] + marks.shape[1]
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            one, two = [], []
            for i, j in pairs_of(np.diff(np.append(edge, len(cell))), edge):
                may = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
                i, j = i[may], j[may]
                same = roots[i] == roots[j]
                met = same[:, :marked] @ bits
                earlier = (np.int64(1) << np.minimum(tree[i], MARKED).astype(np.int64)) - 1
                new = (met & (~before[i] | (before[i] & ~after[i] & earlier))) == 0
                i, j, same = i[new], j[new], same[new]
                alike = same.sum(1) + (marks[i] == marks[j]).sum(1)
                good = alike >= least * width
                one.append(i[good])
                two.append(j[good])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
            if not len(i):
                continue
            tied = joined_up(len(cell), i, j)
            among = np.unique(np.concatenate((i, j)))
            among = among[np.lexsort((ids[among], tied[among]))]
            edges = np.append(np.flatnonzero(np.concatenate(([True], np.diff(tied[among]) != 0))), len(among))
            names = [xxhash.xxh64_intdigest(ids[among[a:b]].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            group = np.repeat(np.array(names, np.uint64).view(np.int64), np.diff(edges))
            arrays = [pa.array(group), pa.array(ids[among]), cols["digest"].take(pa.array(among)).combine_chunks(), pa.array(label[among])]
            yield pa.RecordBatch.from_arrays(arrays, names=["group", "id", "digest", "label"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "group bigint, id bigint, digest binary, label bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """group, id, label, items (shingle hashes, 8 bytes each) of the classes in wanted (a written table: id, digest, label, groups)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[list] = [[], [], [], []]
                for row in batch.slice(at, 64).to_pylist():
                    x = shingles(row["text"], k, hashes)
                    if digest(x) == row["digest"]:  # else another text with the same id
                        for group in row["groups"]:
                            for c, v in zip(out, (group, row["id"], row["label"], x.tobytes()), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["group", "id", "label", "items"])

    texts = docs.select("doc_id", "text").join(checked(wanted, FEW), F.col("doc_id") == F.col("id"))
    return texts.select("text", "id", "digest", "label", "groups").mapInArrow(run, "group bigint, id bigint, label bigint, items binary")


def forest(sets: list[np.ndarray], label: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    """Links between the sets that join all components that true links join; rows of one label are joined already.

    A walk from each component: every row reached is compared with all that aren't reached.
    """
    n = np.array([len(s) for s in sets])
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(n)))
    own = [tokens[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
    part = np.unique(label, return_inverse=True)[1]
    reached, seen, out = np.zeros(len(sets), bool), np.zeros(int(tokens.max()) + 1, bool), []
    rest: np.ndarray | None = None
    for first in range(len(sets)):
        if reached[first]:
            continue
        queue = np.flatnonzero(part == part[first]).tolist()
        reached[queue] = True
        rest = None
        while queue:
            r = queue.pop()
            if rest is None:  # what isn't reached, side by side
                rest = np.flatnonzero(~reached)
                if not len(rest):
                    return out
                theirs, edge = np.concatenate([own[x] for x in rest]), np.concatenate(([0], np.cumsum(n[rest])[:-1]))
            seen[own[r]] = True
            common = np.add.reduceat(seen[theirs], edge, dtype=np.int64)
            seen[own[r]] = False
            for x in rest[common * 100 >= (n[r] + n[rest] - common) * per_cent].tolist():
                if not reached[x]:
                    out.append((r, x))
                    more = np.flatnonzero(part == part[x])
                    reached[more] = True
                    queue += more.tolist()
                    rest = None
    return out


def links(sets: DataFrame, per_cent: int) -> DataFrame:
    """a, b: a forest of the true links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs_of(batches, "group"):
            group, ids, label = (cols[c].to_numpy() for c in ("group", "id", "label"))
            edge = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
            a_out, b_out = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    items = [np.frombuffer(x.as_py(), np.uint64) for x in cols["items"][a:b]]
                    for i, j in forest(items, label[a:b], per_cent):
                        a_out.append(ids[a + i])
                        b_out.append(ids[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return sets.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each end of an edge reaches; a written table.

    Every round takes the least label among neighbours and then the label's own
    label, so that rounds grow with the logarithm of a component's diameter. A hub
    with very many edges is only ever aggregated.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = written(step.join(jump, "label").select("id", F.least("label", "far").alias("label"), "old"), "labels")
        dropped(labels)
        labels = new
        if labels.where("label <> old").isEmpty():
            dropped(both)
            return labels.select("id", "label")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the label of their id; an id without a link is its own label."""
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels.select(F.col("id").alias("_id"), F.col("label").alias("_label")), F.col("id") == F.col("_id"), "left").withColumn("label", F.coalesce("_label", "id")).drop("_id", "_label")


def hashed(parts, *of) -> F.Column:
    """Which of so many parts a row goes to."""
    return F.pmod(F.xxhash64(*of), parts).cast("int")


class Search:
    """The components of the links between classes, level by level. classes: id, digest, n, roots, marks (a written table)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, per_cent: int):
        self.docs, self.classes, self.k, self.per_cent = docs, classes, k, per_cent
        self.similarity = per_cent / 100
        self.trees = trees(self.similarity)
        self.least, self.ratio = self.similarity - SLACK, self.similarity * (1 - 1e-9)
        self.labels: DataFrame | None = None
        self.open: DataFrame | None = None  # id, before, after, as candidates() has them

    def run(self) -> DataFrame | None:
        """id, label of the classes that have links; None if there are none."""
        weight = (1 + F.floor(F.col("n") / LONG)).cast("bigint").alias("weight")
        root = lambda t: F.struct(F.xxhash64(F.lit(t), F.substring("roots", 4 * t + 1, 4)).alias("path"), F.lit(t).alias("tree"))
        members = self.classes.select("id", weight, F.inline(F.array(*map(root, range(self.trees)))))
        cells, below = None, None
        for level in range(DEPTH + 1):
            large, own, nodes = self.dealt(members)
            if level == 0:
                bits = F.bit_or(F.expr("shiftleft(1L, tree)")).alias("after")
                self.open = written(large.where(F.col("tree") < MARKED).groupBy("id").agg(bits).withColumn("before", F.lit(-1).cast("bigint")), "open")
            own = labelled(own, self.labels)
            self.compare(own if cells is None else cells.union(own), level == 0)
            open_ = self.open_nodes(large)
            for old in (large, nodes, cells, below):
                if old is not None:
                    dropped(old)
            ends = F.col("outside") <= (OUTSIDE if level < DEPTH else (1 << 62))
            few, many = open_.where(ends), open_.where(~ends)
            if level == 0:
                still = many.where(F.col("tree") < MARKED).groupBy("id").agg(bits)
                new = self.open.select("id", F.col("after").alias("before")).join(still, "id", "left").select("id", "before", F.coalesce("after", F.lit(0)).cast("bigint").alias("after"))
                new = written(new, "open")
            else:
                new = written(self.open.select("id", F.col("after").alias("before"), "after"), "open")
            dropped(self.open)
            self.open = new
            if open_.isEmpty():
                dropped(open_)
                break
            cells = written(self.blocks(few), "blocks")
            members = below = written(branches(many.join(self.classes.select("id", "marks"), "id"), self.similarity, COORDINATES - self.trees), "members")
            dropped(open_)
        dropped(self.open)
        return self.labels

    def dealt(self, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members of large nodes (written), the cells (cell, tree, id) of all nodes, and the nodes (written)."""
        nodes = written(members.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("heavy")).where("size > 1"), "nodes")
        big, few = F.col("heavy") > SLICE, checked(nodes, FEW)
        small = members.join(few.where(~big).select("path"), "path").select(F.col("path").alias("cell"), "tree", "id")
        large = written(members.join(few.where(big).select("path", "heavy"), "path"), "large")
        slices = large.select(F.xxhash64("path", hashed(F.ceil(F.col("heavy") / SLICE), "id", "path")).alias("cell"), "tree", "id")
        return large, small.union(slices), nodes

    def compare(self, cells: DataFrame, first: bool) -> None:
        """Find and confirm the links in cells (cell, tree, id, label) between different labels, and bring the labels up to date."""
        # trees find the same cells again and again; each set of classes is compared once
        members = F.collect_set(F.struct("id", "label"))
        sets = cells.groupBy("cell", "tree").agg(F.array_sort(members).alias("ids"), F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two")
        sets = sets.groupBy("ids").agg(F.min("tree").alias("tree"))
        all_, none = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
        rows = sets.select(F.xxhash64("ids").alias("cell"), "tree", F.inline("ids")).join(self.classes, "id").join(self.open, "id", "left")
        rows = rows.withColumn("before", F.coalesce("before", all_ if first else none)).withColumn("after", F.coalesce("after", none))
        found = candidates(rows.select("cell", "tree", "id", "digest", "n", "label", "before", "after", "roots", "marks"), self.least, self.ratio)
        wanted = written(found.groupBy("id", "digest", "label").agg(F.collect_set("group").alias("groups")), "groups")
        new = written(links(full_sets(self.docs, wanted, self.k), self.per_cent), "links")
        dropped(wanted)
        self.link(new)
        dropped(new)

    def link(self, new: DataFrame) -> None:
        """Bring the labels up to date with new links: they join components, so only the graph of the old labels is solved again."""
        if new.isEmpty():
            return
        if self.labels is None:
            self.labels = components(new)
            return
        one = labelled(new.withColumnRenamed("a", "id"), self.labels).select(F.col("label").alias("a"), F.col("b").alias("id"))
        joined = written(labelled(one, self.labels).select("a", F.col("label").alias("b")).where("a <> b").distinct(), "joined")
        if not joined.isEmpty():
            solved = components(joined)
            change = solved.select(F.col("id").alias("_from"), F.col("label").alias("_to"))
            # classes that are new to the labels stand for themselves
            fresh = joined.select(F.col("a").alias("id")).union(joined.select("b")).distinct().join(self.labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))
            labels = written(self.labels.union(fresh).join(change, F.col("label") == F.col("_from"), "left").select("id", F.coalesce("_to", "label").alias("label")), "labels")
            dropped(self.labels)
            dropped(solved)
            self.labels = labels
        dropped(joined)

    def open_nodes(self, large: DataFrame) -> DataFrame:
        """Members, with labels as they are now, of nodes with more than one component; with the weight outside the largest; a written table."""
        now = labelled(large, self.labels)
        counts = now.groupBy("path", "label").agg(F.sum("weight").alias("w")).groupBy("path")
        nodes = counts.agg(F.max_by("label", F.struct("w", "label")).alias("largest"), (F.sum("w") - F.max("w")).alias("outside")).where("outside > 0")
        return written(now.join(nodes, "path"), "open-nodes")

    def blocks(self, few: DataFrame) -> DataFrame:
        """Cells (cell, tree, id, label) in which every block of those outside a node's largest component meets every slice of the node."""
        slices, blocks = (F.ceil(F.col(c) / SLICE) for c in ("heavy", "outside"))
        own, block = hashed(slices, "id", "path"), hashed(blocks, "id", F.lit("block"))
        cell = lambda b, s: F.xxhash64("path", F.lit("block"), b, s)
        column = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda b: cell(b, own))
        row = F.transform(F.sequence(F.lit(0), (slices - 1).cast("int")), lambda s: cell(block, s))
        where = F.when(F.col("label") != F.col("largest"), F.array_union(column, row)).otherwise(column)
        return few.select(F.explode(where).alias("cell"), "tree", "id", "label")


def grouped(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketched = written(sketches(docs, k, trees(per_cent / 100)), "sketches")
    every = written(sketched.select("doc_id", "n_shingles", "digest"), "documents")
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest", F.col("n_shingles").alias("n"), "roots", "marks").agg(F.min("doc_id").alias("id"))
    classes = written(classes, "classes")
    dropped(sketched)
    labels = Search(docs, classes, k, per_cent).run()
    named = written(labelled(classes.select("id", "digest"), labels).select(F.col("digest").alias("_digest"), "label"), "components")
    dropped(classes)
    if labels is not None:
        dropped(labels)
    # empty sets match nothing; their key differs from any digest
    key = F.coalesce("digest", F.encode(F.col("doc_id").cast("string"), "utf-8"))
    out = every.withColumn("_key", key).join(named, F.col("_key") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """One document of each group, with its columns: the one with the smallest id; of rows that share an id, the one with the least text."""
    key, stays, rows, one = (free_name(x, docs) for x in ("key", "stays", "rows", "one"))
    by_id = grouped(docs, k, per_cent).where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(rows))
    # most documents aren't in this table: they are the only ones of their id, and stay
    special = written(by_id.where(~F.col(stays) | (F.col(rows) > 1)), "not-alone")
    out = docs.join(checked(special, FEW), F.col("doc_id") == F.col(key), "left")
    single = out.where(F.col(key).isNull()).select(*every_column(docs))
    if special.where(F.col(stays)).isEmpty():
        return single
    least = out.where(F.col(stays)).groupBy(key).agg(F.min_by(F.struct(*every_column(docs)), F.coalesce("text", F.lit(""))).alias(one))
    return single.union(least.select(f"{one}.*"))
