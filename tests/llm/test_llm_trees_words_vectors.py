"""The Merkle manifest, spelling variants and graph search against plain versions, and their defined results for odd rows."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from guidelens.llm import merkle, spelling, vamana
from guidelens.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, leaf string, word string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """doc_id -> sorted list of (leaf, subroot, root, proof, folded, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    trees = {}
    for r in rows:
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1])) if odd else None, r[0]))

    def climb(nodes):
        """The last node, and for each leaf its way: (left, right) a level."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k - k % 16 : k - k % 16 + 16]
                ways[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
        return nodes[0], ways

    out, subroots = {}, []
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        subroots.append(climb([x[2] for x in trees[s]]))
    root, tops = climb([s[0] for s in subroots])
    for s, (subroot, ways), top in zip(names, subroots, tops, strict=True):
        for (_, _, own, tampered, doc_id), way in zip(trees[s], ways, strict=True):
            now = tampered or own
            for left, right in way + top:
                now = h(left, now, right)
            out.setdefault(doc_id, []).append((own, subroot, root, h(*itertools.chain(*(way + top))), now, now == root))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size,sources", [(0, 1), (1, 1), (5, 1), (17, 1), (40, 20), (700, 3), (4400, 2)])
def test_manifest(spark, size, sources):
    rows = [(i * 7 - 3, f"Text {i} É" * (i % 3), "en" if i % 4 else None, f"s{i * i % sources}" if i % 5 else None, i, 1, "x", "y") for i in range(size)]
    if size == 40:
        rows += [(None, None, None, None, None, None, None, None), (4, "a" * 300_000 + "B", None, "s1", None, None, None, None)] + [rows[3]] * 30 + [(rows[3][0], "Other", "en", rows[3][3], 1, 1, "", "")]
    got = {}
    for r in merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(5)).collect():
        got.setdefault(r.doc_id, []).append((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    assert {k: sorted(v) for k, v in got.items()} == (plain_manifest(rows) if rows else {})


def plain_variants(rows):
    n = Counter()
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    import re

    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            k = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: k % len(run)] + run[k % len(run) + 1 :] if k % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(others), forms[w], n[best] if forms[w] else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return out


def test_variants(spark):
    rng = np.random.default_rng(5)
    words = ["aaaaa", "aaaa", "aaaaaa", "aaaab", "baaaa", "colour", "color", "colours", "Éclair", "éclair", "eclair", "naïve", "x" * 70, "x" * 71, "x" * 69 + "y", "short", "shirt", "shot", "÷×÷×÷", "÷×÷×x"]
    rows = [(i, " 1".join(rng.choice(words, 30, p=(w := np.arange(len(words), 0, -1) ** 2.0) / w.sum())).upper() if i % 2 else ".".join(rng.choice(words, 30)), None, None, 1, 1, "x", "y") for i in range(60)]
    rows += [(None, None, *rows[0][2:]), (None, "", *rows[0][2:]), (7, "color " * 40 + "\U0001f600", *rows[0][2:]), (None, "Color Color Color", *rows[0][2:])] + [rows[1]] * 2 + [(9, ("q" * 5000 + " ") * 4, *rows[0][2:])]
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in spelling.variants(spark.createDataFrame(rows, DOCS)).collect()}
    want = plain_variants(rows)
    assert got == want and any(v[2] for v in want.values()) and max(v[1] for v in want.values()) > 2
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "ab 12", *rows[0][2:])], DOCS)).count() == 0


def test_whole_neighbourhood_once():
    """With a filter that lets everything through, each distinct word at one edit is emitted exactly once."""
    alphabet = "abcé"
    make = spelling.Neighbourhoods(alphabet.encode("latin-1"), np.full(1 << 13, 255, np.uint8), 1 << 16)
    for word in ("aabba", "abcé", "aaaaaa", "ab"):
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
        got = [c for out in make([word], np.array([1])) for c, k in zip(out["candidate"], out["emitters"], strict=True) for _ in range(k)]
        assert sorted(x for x in got if x) == sorted(want - {word, ""})


VECTORS = "vec_id long, embedding array<float>, label int, ids string, `a.b` int, dims int"


def plain_nearest(rows, k=10):
    good = [(i, v) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, x in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((np.float64(np.float32(x)) - np.float64(np.float32(v))) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))[:k]
            out |= {(q, r, i, round(f, 9)) for r, (f, i) in enumerate(found, 1)}
    return out


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0], 0, "x", 1, 1) for i in range(300, 340)]
    rows = [*same, (100, [1.0, 2.5], *same[0][2:]), (200, [1.0, 2.0, 3.0], *same[0][2:]), (-100, [4.0, 4.0], *same[0][2:]), (1, [0.0, 0.0], *same[0][2:]), (2, [nan, 1.0], *same[0][2:]), (400, [inf, 1.0], *same[0][2:]), (500, None, *same[0][2:]), (600, [None, 1.0], *same[0][2:]), (None, [1.0, 1.0], *same[0][2:]), (700, [], *same[0][2:]), (201, [1.0, 2.0, 3.5], *same[0][2:])]
    got = vamana.nearest(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == plain_nearest(rows)
    assert vamana.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert vamana.nearest(spark.createDataFrame(rows[:1], VECTORS)).count() == 0


def test_recall_with_a_lump(spark, monkeypatch):
    """A third of the rows are near copies of one vector, which would fill any beam; several shards."""
    monkeypatch.setattr(vamana, "SHARD_NODES", 700)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[::3] = x[0] * 0.3 + rng.normal(size=(1000, 32)) * 0.05
    rows = [(i, v.astype(np.float32).tolist(), 0, "x", 1, 1) for i, v in enumerate(x)]
    index = vamana.build(spark.createDataFrame(rows, VECTORS))
    assert index.count() == 3000 and index.select("shard").distinct().count() == 5
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vamana.search(index, spark.createDataFrame(rows, VECTORS).where("vec_id % 100 = 0")).collect()}
    want = plain_nearest(rows)
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)


def test_every_node_can_be_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(300, 4)) + 1000, rng.normal(size=(200, 4)) * 1e-3 - 50])
    graph = vamana.Graph(x)
    graph.build()
    now, seen = {graph.entry}, set()
    while now:
        seen |= now
        now = {int(j) for i in now for j in graph.edges[i] if j >= 0} - seen
    assert seen == set(np.unique(graph.leader).tolist())
    again = vamana.Graph(x, graph.edges, graph.leader, graph.radius)
    assert sorted(np.concatenate(again.group).tolist()) == list(range(800))


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = {(r.query_id, r.vec_id) for r in vamana.nearest(table(spark, SF, "embeddings")).collect()}
    want = {(q, i) for q, _, i, _ in plain_nearest(rows)}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
