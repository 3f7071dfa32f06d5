"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words and their stems, pairs of
neighbouring words and pairs with one word between them, hashed to BITS bits. Training
takes a bounded sample of labelled texts, by smallest hash of the id: at most SAMPLE
of them, and no more than have COORDINATES distinct coordinates together (the first
is always taken). Executors hash the whole texts; the driver sees 4-byte coordinates
and labels only, and learns with one learning rate for each coordinate and an L1 term
that leaves most weights at exactly zero. What executors get is the weights that
remain, the MAX_WEIGHTS largest ones at most. Every whole text is scored.

Null and empty texts have no features and get the score of the bias. A document
with several labels counts as toxic if one says so; null labels don't count.
Without any label, or an empty table, the bias is 0 and scores are 0.5 less a
trifle (never predicted). Rows are scored independently, so repeated rows get equal
scores. clean() keeps all columns as they are, whatever their names and types.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_crc, map_batches, map_slices, slices_of, written

BITS = 22
SAMPLE = 8000  # labelled texts used for training, at most
COORDINATES = 24_000_000  # of all texts used for training together, at most
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 1.0
MAX_WEIGHTS = 1 << 20
STEMS = (4, 6)
LEAST = 5  # a coordinate counts if so many examples have it
WORDS = 150_000  # word hashes that a task remembers before it starts anew
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class WordHashes(dict):
    """Raw word (bytes, A-Z lowered) to its row in a table of hashes: the word without marks around it, and its stems.

    Stems are the first STEMS letters of longer words, so that inflected forms share
    a coordinate. A row of zeros is a word of marks only. Bounded by WORDS.
    """

    def __init__(self):
        self.rows = np.zeros((1024, 1 + len(STEMS)), np.uint64)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace").lower()
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        word = word[a:b]
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        if word:
            self.rows[at] = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in (word, *(f"{n}:{word[:n]}" if len(word) > n else "" for n in STEMS))]
        self[raw] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= WORDS:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at]


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Coordinates of a text, repeats included."""
    h = hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    h = h[h[:, 0] != 0]  # marks alone aren't words
    shift, w = np.uint64(64 - BITS), h[:, 0]
    with np.errstate(over="ignore"):
        return np.concatenate((h.ravel() * _A, w[:-1] * _A + w[1:] * _B + _C, w[:-2] * _A + w[2:] * _C + _D)) >> shift


@dataclass
class Model:
    """The coordinates with a weight, ascending, and their weights."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def train(rows: list[np.ndarray], labels: list[int]) -> Model:
    """FTRL-proximal over the given examples (distinct coordinates each), in the given order, PASSES times."""
    seen = np.zeros(1 << BITS, np.int32)
    for at in rows:
        seen[at] += 1
    kept = np.flatnonzero(seen >= LEAST)  # what few examples have only lets them be learnt by heart
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    rows = [x[x >= 0] for x in (place[at] for at in rows)]
    z, n = np.zeros(len(kept)), np.zeros(len(kept))
    bz = bn = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(PASSES if rows else 0):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            b = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * b
            bn += g * g
    w = weights(z, n)
    largest = np.flatnonzero(w)
    if len(largest) > MAX_WEIGHTS:
        largest = np.sort(largest[np.argsort(-np.abs(w[largest]), kind="stable")[:MAX_WEIGHTS]])
    return Model(-bz / ((BETA + np.sqrt(bn)) / ALPHA) if bn else -1e-6, kept[largest], w[largest].astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, keep: F.Column) -> tuple[list[np.ndarray], list[int]]:
    """Distinct coordinates and labels of the texts to learn from, of those that keep selects, by smallest hash of the id."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(keep)
    chosen = marks.withColumn("order", F.xxhash64(F.lit("toxicity"), "doc_id")).orderBy("order", "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def make():
        hashes = WordHashes()

        def run(cols):
            found = [np.unique(features(t, hashes)).astype("<i4") for t in cols["text"]]
            key = [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in found]
            return {"order": cols["order"], "doc_id": cols["doc_id"], "key": key, "toxic": [int(x > 0) for x in cols["toxic"]], "size": [len(x) for x in found], "at": [x.tobytes() for x in found]}

        return run

    hashed = written(map_slices(texts.select("order", "doc_id", F.col("toxic").cast("double").alias("toxic"), "text"), make, "order bigint, doc_id bigint, key bigint, toxic int, size bigint, at binary"), "examples")
    # rows can share an id: no more than SAMPLE of them all the same
    first = hashed.select("order", "doc_id", "key", "size").orderBy("order", "doc_id", "key").limit(SAMPLE).collect()
    total, last = 0, None
    for r in first:
        total += r["size"]
        if last is not None and total > COORDINATES:
            break
        last = r
    if last is None:
        return [], []
    end = F.struct(*(F.lit(last[c]).cast("bigint").alias(c) for c in ("order", "doc_id", "key")))
    rows = hashed.where(F.struct("order", "doc_id", "key") <= end).toArrow()
    dropped(hashed)
    order = np.lexsort([rows[c].to_numpy() for c in ("key", "doc_id", "order")])[:SAMPLE]
    toxic = rows["toxic"].to_numpy()[order].tolist()
    return [np.frombuffer(rows["at"][int(i)].as_buffer(), "<i4") for i in order], toxic


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the rows give that held_out doesn't mark."""
    model = train(*sample(docs, labels, ~held_out()))
    pa.default_memory_pool().release_unused()
    return model


class Scorer:
    """Scores of texts; one a task."""

    def __init__(self, model: Model):
        self.bias, self.dense, self.hashes = model.bias, model.dense(), WordHashes()

    def __call__(self, text: str | None) -> float:
        at = features(text, self.hashes).astype(np.int64)
        at = at[self.dense[at] != 0]
        s = self.bias + (float(self.dense[np.unique(at)].sum()) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, s)))))


def held_out() -> F.Column:
    return id_crc() % 5 == 0


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows that held_out marks teach nothing."""
    model = fitted(docs, labels)

    def make():
        one = Scorer(model)

        def run(cols):
            score = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "score": score, "predicted": [int(s >= 0.5) for s in score]}

        return run

    out = map_slices(docs.select("doc_id", "text"), make, "doc_id bigint, score double, predicted int")
    return out.withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    model = fitted(docs, labels)

    def run(batches):
        one = Scorer(model)
        for part in slices_of(batches):
            yield part.filter(pa.array([one(t) < 0.5 for t in part.column("text").to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
