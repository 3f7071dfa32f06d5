"""Spelling variants by full neighbourhood generation: every word emits each distinct deletion, replacement and insertion over the observed alphabet, which a hash join finds in the vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point. What a word emits is exactly what is near it, so a candidate that equals a word
of the vocabulary needs no distance to be verified; and as nearness is mutual, a
candidate's emitters are its near words. Emitters are therefore summed up by candidate
(how many, and the best of them) where they are emitted already, before any shuffle:
the vocabulary is range-partitioned in code-point order, so words with a common
beginning, and hence most emitters of a candidate, are in one task.

Most candidates are no words. Of the 2 * length * alphabet that a word emits, a task
passes on those that a Bloom filter of the vocabulary lets through; the join decides.
The filter has FILTER_BITS bits at most (64 MB), whatever the vocabulary's size: beyond
some ten million words it lets more through, and the result stays the same. Candidates
are tested by a rolling hash, which each costs the same however long its word is, and
spelt out only after it. Letters are of the class RUN, whose code points are a byte
each, so the alphabet has 89 letters at most.

Null and empty texts, and texts without letters, have no words; long runs are words
like any other, and are never cut; a null id counts as empty text in the hash that
disturbs runs. Rows are occurrences, so repeated rows count again. Ties for a form go to
the smallest word in code-point order. An empty table gives no rows. Only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DISTURB = 97
LEAST_LETTERS, LEAST_SEEN = 5, 3
TIMES = 2  # a form is at least so many times as frequent
FILTER_BITS, BITS_A_WORD, PROBES = 1 << 29, 32, 4
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)  # odd multipliers, one a probe
STEP = 1 << 19  # candidates tested at once
BLOCK = 4096  # words a block of the generator


def observed(docs: DataFrame) -> DataFrame:
    """word, n: the runs of all texts, A-Z lower-cased and disturbed, at least LEAST_LETTERS long and LEAST_SEEN times seen."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN})"), 1)).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS)  # a deletion only shortens
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % DISTURB == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)


def letter_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BASE = np.uint64(0x5851F42D4C957F2D)


def slots(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29))) * SPREAD[probe]
    return x >> np.uint64(64 - (bits.bit_length() - 1))


def spelt(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the words' places and their letters, a byte each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = {}
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        out[size] = at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), size)
    return out


def rolling(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every prefix and every suffix of words of one length, and the powers of BASE."""
    n, size = letters.shape
    value = letter_values()[letters]
    power = np.ones(size + 2, np.uint64)
    before, after = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64)
    for i in range(size + 1):
        power[i + 1] = power[i] * BASE
    for i in range(size):
        before[:, i + 1] = before[:, i] * BASE + value[:, i]
    for i in range(size - 1, -1, -1):
        after[:, i] = value[:, i] * power[size - 1 - i] + after[:, i + 1]
    return before, after, power


def filter_of(vocabulary: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the vocabulary as bytes, and its bits; executors find the bits, which are joined by 64."""
    bits = min(FILTER_BITS, 1 << max(16, (BITS_A_WORD * words - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            with np.errstate(over="ignore"):
                for _, letters in spelt(batch.column(0).to_pylist()).values():
                    h = rolling(letters)[0][:, -1]
                    held += [slots(h, k, bits) for k in range(PROBES)]
            if held:
                at = np.unique(np.concatenate(held))
                place, first = np.unique(at >> np.uint64(6), return_index=True)
                joined = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(joined.view(np.int64))], ["place", "bits"])

    found = vocabulary.select("word").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8), bits


class Neighbourhoods:
    """Emits the candidates of words that pass the filter, with how many of the words emit each and the best of these."""

    def __init__(self, alphabet: bytes, held: np.ndarray, bits: int) -> None:
        self.alphabet, self.held, self.bits = np.frombuffer(alphabet, np.uint8), held, bits
        self.value = letter_values()

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places in the flat array of hashes that the filter lets through."""
        h, at = h.ravel(), None
        for probe in range(PROBES):
            slot = slots(h if at is None else h[at], probe, self.bits)
            ok = (self.held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            at = np.flatnonzero(ok) if at is None else at[ok.astype(bool)]
        return at

    def of_length(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, hash, letters) of candidates of one length each, for words of one length."""
        n, size = letters.shape
        before, after, power = rolling(letters)
        own = self.value[self.alphabet]
        each = max(1, STEP // (n * len(own)))

        def made(word: np.ndarray, at: np.ndarray, skip: int, letter: np.ndarray | None, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The words with so many letters from at replaced by a letter, or by none."""
            grown = size - skip + (letter is not None)
            out, column = np.empty((len(word), grown), np.uint8), np.arange(grown)[None, :]
            moved = np.minimum(column + np.where(column >= at[:, None] + (letter is not None), skip - (letter is not None), 0), size - 1)
            out[:] = np.take_along_axis(letters[word], moved, 1)
            if letter is not None:
                out[np.arange(len(word)), at] = letter
            return word, h, out

        for low in range(0, size + 1, each):
            at = np.arange(low, min(low + each, size + 1))
            whole = at[at < size]
            if len(whole):  # deletions; the first of equal neighbours stands for all
                h = before[:, whole] * power[size - 1 - whole] + after[:, whole + 1]
                new = np.ones(h.shape, bool)
                new[:, whole > 0] = letters[:, whole[whole > 0]] != letters[:, whole[whole > 0] - 1]
                hit = self.passing(h)
                hit = hit[new.ravel()[hit]]
                if len(hit):
                    yield made(hit // len(whole), whole[hit % len(whole)], 1, None, h.ravel()[hit])
                left = before[:, whole] * power[size - whole] + after[:, whole + 1]  # replacements
                h = left[:, :, None] + own[None, None, :] * power[size - 1 - whole][None, :, None]
                hit = self.passing(h)
                word, rest = np.divmod(hit, len(whole) * len(own))
                place, letter = whole[rest // len(own)], self.alphabet[rest % len(own)]
                other = letters[word, place] != letter
                if other.any():
                    yield made(word[other], place[other], 1, letter[other], h.ravel()[hit[other]])
            left = before[:, at] * power[size + 1 - at] + after[:, at]  # insertions; never after an equal letter, where it is made one place before
            h = left[:, :, None] + own[None, None, :] * power[size - at][None, :, None]
            hit = self.passing(h)
            word, rest = np.divmod(hit, len(at) * len(own))
            place, letter = at[rest // len(own)], self.alphabet[rest % len(own)]
            new = (place == 0) | (letters[word, np.maximum(place, 1) - 1] != letter)
            if new.any():
                yield made(word[new], place[new], 0, letter[new], h.ravel()[hit[new]])

    def __call__(self, words: list[str], counts: np.ndarray) -> Iterator[dict[str, list]]:
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))] = np.arange(len(words))  # the best has the least
        parts: dict[int, list] = {}
        with np.errstate(over="ignore"):
            for at, letters in spelt(words).values():
                for word, h, made in self.of_length(letters):
                    parts.setdefault(made.shape[1], []).append((at[word], h, made))
                    if sum(p[2].nbytes for p in parts[made.shape[1]]) > 1 << 26:
                        yield self.summed(words, counts, rank, parts.pop(made.shape[1]))
            for found in parts.values():
                yield self.summed(words, counts, rank, found)

    @staticmethod
    def summed(words: list[str], counts: np.ndarray, rank: np.ndarray, found: list) -> dict[str, list]:
        word, h, made = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank[word], h))
        word, h, made = word[order], h[order], made[order]
        new = np.ones(len(word), bool)  # letters decide, the hash only brings equal ones together
        new[1:] = (h[1:] != h[:-1]) | (made[1:] != made[:-1]).any(1)
        first = np.flatnonzero(new)
        size = made.shape[1]
        text = made[first].tobytes().decode("latin-1")
        return {
            "candidate": [text[i : i + size] for i in range(0, len(text), size)],
            "emitters": np.diff(np.append(first, len(word))),
            "best_n": counts[word[first]],
            "best": [words[i] for i in word[first]],
        }


def emitted(vocabulary: DataFrame, alphabet: str, held: np.ndarray, bits: int) -> DataFrame:
    """candidate, emitters, best_n, best: partial sums, a row for each candidate and block of words."""
    sent = vocabulary.sparkSession.sparkContext.broadcast((alphabet.encode("latin-1"), held, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Neighbourhoods(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for out in make(part.column(0).to_pylist(), part.column(1).to_numpy()):
                    if len(out["best"]):
                        yield pa.RecordBatch.from_arrays([pa.array(out["candidate"]), pa.array(out["emitters"], pa.int64()), pa.array(out["best_n"], pa.int64()), pa.array(out["best"])], ["candidate", "emitters", "best_n", "best"])

    return vocabulary.mapInArrow(run, "candidate string, emitters long, best_n long, best string")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root, a row for each word.

    form is the near word of largest n (ties: the smallest) if that is at least TIMES
    the word's, else null; root is where forms end that are followed from the word.
    """
    counted = written(observed(docs), "spelling-counts")
    words = counted.count()
    parts = max(1, -(-words // (4 * BLOCK)))  # of some equal work
    vocabulary = written(counted.repartitionByRange(parts, "word").sortWithinPartitions("word"), "spelling-vocabulary")
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).distinct().agg(F.array_join(F.sort_array(F.collect_set("letter")), "")).first()[0]  # of one class of 89
    held, bits = filter_of(vocabulary, words)
    found = emitted(vocabulary, letters, held, bits).groupBy("candidate").agg(F.sum("emitters").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("top"))
    out = vocabulary.join(found, F.col("word") == F.col("candidate"), "left")
    enough = -F.col("top.less") >= TIMES * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("top.form")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n"))
    out = written(out, "spelling-forms")
    dropped(counted)
    # a form is at least TIMES as frequent, so chains have no more steps than the largest count has binary digits; each table halves what is left
    ways = written(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ways.select(F.col("word").alias("by"), F.col("root").alias("next"))
        joined = ways.join(on, F.col("root") == F.col("by"), "left")
        step = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = step.where("moved").limit(1).count()
        dropped(ways)
        ways = step.select("word", "root")
        if not moved:
            break
    roots = ways.select(F.col("word").alias("of"), "root")
    return out.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_sql() -> str:
    """DuckDB SQL for the same, by another method: words that share what is left when a letter is masked or deleted."""
    return f"""WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY doc_id, run),
b AS (SELECT doc_id, run, times, list_transform(string_split(trim(regexp_replace(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '(..)', '\\1 ', 'g')), ' '), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes FROM r),
c AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: x::BIGINT)),
  lambda c, y: xor(c >> 8, list_reduce(list_prepend(xor(c, y) & 255, range(8)), lambda t, j: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % {DISTURB} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM c),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_SEEN}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM p),
m AS (SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS mask FROM p),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM m a JOIN m b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION ALL SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.less = v.word),
t AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS rank, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(t.n_near, 0)::BIGINT AS n_near, CASE WHEN t.other_n >= {TIMES} * v.n THEN t.other END AS form, CASE WHEN t.other_n >= {TIMES} * v.n THEN t.other_n END AS form_n FROM v LEFT JOIN t ON v.word = t.word AND t.rank = 1),
chain AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT c.word, c.onward, f.form FROM chain c JOIN f ON c.onward = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM f JOIN chain c ON f.word = c.word AND c.onward IS NULL"""
