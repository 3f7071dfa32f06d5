"""Language of a text, by a convolutional network over its bytes, in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one padded
with zeros); each byte has a vector, filters of WIDTHS bytes slide over them, each
filter keeps its largest response (ReLU, max pooling), and a softmax layer gives
the languages. A text's score is the mean of its windows' log-probabilities,
weighted by their bytes, put through softmax again. All windows of the whole text
count. Training takes at most PER_LANG texts of each of the LANGS most frequent
languages (TEXTS in all), by smallest hash of the id, and at most WINDOWS_ALL windows,
drawn from all windows of these whole texts; it runs on the driver and is
deterministic. Rarer languages than these are never predicted.

Null text, or text without a letter: `und` with score 0. Without training rows
every text is `und`. Texts with a null language teach nothing. Equal texts get
equal predictions; repeated rows stay; an empty table gives no rows. Columns other than
doc_id, text and lang, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, map_slices

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 8, 8
PER_LANG, WINDOWS_ALL, LANGS, TEXTS = 400, 8000, 256, 8000
EPOCHS, BATCH, RATE = 6, 64, 0.01
BLOCK = 64  # windows that are computed at once


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (max width * DEPTH, all filters); rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, (n, WINDOW)."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def responses(net: Network, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors under the filters, (n, positions, width * DEPTH), and responses, (n, positions, filters)."""
    x = net.embed[grid]
    w, last = max(WIDTHS), WINDOW - max(WIDTHS) + 1
    view = np.lib.stride_tricks.as_strided(x, (len(grid), last, w * DEPTH), (x.strides[0], x.strides[1], x.strides[2]), writeable=False)
    cols = np.ascontiguousarray(view).reshape(-1, w * DEPTH)
    return cols.reshape(len(grid), last, -1), (cols @ net.filters).reshape(len(grid), last, -1)


def log_probabilities(net: Network, grid: np.ndarray) -> np.ndarray:
    out = []
    for at in range(0, len(grid), BLOCK):
        peak = responses(net, grid[at : at + BLOCK])[1].max(1)
        z = np.maximum(peak + net.bias, 0) @ net.out + net.out_bias
        z -= z.max(1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(out)


def train(texts: list[str], langs: list[str]) -> Network:
    """Adam on cross-entropy over windows of the given texts."""
    rng, names = np.random.default_rng(7), sorted(set(langs))
    w, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.repeat(np.concatenate([np.repeat((np.arange(w) < k)[:, None], FILTERS, 1) for k in WIDTHS], 1), DEPTH, 0).astype(np.float32)
    net = Network(names, rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), (rng.normal(0, 0.3, (w * DEPTH, n_filters)).astype(np.float32) * mask), np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    grids, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        grid = windows(t.encode("utf-8", "surrogatepass"))
        grids.append(grid)
        ys += [names.index(lang)] * len(grid)
    if not grids:
        return net
    x, y = np.concatenate(grids), np.array(ys)
    drawn = rng.permutation(len(x))[:WINDOWS_ALL]
    x, y = x[drawn], y[drawn]
    params = ["embed", "filters", "bias", "out", "out_bias"]
    m, v, step = {k: 0.0 for k in params}, {k: 0.0 for k in params}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            grid, target = x[pick], y[pick]
            cols, r = responses(net, grid)
            where = r.argmax(1)
            peak = np.take_along_axis(r, where[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(peak, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), target] -= 1
            p /= len(pick)
            back = (p @ net.out.T) * (peak > 0)
            under = cols[np.arange(len(pick))[:, None], where]  # (n, filters, width * DEPTH)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("nf,nfd->df", back, under) * mask}
            to_embed = (back[:, :, None] * net.filters.T[None]).reshape(len(pick), n_filters, w, DEPTH)
            which = grid[np.arange(len(pick))[:, None, None], where[:, :, None] + np.arange(w)]
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], which, to_embed)
            step += 1
            for k in params:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, (getattr(net, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(docs: DataFrame, keep: F.Column) -> tuple[list[str], list[str]]:
    """At most PER_LANG texts (TEXTS in all) of each of the LANGS most frequent languages, by smallest hash of the id.

    The hash is first held under a share that its language's count gives, so the
    sort that follows has a bounded number of rows, whatever the languages' sizes.
    """
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return [], []
    most = max(1, min(PER_LANG, TEXTS // len(counts)))
    unit = (F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("unit")
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * most / r["count"])))))
    few = rows.select("doc_id", "lang", "text", unit).where(F.col("unit") < share[F.col("lang")])
    got = sorted(few.collect(), key=lambda r: (r.unit, str(r.doc_id), r.text))
    seen: dict[str, int] = {}
    out = [r for r in got if seen.setdefault(r.lang, 0) < most and not seen.update({r.lang: seen[r.lang] + 1})]
    return [r.text for r in out], [r.lang for r in out]


def held_out() -> F.Column:
    return id_crc() % 3 == 1


def scored(docs: DataFrame, net: Network) -> DataFrame:
    def make():
        def one(text):
            if not net.langs or text is None or not has_letter(text):
                return "und", 0.0
            raw = text.encode("utf-8", "surrogatepass")
            grid = windows(raw)
            share = np.full(len(grid), WINDOW, np.float64)
            share[-1] = len(raw) - WINDOW * (len(grid) - 1)
            z = (log_probabilities(net, grid) * share[:, None]).sum(0) / share.sum()
            p = np.exp(z - z.max())
            best = int(p.argmax())
            return net.langs[best], float(p[best] / p.sum())

        def run(cols):
            rows = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}

        return run

    return map_slices(docs.select("doc_id", "text"), make, "doc_id bigint, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows that held_out marks teach nothing."""
    net = train(*sample(docs, ~held_out()))
    return scored(docs, net).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
