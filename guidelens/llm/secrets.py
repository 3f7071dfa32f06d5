"""Secret scans: base patterns, and a linear-chain conditional random field over words.

Runs of anything but ASCII white space fall into parts at quotes, commas, colons,
equals signs, ampersands, semicolons, bars, angles and brackets of all kinds, which go
with the part before them (at a run's start, with the one after): compact JSON, URLs and
headers are many parts. These, below called words, are tagged B, I or O: a secret's
first word, its further words, or outside. A word's scores come from its own shape
(classes of letters, length, digits, entropy, prefixes), all over the whole word, the words before and
after it, and the text's kind (key=value lines, code marks). Viterbi decoding is
exact: a word whose O leads by more than all transitions can turn is O on the best
path, so the chain falls apart into short stretches that are decoded one by one.

The field is trained here, on generated sentences with planted secrets of several
kinds and harmless look-alikes (numbers, addresses, long words), by gradient
ascent; it needs no corpus and is the same in every run.

Base spans always stay: `assign`, `access` and `hex` as documented at BASE. The
field's spans have kind `crf` and are left out where they touch a base span. Null
and empty texts have no spans; texts of any length are scanned whole; rows are
independent, so repeated rows get equal spans and an empty table gives no rows.
scans() needs doc_id and text only; redacted() keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, map_slices, slices_of

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
_HEX_BYTES = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
_HINT = re.compile("key|token|secret|pass|bearer|auth|credential|private|begin", re.I | re.A)
_MARKS = r""" "',:=&;|<>(){}\[\]""".strip()
_WORD_BYTES = re.compile(rb"[%b]*[^%b\x20\x09-\x0D]+[%b]*|[%b]+" % ((_MARKS.encode(),) * 4))
_WORD = re.compile(_WORD_BYTES.pattern.decode())
B, I, O = 0, 1, 2  # noqa: E741
BUCKETS = 1 << 14
WORDS = 100_000  # word scores that a task remembers before it starts anew


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then by kind as listed.

    raw: the text's UTF-8 bytes; quick searches in them tell which patterns can match at all.
    """
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, out = raw.lower(), []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(k in low for k in KEYWORDS) or kind == "access" and b"AKIA" not in raw or kind == "hex" and b"h" * least not in raw.translate(_HEX_BYTES):
            continue
        # a long enough run of hex digits is a match of its own: matches are maximal runs
        found = (_HEX_RUN if kind == "hex" else pattern).finditer(text)
        out += [(kind, m.start(), m.end()) for m in found if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS


def _entropy(word: str) -> float:
    return -sum((n := word.count(c) / len(word)) * math.log2(n) for c in set(word))


def _shape(word: str) -> str:
    if word.isalpha() and (word.islower() or word.isupper()):
        return ("A" if word.isupper() else "a") + "+" * (len(word) > 1)
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", r"\1+", kinds)


def _form(word: str) -> str:
    """The shape where it is short; of a longer one how long it is and which kinds it has."""
    shape = _shape(word)
    return shape if len(shape) <= 12 else f"{len(shape).bit_length()}:{''.join(sorted(set(shape)))[:16]}"


def _core(word: str) -> str:
    return word.strip("\"'`,;:.!?()[]{}<>|*#&%$=")


@cache
def _buckets(role: str, names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(_bucket(f"{role}:{n}") for n in names)


def word_features(word: str) -> tuple[str, ...]:
    """Shape features of a word on its own."""
    core = _core(word)
    letters, digits = sum(map(str.isalpha, core)), sum(map(str.isdigit, core))
    mixed = core.isascii() and letters >= 3 and digits >= 3
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    return (
        "bias", f"len{min(len(core).bit_length(), 8)}", f"shape={_form(core)}",
        f"mixed={mixed}:{len(core) >= 16}", f"digits={digits * 4 // max(1, len(core))}",
        f"entropy={int(_entropy(core) * 2) if mixed else 0}", f"turns={min(turns, 8)}:{mixed}",
        f"case={core.isupper()}{core.islower()}", f"at={'@' in core}", f"scheme={'://' in core}",
        f"prefix={core[:4] if mixed and not core[:1].isdigit() else ''}", f"marks={sum(c in '+/_-=' for c in core) > 0}:{mixed}", f"dashes={core.startswith('-----')}",
    )


def neighbour_features(word: str) -> tuple[str, ...]:
    """What a word tells about the words beside it."""
    found = _HINT.search(word)
    hint = found[0].lower() if found else "none"
    return (f"hint={hint}", f"ends={word[-1:] if word[-1:] in ':=\"' else ''}")


def file_features(text_bytes: bytes) -> tuple[str, ...]:
    """What the whole text tells: lines of settings, marks of code."""
    n = len(text_bytes) + 1
    return (f"settings={min(3, 200 * text_bytes.count(b'=') // n)}", f"code={min(3, 200 * (text_bytes.count(b'{') + text_bytes.count(b';')) // n)}")


class Rows(dict):
    """Word (UTF-8) to its row of scores in a field's tables."""

    def __init__(self, row):
        self.row = row

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self.row(word.decode("utf-8", "surrogatepass"))
        return at


class Field:
    """Weights: one score for each feature and tag, and for each pair of tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.spread = 2 * float(moves.max() - moves.min())
        self.forget()

    def forget(self) -> None:
        self.known = Rows(self.row)
        self.rows: dict[object, int] = {}
        self.own, self.before, self.after = (np.zeros((1024, 3)) for _ in range(3))

    def score(self, role: str, names: tuple[str, ...]) -> np.ndarray:
        return self.weights[[_bucket(f"{role}:{n}") for n in names]].sum(0)

    def row(self, word: str) -> int:
        """Row of the word in the tables own, before (as the word before) and after."""
        core, near = _core(word), neighbour_features(word)
        # words of letters alone have the same features when these agree, so they share a row
        alike = (len(core).bit_length(), core.isupper(), core.islower(), _form(core), core.isascii(), near) if core.isalpha() else word
        at = self.rows.get(alike)
        if at is None:
            at = self.rows[alike] = len(self.rows)
            if at == len(self.own):
                self.own, self.before, self.after = (np.concatenate((t, np.zeros_like(t))) for t in (self.own, self.before, self.after))
            self.own[at], self.before[at], self.after[at] = self.score("own", word_features(word)), self.score("before", near), self.score("after", near)
        return at

    def emissions(self, words: list[bytes], raw: bytes) -> np.ndarray:
        if len(self.known) >= WORDS:
            self.forget()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        e = self.own[at] + self.score("file", file_features(raw))
        e[1:] += self.before[at[:-1]]
        e[:-1] += self.after[at[1:]]
        return e

    def tags(self, e: np.ndarray) -> dict[int, int]:
        """Positions whose tag on the best path is B or I.

        A word whose O leads both other tags by more than twice the spread of the
        transitions is O on the best path: changing it to O costs two transitions
        at most. The stretches between such words are decoded exactly.
        """
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.spread)
        out: dict[int, int] = {}
        if not len(open_):
            return out
        for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            a, b = int(stretch[0]), int(stretch[-1]) + 1
            best = e[a] + (self.moves[O] if a else 0)
            back = []
            for i in range(a + 1, b):
                step = best[:, None] + self.moves
                back.append(step.argmax(0))
                best = step.max(0) + e[i]
            if b < len(e):
                best = best + self.moves[:, O]
            tag = int(best.argmax())
            for i in range(b - 1, a - 1, -1):
                if tag != O:
                    out[i] = tag
                if i > a:
                    tag = int(back[i - a - 1][tag])
        return out


def _random(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def generated(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A sentence of invented words with at most two planted secrets and look-alikes, and its tags."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_, words, tags = low + up + num, [], []
    syllables = ["the", "on", "er", "tion", "in", "an", "der", "ge", "ung", "lich", "de", "la", "que", "eau", "ment", "ción", "ar", "ja", "st", "re"]

    def plain():
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 6)))

    def filler():
        kind = rng.integers(0, 36)
        w = plain()
        return [
            w.capitalize(), w + ",", w + ".", w.upper(), f"{w}.{rng.integers(99)}@mail{rng.integers(9)}.example.com", f"{w}.{plain()}@{plain()}.org", ".".join(str(x) for x in rng.integers(0, 255, 4)), _random(rng, num, 16), f"+1 ({rng.integers(999)})", f"https://{w}.example.net/{w}/{rng.integers(9999)}",
            f"20{rng.integers(10, 99)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", f"{rng.integers(999)}-{rng.integers(9999)}", "|", w + "###", "v1.2.3", "(" + w + ")", "token", "secret", "key", "password", f"{w}{rng.integers(99)}", f"{w}-{w}_{rng.integers(9)}", w.upper() + "!!", "DE" + _random(rng, num, 20), f"{w}_{plain()}({w})",
        ][kind] if kind < 25 else w

    def secret():
        return [
            lambda: ["ghp_" + _random(rng, any_, 36)],
            lambda: ["token", "=", '"' + _random(rng, low[:6] + num, 40) + '"'],
            lambda: ["xoxb-" + _random(rng, num, 11) + "-" + _random(rng, any_, 24)],
            lambda: ["Authorization:", "Bearer", "eyJ" + _random(rng, any_, 30) + "." + _random(rng, any_ + "_-", 40) + "." + _random(rng, any_ + "_-", 30)],
            lambda: ["api_key", "=", _random(rng, any_, int(rng.integers(20, 44)))],
            lambda: ["AKIA" + _random(rng, up + num, 16)],
            lambda: ["sk-" + _random(rng, any_, 48)],
            lambda: ["secret:", _random(rng, any_ + "+/", 40)],
            lambda: ["-----BEGIN", "PRIVATE", "KEY-----", *(_random(rng, any_ + "+/", 64) for _ in range(int(rng.integers(2, 6)))), "-----END", "PRIVATE", "KEY-----"],
            lambda: ["postgres://admin:" + _random(rng, any_, 20) + "@db.example.com/main"],
        ][int(rng.integers(0, 10))]()

    manner = [str, str, str, str.upper, lambda w: w + "###", lambda w: w.upper() + "!!", lambda w: w + "&&&"][int(rng.integers(0, 7))]
    for _ in range(int(rng.integers(8, 24))):
        if rng.random() < 0.08:
            s = secret()
            if s[0].startswith("-----"):
                t = [B] + [I] * (len(s) - 1)
            else:
                t = [O] * (len(s) - 1) + [B]
            if t[-1] == B and rng.random() < 0.3:  # as a value of compact JSON, or of a query
                s, t = [[f'{{"{plain()}":"{plain()}","{["key", "token", "auth"][int(rng.integers(0, 3))]}":"{s[-1].strip(chr(34))}","{plain()}":{rng.integers(99)}}}'], [f"{plain()}={rng.integers(99)}&auth={s[-1].strip(chr(34))}"]][int(rng.integers(0, 2))], [B]
        else:
            s, t = [manner(filler()) if rng.random() < 0.95 else f'{{"{plain()}":"{filler()}","{plain()}":{rng.integers(9999)}}}'], [O]
        for word, tag in zip(s, t, strict=True):
            found = _WORD.findall(word)
            longest = max(range(len(found)), key=lambda i: len(_core(found[i])))
            words += found
            tags += [tag if i == longest or tag == I else O for i in range(len(found))]
    return words, tags


@cache
def trained(sentences: int = 1200, passes: int = 5, rate: float = 0.5) -> Field:
    """Conditional likelihood raised by AdaGrad over generated sentences; deterministic."""
    rng = np.random.default_rng(11)
    data = []
    for _ in range(sentences):
        words, tags = generated(rng)
        raw = " ".join(words).encode()
        near, file = [neighbour_features(w) for w in words], _buckets("file", file_features(raw))
        feats = [np.array([_bucket(f"own:{n}") for n in word_features(w)] + list(file) + (list(_buckets("before", near[i - 1])) if i else []) + (list(_buckets("after", near[i + 1])) if i + 1 < len(words) else [])) for i, w in enumerate(words)]
        data.append((feats, np.array(tags)))
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    seen_w, seen_m = np.full((BUCKETS, 3), 1e-2), np.full((3, 3), 1e-2)
    for _ in range(passes):
        for feats, tags in data:
            e, n = np.array([weights[f].sum(0) for f in feats]), len(tags)
            t, z = np.exp(moves), np.exp(e - e.max(1, keepdims=True))
            ahead, behind = np.zeros((n, 3)), np.ones((n, 3))
            ahead[0] = z[0] / z[0].sum()
            for i in range(1, n):
                ahead[i] = ahead[i - 1] @ t * z[i]
                ahead[i] /= ahead[i].sum()
            for i in range(n - 2, -1, -1):
                behind[i] = t @ (z[i + 1] * behind[i + 1])
                behind[i] /= behind[i].sum()
            one = ahead * behind
            one /= one.sum(1, keepdims=True)
            two = ahead[:-1, :, None] * t[None] * (z[1:] * behind[1:])[:, None, :]
            two /= two.sum((1, 2), keepdims=True)
            g_m = -two.sum(0)
            np.add.at(g_m, (tags[:-1], tags[1:]), 1)
            g_m -= 0.02 * moves
            seen_m += g_m**2
            moves = moves + 0.2 * g_m / np.sqrt(seen_m)
            g = -one
            g[np.arange(n), tags] += 1
            for f, row in zip(feats, g, strict=True):
                seen_w[f] += row**2
                weights[f] += rate * row / np.sqrt(seen_w[f])
    return Field(weights, moves)


def spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, of the whole text."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    words = _WORD_BYTES.findall(raw)
    tags = field.tags(field.emissions(words, raw)) if words else {}
    if not tags:
        return base, base
    places = [m.span() for m in _WORD.finditer(text)]
    runs: list[tuple[str, int, int]] = []
    for i in sorted(tags):
        a, b = places[i]
        core = _core(text[a:b])
        at = a + text[a:b].find(core) if core else a
        end = at + len(core) if core else b
        if tags[i] == I and i - 1 in tags and runs:
            runs[-1] = ("crf", runs[-1][1], end)
        else:
            runs.append(("crf", at, end))
    starts = [(s, e) for _, s, e in base]
    extra = [r for r in runs if not any(s < r[2] and r[1] < e for s, e in starts)]
    return base, sorted(base + extra, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans of every document."""
    field = trained()

    def make():
        own = Field(field.weights, field.moves)

        def run(cols):
            rows = [spans(t, own) for t in cols["text"]]
            out = {"doc_id": cols["doc_id"]}
            out |= {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in rows] for k in ("assign", "access", "hex")}
            return out | {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], "spans": [joined(every) for _, every in rows]}

        return run

    return map_slices(docs.select("doc_id", "text"), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """Documents with every span replaced by mark, and n_chars, if there is one, set to the new length; null texts stay as they are, and so do all other columns, whatever their names and types."""
    field = trained()

    def run(batches):
        own = Field(field.weights, field.moves)

        def one(text):
            found = spans(text, own)[1]
            if not found:
                return text
            out, at = [], 0
            for _, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join(out) + text[at:]

        for part in slices_of(batches):
            old = part.column("text").to_pylist()
            new = [one(t) for t in old]
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns["text"] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in columns:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new, strict=True)]
                columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)

    return map_batches(docs, run, docs.schema)
