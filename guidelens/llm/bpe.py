"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last one of its
encoding. A matching automaton over the vocabulary gives, at each byte, all
tokens that are suffixes of the prefix; the one that fits behind the last token
of the rest is the answer. Two tokens fit when no merge across their border
would have come before the merges that built them. Back-pointers from the whole
piece then give the ids, in time linear in the piece.

Null or empty text: no tokens. Special tokens' strings in a text become their
ids, as the tokenizers library does. Rows are independent: repeated rows, ties
and empty tables need no rule. Texts of any length are taken whole. Columns other than
the id and the text, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_slices

SPACE = r"[\p{White_Space}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Fixed value: the word pattern of byte-level pre-tokenizers.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE[1:-1]}\p{{L}}\p{{N}}]+|{SPACE}+(?!{NOT_SPACE})|{SPACE}+"
CACHE = 400_000  # pieces, or pairs, that a task remembers before it starts anew
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceCache(dict):
    """Piece to its ids' bytes; bounded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = np.array(self.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class ByteBpe:
    """An encoder and decoder for a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if spec.get("normalizer") or model.get("byte_fallback") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        raw = lambda s: bytes(letters[c] for c in s)
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            parts.setdefault(whole, (*pair, r))
        for a, b, r in parts.values():
            if max(parts.get(a, (0, 0, -1))[2], parts.get(b, (0, 0, -1))[2]) >= r:
                raise ValueError("a merge comes before one of its parts")
        self.parts = parts
        self.automaton = ahocorasick.Automaton()
        built = {*parts, *(i for i, b in self.bytes_of.items() if len(b) == 1)}
        for i in built:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", ()):
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("added tokens that strip or need word borders aren't supported")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache = PieceCache(self.encode_piece)

    def forget(self) -> None:
        """Empty the memories of pieces and pairs; the worker may run other tasks next."""
        self.cache.clear()
        self.fits.clear()

    def border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end (0: left, 1: right) of a token as its merges are undone, each with the rank of the merge that takes it up."""
        out, until = [], NEVER
        while token in self.parts:
            out.append((token, until))
            until, token = self.parts[token][2], self.parts[token][side]
        return [*out, (token, until)]

    def compatible(self, a: int, b: int) -> bool:
        """No merge over the border of a and b comes before what consumes its two sides."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = True
            theirs = self.border(b, 0)
            for x, x_until in self.border(a, 1):
                for y, y_until in theirs:
                    r = self.rank.get((x, y))
                    if r is not None and x_until > r and y_until >= r:
                        known = False
            self.fits[(a, b)] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[tuple[int, int] | None] = [None] * (len(piece) + 1)
        done = 0
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if done == end:
                continue
            start = end - size
            if start == 0 or (last[start] is not None and self.compatible(last[start][0], token)):
                last[end] = (token, start)
                done = end
        ids, at = [], len(piece)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            elif part:
                out.extend(map(self.cache.__getitem__, self.pieces.findall(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder a Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ids (array of int) of every text. path: the vocabulary file, on every machine."""

    def make():
        bpe = loaded(path)
        return lambda cols: {"id": cols["id"], "ids": [bpe.encode(t) for t in cols["text"]]}

    return map_slices(df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text"), make, "id bigint, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Id and text of every array of ids; null ids give null."""

    def make():
        bpe = loaded(path)
        return lambda cols: {"id": cols["id"], "text": [None if x is None else bpe.decode(x) for x in cols["ids"]]}

    return map_slices(df.selectExpr(f"`{id_column}` AS id", f"`{ids_column}` AS ids"), make, "id bigint, text string").withColumnRenamed("id", id_column)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them."""

    def make():
        bpe = loaded(path)

        def one(text):
            raw = bpe.encode_bytes(text)
            back = bpe.decode(np.frombuffer(raw, "<u4").tolist())
            return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()

        def run(cols):
            rows = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

        run.end = bpe.forget
        return run

    return map_slices(df.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
