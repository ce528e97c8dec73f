"""Byte-level BPE: exact encoding in linear time, decoding by an offset table.

Encoding walks a piece once with an Aho-Corasick automaton over all tokens, which gives the
longest token that starts at each byte. It then tries longest tokens from the left and keeps
one only if the merges would leave it beside its left neighbour (the pair-compatibility
table); otherwise it tries the next shorter prefix and, without one, steps back and marks the
byte as unreachable. No byte is marked twice, so the work is linear in the piece.

Null texts count as empty and have no ids. Empty text: no ids, decoded to the empty text.
Texts are handled whole; a piece of any length costs memory in proportion to its bytes only.
Rows are independent, so repeated rows and ties have equal results and clashing columns
don't matter: only the column named is read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, StringType

#: Entries of a worker's memory for pieces and pairs; a full one starts anew. Never changes a result.
PIECES_KEPT = 1 << 19
PAIRS_KEPT = 1 << 19
#: Only pieces up to this many characters are remembered, to bound the memory of an entry.
PIECE_CHARS = 48
#: Tokens decoded at once.
DECODE_TOKENS = 1 << 16

# The pattern of the byte-level splitter, and its white space.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def with_space(pattern: str) -> str:
    """The pattern with white space spelt out, so that no library's own class matters."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Memo(dict):
    """A dict that computes what it lacks and empties itself when full."""

    def __init__(self, make, most: int, longest: int | None = None):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens with stripping or normalising aren't supported")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        # Own numbers follow the merge order: bytes first, then a number per merge.
        vocab = model["vocab"]
        self.token = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.token)}
        self.halves = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            if a + b in number:
                raise ValueError(f"two merges make the token {a + b!r}")
            number[a + b] = self.merged[number[a], number[b]] = len(self.token)
            self.halves.append((number[a], number[b]))
            self.token.append(a + b)
        ids = {raw(t): i for t, i in vocab.items()}
        self.id_of = [ids[t] for t in self.token]
        self.four = [i.to_bytes(4, "little") for i in self.id_of]
        self.length = [len(t) for t in self.token]
        self._compatible = Memo(self._stays, PAIRS_KEPT)
        # A token takes part only if the merges make it from its own bytes.
        made = [True] * 256
        for t in range(256, len(self.token)):
            a, b = self.halves[t]
            made.append(made[a] and made[b] and self._stays((a, b), t))
        self.automaton = ahocorasick.Automaton()
        for t, name in enumerate(self.token):
            if made[t]:
                self.automaton.add_word(name.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t, number, made) for t in range(len(self.token))]
        self.split = regex.compile(with_space(PIECE)).findall
        self.added = {a["content"]: a["id"] for a in added}
        by_length = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if added else None
        self.pieces = Memo(self._piece, PIECES_KEPT, PIECE_CHARS)
        # Decoding: the bytes of all ids in one string, and where each begins.
        by_id = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        size = max(by_id) + 1
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.offset = np.cumsum([0, *(len(by_id.get(i, b"")) for i in range(size))])

    def _prefix(self, t: int, number: dict, made: list) -> int:
        name = self.token[t]
        for n in range(len(name) - 1, 0, -1):
            if (p := number.get(name[:n])) is not None and made[p]:
                return p
        return -1

    def _stays(self, pair: tuple[int, int], limit: int = 1 << 62) -> bool:
        """Whether the merges leave the tokens of a pair side by side.

        Takes the later of the two apart step by step; a merge across the border that would
        come before the merge just undone, and before limit, breaks the pair.
        """
        left, right = pair
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit, left = left, self.halves[left][1]
            else:
                if right < 256:
                    return True
                limit, right = right + 1, self.halves[right][0]

    def piece(self, text: str) -> list[int]:
        """Own numbers of a piece given as Latin-1 letters for bytes."""
        length, shorter, compatible = self.length, self.shorter, self._compatible
        n = len(text)
        longest = [0] * n
        for end, t in self.automaton.iter(text):
            longest[end + 1 - length[t]] = t
        out: list[int] = []
        closed: set[int] = set()
        at, t, last = 0, longest[0], -1
        while True:
            end = at + length[t]
            if end not in closed and (last < 0 or compatible[last, t]):
                out.append(t)
                if end == n:
                    return out
                at, last, t = end, t, longest[end]
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                closed.add(at)
                t = out.pop()
                at -= length[t]
                last = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.four[t] for t in self.piece(piece.encode().decode("latin-1"))])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        ids_of = self.pieces.__getitem__
        if not self.special or not self.special.search(text):
            return b"".join(map(ids_of, self.split(text)))
        out = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out.extend(map(ids_of, self.split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; unknown ids add nothing, broken UTF-8 becomes replacement characters."""
        every = np.frombuffer(ids, "<u4")
        every = every[every < len(self.offset) - 1] if len(every) and every.max() >= len(self.offset) - 1 else every
        out = []
        for k in range(0, len(every), DECODE_TOKENS):
            part = every[k : k + DECODE_TOKENS]
            start = self.offset[part]
            size = self.offset[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(text: Column, path: str) -> Column:
    """Ids of each text with the vocabulary file at path, as binary little-endian 32-bit integers."""

    @F.arrow_udf(BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        bpe = loaded(path)
        return pa.array((bpe.encode(t.as_py() or "") for t in texts), pa.binary())

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of binary ids, special tokens included; null ids give the empty text."""

    @F.arrow_udf(StringType())
    def text(every: pa.Array) -> pa.Array:
        bpe = loaded(path)
        return pa.array((bpe.decode(i.as_py() or b"") for i in every), pa.string())

    return text(ids)
