"""Byte-level BPE by segment trees, with the ids the usual greedy merge gives.

Each piece of a text keeps a segment tree over its byte positions. A leaf holds the rank of the pair that starts there
and its position in one number, so the root is the leftmost minimum pair rank. A merge changes three leaves - the
pair itself, its live left neighbour and the position that dies - and each change walks one path to the root.

Short pieces of like length run in lockstep: their trees are rows of one array and every step merges one pair in each
row that still has any. Long pieces run alone on a plain list. Pieces repeat a lot, so their ids are kept in a cache
of bounded size; texts themselves are never split or shortened.

Edge cases: a null text is encoded as empty (no ids, empty decoded bytes); every string in a text is ordinary text,
special tokens included; repeated rows give repeated rows; columns that are not asked for are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per worker; past this the cache starts anew.
CACHE = 500_000
#: Bytes of text that are encoded together.
CHUNK = 2_000_000
#: Longest piece (bytes) that runs in lockstep, and leaves of one lockstep array.
SHORT, LEAVES = 128, 1 << 17
#: Slots of the pair table (a power of two, several times the pairs), and the rank of what is no pair.
SLOTS, NO_RANK = 1 << 20, np.int32(1 << 23)
# Unicode White_Space; fixed values
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _ranges(kind: str, last: int) -> str:
    """A character class body: the code points up to `last` whose Unicode category starts with `kind`."""
    found = [i for i in range(last + 1) if unicodedata.category(chr(i))[0] == kind]
    out = []
    for _, run in groupby(enumerate(found), lambda x: x[1] - x[0]):
        own = [x[1] for x in run]
        out.append(f"\\U{own[0]:08x}-\\U{own[-1]:08x}")
    return "".join(out)


@lru_cache(None)
def splitter(last: int) -> re.Pattern:
    """The tokenizer's pattern spelled out for `re`, for texts without code points over `last`."""
    letter, number, blank = _ranges("L", last), _ranges("N", last), BLANKS
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def pieces(text: str) -> list[str]:
    if text.isascii():
        return splitter(0x7F).findall(text)
    # astral classes slow every test of a character, so they are used only where a text has such code points
    return splitter(0xFFFF if len(text.encode("utf-16-le")) == 2 * len(text) else sys.maxunicode).findall(text)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.int64(0x1E3779B97F4A7C15)) >> np.int64(40)) & SLOTS - 1


class Tokenizer:
    """Ranks from a file of base64 tokens and ranks, a line each."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {v: k for k, v in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.slot_keys, self.slot_ranks, self.probes = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NO_RANK, np.int32), 1
        for key, rank, slot in zip(keys, values, _slot(np.array(keys, np.int64)).tolist(), strict=True):
            probe = 0
            while self.slot_keys[slot + probe & SLOTS - 1] >= 0:
                probe += 1
            self.slot_keys[slot + probe & SLOTS - 1], self.slot_ranks[slot + probe & SLOTS - 1] = key, rank
            self.probes = max(self.probes, probe + 1)
        self.byte_pairs = self._pair(self.byte.repeat(256), np.tile(self.byte, 256))
        self.cache: dict[str, bytes] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where there is none: an open-addressing table probed for all at once."""
        key = a.astype(np.int64) << 32 | b
        slot = _slot(key)
        rank = np.where(self.slot_keys[slot] == key, self.slot_ranks[slot], NO_RANK)
        for step in range(1, self.probes):
            at = slot + step & SLOTS - 1
            rank = np.where(self.slot_keys[at] == key, self.slot_ranks[at], rank)
        return rank

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece, its tree in a list: node i has children 2i and 2i + 1, leaves start at `size`."""
        n, none = len(piece), 1 << 62
        size = 1 << max(1, (n - 1).bit_length())
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get

        def leaf(i: int) -> int:
            j = after[i]
            r = rank(parts[i] + parts[j]) if j < n else None
            return none if r is None else r * size + i

        tree = [none] * size + [leaf(i) for i in range(n)] + [none] * (size - n)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] != none:
            i = tree[1] % size
            j = after[i]
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [self.ranks[p] for p in parts if p is not None]

    def merge_short(self, block: list[bytes], size: int) -> list[bytes]:
        """Pieces of up to `size` bytes (a power of two) in lockstep; their ids as little-endian 32-bit numbers."""
        rows = len(block)
        length = np.fromiter(map(len, block), np.int32, rows)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in block), np.uint8).reshape(rows, size)
        place = np.arange(size, dtype=np.int32)
        inside = place < length[:, None]
        # rows have one more position than a piece has bytes: its end, and, read from the left, what precedes its start
        width = size + 1
        token = np.full((rows, width), -1, np.int32)
        token[:, :size][inside] = self.byte[raw[inside]]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (rows, width)).copy()
        after[np.arange(rows), length - 1] = size
        before = np.broadcast_to(np.append(np.int32(size), np.arange(width - 1, dtype=np.int32)), (rows, width)).copy()
        none = NO_RANK * np.int32(size)
        tree = np.full((rows, 2 * size), none, np.int32)
        pairs = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]], NO_RANK)
        tree[:, size : 2 * size - 1] = np.where(pairs < NO_RANK, pairs * np.int32(size) + place[:-1], none)
        for level in range(size.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        token, after, before, tree = token.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[1 :: 2 * size] < none)
        while len(live):
            at, top = live * width, live * (2 * size)
            root = tree[top + 1]
            i = root & (size - 1)
            rank = root >> (size.bit_length() - 1)
            j = after[at + i]
            k = after[at + j]
            h = before[at + i]
            token[at + i] = rank
            token[at + j] = -1
            after[at + i] = k
            before[at + k] = i
            own = self._pair(rank, token[at + k])
            left = self._pair(token[at + h], rank)
            tree[top + size + j] = none
            tree[top + size + i] = np.where((own < NO_RANK) & (k < size), own * size + i, none)
            there = np.flatnonzero(h < size)
            tree[(top + size + h)[there]] = np.where(left < NO_RANK, left * size + h, none)[there]
            path = np.concatenate([j, i, np.where(h < size, h, i)]) + size
            top = np.concatenate([top, top, top])
            for _ in range(size.bit_length() - 1):
                path >>= 1
                child = top + 2 * path
                tree[top + path] = np.minimum(tree[child], tree[child + 1])
            live = live[tree[live * (2 * size) + 1] < none]
        token = token.reshape(rows, width)[:, :size]
        kept = token >= 0
        ids, ends = token[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of each word, as bytes, into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            rank = self.ranks.get(b)
            if rank is not None:
                self.cache[w] = rank.to_bytes(4, "little")
            elif len(b) > SHORT:
                self.cache[w] = np.array(self.merge_long(b), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((w, b))
        for size, own in by_size.items():
            step = LEAVES // (2 * size)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                self.cache.update(zip([w for w, _ in part], self.merge_short([b for _, b in part], size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [pieces(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set().union(*split).difference(self.cache)
        self.learn(new)
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """A worker loads a vocabulary once and reuses it for all its tasks."""
    return Tokenizer(path)


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns in `keep` plus n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary).

    path: the vocabulary file, readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            texts = b.column("__text")
            start, total = 0, 0
            for i in range(len(b)):
                total += len(texts[i].as_py() or "")
                if total >= CHUNK or i + 1 == len(b):
                    part = b.slice(start, i + 1 - start)
                    ids = tok.encode([x or "" for x in part.column("__text").to_pylist()])
                    cols = [part.column(c) for c in keep]
                    cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([tok.decode(x) for x in ids], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids", "decoded"])
                    start, total = i + 1, 0

    rows = docs.select(*keep, F.col(text).alias("__text"))
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{own}, n_tokens long, ids binary, decoded binary")
