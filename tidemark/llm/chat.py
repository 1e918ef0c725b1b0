r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, one turn after the other as

    ### role:<turn>text</turn>\n

and encoded once, with the character offsets of each token. The control strings `###`, `<turn>` and `</turn>` are
tokens of their own, so a turn's text starts and ends at token boundaries. The spans of the trained turns are sorted
and disjoint, as are the tokens, so each span's tokens are found by binary search; the mask and the offsets give the
trained text back.

Control strings inside a role or text are broken by a backslash after their first character, and backslashes are
doubled, so rendering is reversible and a text can neither open nor close a turn.

Edge cases: null role or text counts as empty; turns are ordered by turn (null first), then role, then text; repeated
rows are repeated turns; rows with a null conv_id form one conversation; an empty table gives no rows; other columns
are ignored. A conversation, of any length, is rendered in one task, which is what formatting it whole means.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("###", "<turn>", "</turn>")
TRAINED = ("assistant",)
#: Fixed value: how the byte-level vocabularies split a text into pieces.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BREAK = re.compile(r"#(?=##)|<(?=/?turn>)")
_TURN = re.compile(r"### (.*?):<turn>(.*?)</turn>\n", re.S)

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\!", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\!])", lambda m: "" if m[1] == "!" else "\\", text)


def render(turns: Sequence[Turn]) -> tuple[str, np.ndarray]:
    """The conversation and, per turn, where its escaped text starts and ends."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role)}:<turn>", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at = spans[-1][1] + len("</turn>\n")
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[Turn]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _token_bytes(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a vocabulary: lines of base64 and rank, or a tokenizer's JSON with printable stand-ins for bytes."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if all(c in byte for c in token)}


@lru_cache(2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary of a file plus the control strings, each one token; and the bytes that each id stands for."""
    ranks = _token_bytes(path)
    first = max(ranks.values()) + 1
    controls = {c: first + i for i, c in enumerate(CONTROLS)}
    lengths = np.zeros(first + len(CONTROLS), np.int32)
    for token, i in [*ranks.items(), *controls.items()]:
        lengths[i] = len(token)
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=controls), lengths


def encode(formatted: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and per token the start and end of its characters (of a part of a character: that character's)."""
    encoding, lengths = tokenizer(path)
    ids = encoding.encode_to_numpy(formatted, allowed_special="all", disallowed_special=()).astype(np.int32)
    own = lengths[ids]
    ends = np.cumsum(own)
    starts = ends - own
    if not formatted.isascii():
        at = np.cumsum((np.frombuffer(formatted.encode(), np.uint8) & 0xC0) != 0x80) - 1  # each byte's character
        starts, ends = at[starts], at[ends - 1] + 1
    return ids, np.stack([starts, ends], 1).astype(np.int32)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for the tokens that lie in a span; spans sorted and disjoint, offsets sorted."""
    mask = np.zeros(len(offsets) + 1, np.int64)
    spans = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")  # first token that ends behind the span's start
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")  # first token that starts at or behind its end
    np.add.at(mask, first, 1)
    np.add.at(mask, last, -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask. Tokens that share a character count it once."""
    out, at = [], 0
    starts, ends = offsets[mask, 0], offsets[mask, 1]
    if not len(starts):
        return ""
    runs = np.flatnonzero(np.append(True, starts[1:] > np.maximum.accumulate(ends)[:-1]))
    for a, b in zip(runs, np.append(runs[1:], len(starts)), strict=True):
        at = int(starts[a])
        out.append(unescape(formatted[at : int(ends[a:b].max())]))
    return "".join(out)


COLUMNS = pa.schema([("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def format_chats(
    conversations: DataFrame, path: str, trained: Sequence[str] = TRAINED, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None,
) -> DataFrame:
    """conv_id, formatted, ids, starts, ends (per token), loss (per token); one row per conversation.

    path: a vocabulary file that every executor can read. then: applied to batches of these columns where they are
    made, for uses that keep only something derived from them; `schema` is then the schema of its result.
    """
    trained = set(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 64):  # a few conversations at a time, so their tokens stay small
                b = big.slice(at, 64)
                rows = []
                for turns in b.column("turns").to_pylist():
                    own = [(t["role"] or "", t["text"] or "") for t in turns]
                    formatted, spans = render(own)
                    ids, offsets = encode(formatted, path)
                    mask = loss_mask(offsets, spans[[r in trained for r, _ in own]])
                    rows.append((formatted, ids, offsets[:, 0], offsets[:, 1], mask))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *[len(r[1]) for r in rows]], dtype=np.int32), pa.array(np.concatenate([r[i] for r in rows]))) for i in range(1, 5)]
                out = pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([r[0] for r in rows], pa.string()), *lists], ["conv_id", *COLUMNS.names])
                yield then(out) if then else out

    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    whole = conversations.groupBy("conv_id").agg(turns)
    return whole.mapInArrow(run, schema or f"conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")
