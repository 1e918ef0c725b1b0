"""Offsets and ids against the tokenizer library's own, and a long conversation."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import AddedToken, Tokenizer

from tidemark.llm import chat


def test_offsets_against_library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    tok.add_tokens([AddedToken(c, normalized=False, special=False) for c in chat.CONTROLS])
    rng = random.Random(5)
    parts = ["word ", "é", "日本", "😀", "\n", "###", "<turn>", "</turn>", "\\", " 12", "<|endoftext|>", "don't", "  ", "\x85", "#", "<"]
    for _ in range(400):
        text, _ = chat.render([(rng.choice(["user", "assistant"]), "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for _ in range(rng.randrange(4))])
        want = tok.encode(text, add_special_tokens=False)
        for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
            ids, offsets = chat.encode(text, P.path(name))
            assert [tuple(x) for x in offsets.tolist()] == want.offsets
            own = [i for i, t in zip(want.ids, want.tokens, strict=True) if t not in chat.CONTROLS]
            controls = len(chat.tokenizer(P.path(name))[1]) - len(chat.CONTROLS)
            assert [i for i in ids.tolist() if i < controls] == own


def test_long_conversation():
    turns = [("user" if i % 2 else "assistant", f"turn {i} ### é <turn> " * 200) for i in range(2000)]
    formatted, spans = chat.render(turns)
    assert len(formatted) > 5_000_000 and chat.read_back(formatted) == turns
    _, offsets = chat.encode(formatted, P.path("byte_bpe_50k.tiktoken"))
    mask = chat.loss_mask(offsets, spans[[r == "assistant" for r, _ in turns]])
    assert chat.masked_text(formatted, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
    assert np.all(offsets[1:, 0] >= offsets[:-1, 0])
