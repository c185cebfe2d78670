"""The cache of tokenized pieces that a worker keeps."""

from __future__ import annotations

import public_tokenizers

from enquira.llm import token_blocks


def test_cached_pieces_are_bounded():
    """The cache of a worker stays small over a corpus of ever new words, and the ids are the library's."""
    model = token_blocks.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(400):
        text = " ".join(f"w{k}x{i}" for i in range(1001))
        assert model.encode(text) == model.raw(text) or k % 100
        assert len(model.pieces) + len(model.older) <= 302_000
