"""Tokenising with a public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import os

import numpy as np

try:
    import public_tokenizers
except ImportError:  # the vocabulary's path is a parameter; this is only where it defaults to
    public_tokenizers = None


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a tokenizer's JSON, where there is one."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in listed):
        raise ValueError(f"{path} has added tokens that take more than their own string")
    return {t["content"]: t["id"] for t in listed}


class Encoder:
    """Ids of texts; in ``encode`` strings of special tokens are ordinary text.

    The rank file holds the same vocabulary and merges as ``byte_bpe_50k.json`` and is several times faster.  The JSON
    also lists added tokens, which it finds in a text before all else; ``encode_bytes`` gives their ids too, and so the
    JSON's own.  A rank file without a JSON beside it has no added tokens.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = added_tokens(f"{os.path.splitext(path)[0]}.json")
        self.inner = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.encode = self.inner.encode_ordinary
        self.decode_bytes = self.inner.decode_bytes

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes, added tokens included."""
        ids = self.inner.encode(text, allowed_special="all") if any(a in text for a in self.added) else self.encode(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
