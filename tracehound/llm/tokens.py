"""Token ids of the byte-level vocabulary, shared by packing and shard output.

The installed merge-rank form of the vocabulary yields the same ids as its
JSON form several times faster.  The two libraries may take code points of
newer Unicode versions for different classes, so a text with a character
outside ``COMMON`` goes to the JSON form itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np
import regex

EOT = "<|endoftext|>"
#: Latin, Greek, Cyrillic and general punctuation up to U+206F except format
#: characters: classes that have not changed for decades.
COMMON = regex.compile(r"[\x00-ͷ΄-ԯ‐-‧‰-⁞]*")


class ByteTokens:
    """``ids(text)`` as an unsigned 32-bit array, special strings by default
    handling (each one is its single id)."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.eot = next(t["id"] for t in json.load(f)["added_tokens"] if t["content"] == EOT)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and not COMMON.fullmatch(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if EOT not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        out: list[int] = []
        for i, part in enumerate(text.split(EOT)):
            out += [self.eot] * (i > 0) + self.fast.encode_ordinary(part)
        return np.array(out, np.uint32)


_MADE: dict[tuple[str, str], ByteTokens] = {}


def byte_tokens(json_path: str, ranks_path: str) -> ByteTokens:
    """One per worker process."""
    key = (json_path, ranks_path)
    if key not in _MADE:
        _MADE[key] = ByteTokens(*key)
    return _MADE[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
