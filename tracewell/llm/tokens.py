"""Token ids inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np

SPECIAL = "<|endoftext|>"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(tokenizer: str | None = None, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids under the byte-level vocabulary ``tokenizer``, no special tokens added.

    ``ranks`` is the same vocabulary for the faster of two libraries, whose ids are the same for any
    text but one that spells out a special token; such a text goes to the slower one. Built once per
    Python worker; the files lie on every machine.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer or default_path("byte_bpe_50k.json"))
    with open(ranks or default_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
