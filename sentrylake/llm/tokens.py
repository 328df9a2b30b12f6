"""Token ids of documents, by the vocabulary file at a path that is a parameter."""

from __future__ import annotations

import base64
import os

import numpy as np

END = 0
_LITERAL = "<|endoftext|>"
_kept: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the `tokenizers` library gives for the file (add_special_tokens=False).

    If the same vocabulary lies beside it as ranks (same name, .tiktoken), these give the same ids
    several times faster; texts with the literal of the special token still go through the file itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids and the id that ends a document; null is empty."""
        text = text or ""
        if self.fast is None or _LITERAL in text:
            out = self.slow.encode(text, add_special_tokens=False).ids
        else:
            out = self.fast.encode_ordinary(text)
        return np.array([*out, END], np.uint32)


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
