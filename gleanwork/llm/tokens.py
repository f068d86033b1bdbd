"""Token ids of whole texts.

Ordinary text goes through the vocabulary's rank file, several times faster than through
its full description and with the same ids. A text that spells out a special token goes
through the full description, which gives that token its own id.
"""

from __future__ import annotations

import base64

import numpy as np

SPECIAL = "<|endoftext|>"


def default_path(name: str = "byte_bpe_50k") -> str:
    """Place of a vocabulary's files, without their endings."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Encodes texts by ``path + ".tiktoken"`` and ``path + ".json"``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(f"{path}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path, self._full = path, None

    def of(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.array(self._ranks.encode_ordinary(text), dtype="<u4")
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(f"{self._path}.json")
        return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")
