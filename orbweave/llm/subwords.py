"""Byte-level BPE ids of whole texts, from a public tokenizer file whose path is a parameter."""

from __future__ import annotations

import functools
import json

import numpy as np

#: The pre-tokenization pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte: itself where it prints, else the next free code point from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes as the tokenizers library does with the file at `path` (no special tokens added), and decodes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.core = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.piece = [b""] * self.size
        for w, i in ranks.items():
            self.piece[i] = w
        for w, i in self.special.items():
            self.piece[i] = w.encode()
        self.width = np.array([len(x) for x in self.piece], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of a whole text; special tokens in it are recognized, as by the library."""
        return self.core.encode_to_numpy(text, allowed_special="all")

    def plain(self, text: str) -> np.ndarray:
        """Ids (uint32) of a text in which special tokens count as ordinary text."""
        return self.core.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: np.ndarray) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of this worker process."""
    return ByteBpe(path)
