"""Byte-level BPE from a tokenizer file, in a Python worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: The split pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space other than ASCII's.  In texts without it, a place between a character that isn't white space and ASCII
#: white space always parts two pre-tokens, whatever stands around it.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: printable Latin-1 for itself, the others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encodes and decodes as the tokenizers library does with the same file, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec["pre_tokenizer"] or {}, spec["model"].get("vocab", {})
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        base = len(vocab) - len(merges)
        if (
            pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]
            or any(vocab["".join(m)] != base + i for i, m in enumerate(merges))
        ):
            raise ValueError(f"{path} is not a byte-level BPE whose ids follow its merges")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.special_bytes = re.compile(b"|".join(re.escape(t.encode()) for t in self.special) or b"(?!)")
        tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), i) for k, i in self.special.items())]:
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._pool = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def count(self, text: str) -> int:
        return len(self.encoding.encode(text, allowed_special="all"))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self._starts[ids] - (ends - lengths), lengths)
        return self._pool[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """Once per worker process."""
    return ByteBPE(path)
