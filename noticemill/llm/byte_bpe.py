"""Byte-level BPE ids of whole texts, with the vocabulary of a given tokenizer file.

The file's added tokens (``<|endoftext|>``) are cut out of a text first and have their own ids, as in the tokenizers library;
``plain`` reads their strings as ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = model.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._ids = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={}).encode_ordinary
        #: The bytes of each id; None for ids without any.
        self.bytes: list[bytes | None] = [None] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self._special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        longest = "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))
        self._cut = re.compile(f"({longest})").split if special else None

    def plain(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian integers; the strings of added tokens are ordinary text."""
        import numpy as np

        return np.array(self._ids(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as unsigned 32-bit little-endian integers."""
        if any(t in text for t in self._special):
            return b"".join(self._special[part] if i % 2 else self.plain(part) for i, part in enumerate(self._cut(text)))
        return self.plain(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
