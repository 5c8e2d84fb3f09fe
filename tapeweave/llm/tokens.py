"""Byte-level BPE ids of whole texts, with a bounded cache of text chunks per Python worker.

The public pre-token pattern never joins characters across a single white space between two
non-spaces: a single space opens the chunk behind it, a single line break stands alone. So such
texts split into chunks with plain string methods, and every chunk is encoded once while it stays
in the cache. Texts with adjacent white space, or with a zero character, are encoded in one piece.

Added tokens of the vocabulary (such as an end-of-text mark) come first: wherever their string stands in a text it is
their one id, and what lies between them is encoded on its own. That is what ``tokenizers`` does with the same file.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

UNEVEN = re.compile(r"\s\s|\x00")
START = "\x00"  # marks a chunk without a space before it
CACHED = 300_000  # chunks; about 80 MB


def load_encoding(path: str | None = None):
    """Encoder of the public rank file at ``path`` (the 50k byte-level one by default)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def load_added(path: str | None = None) -> dict[str, int]:
    """Added tokens of the public 50k vocabulary, by their string; a rank file of one's own names none."""
    import public_tokenizers

    if path is not None:
        return {}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Chunks(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoding, limit: int = CACHED, added: dict[str, int] | None = None):
        super().__init__()
        self.encode, self.limit = encoding.encode_ordinary, limit
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        self.longest = len(longest_first[0]) if longest_first else 0

    def marked(self, text: str) -> bool:
        """Whether an added token stands in ``text``."""
        return any(t in text for t in self.added)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if chunk[:1] == START:
            text = chunk[1:]
        else:
            text = chunk if chunk == "\n" else " " + chunk
        out = self[chunk] = self.pack(text)
        return out

    def pack(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def split(self, text: str) -> list[str] | None:
        """Chunks of an even text, in order; None for other texts."""
        if UNEVEN.search(text) or text[:1] == "\n" or text[-1:] in (" ", "\n") or self.marked(text):
            return None
        return (START + text.replace("\n", " \n " + START)).split(" ")

    def ids(self, text: str) -> bytes:
        if self.marked(text):
            return b"".join(self.added[p] if p in self.added else self.ids(p) for p in self.marks.split(text))
        chunks = self.split(text)
        return self.pack(text) if chunks is None else b"".join(map(self.__getitem__, chunks))


@lru_cache(maxsize=2)
def chunk_cache(path: str | None = None) -> Chunks:
    """One cache per Python worker and vocabulary."""
    return Chunks(load_encoding(path), added=load_added(path))
