"""Token ids of the byte-level BPE vocabulary, as fast as a word cache allows.

A space between two non-space characters always starts a new pre-token, so a
text may be cut there and each chunk encoded by itself; chunks repeat, so their
ids are cached (bounded, emptied when full).  Chunks with white space at an end
take a path that cuts only at safe spaces.  Ids equal the library's.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

CACHE_ENTRIES = 1 << 18
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ChunkEncoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, end_of_text: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.dtype = np.dtype("<u2") if len(ranks) < 65535 else np.dtype("<u4")
        self._enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={end_of_text: len(ranks)})
        self._special = {end_of_text}
        self._cache: dict[str, bytes] = {}

    def _raw(self, piece: str) -> bytes:
        return np.asarray(self._enc.encode(piece, allowed_special=self._special), dtype=self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        got = self._cache.get(chunk)
        if got is None:
            if len(self._cache) >= CACHE_ENTRIES:
                self._cache.clear()
            got = self._raw(" " + chunk)
            if 0 < len(chunk) < 64 and not chunk[0].isspace() and not chunk[-1].isspace():
                self._cache[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        out = list(map(self._cache.get, chunks))
        if None in out:
            # '' and white space at a chunk's ends: a space next to white space is no safe cut
            if any(x is None and (not c or c[0].isspace() or c[-1].isspace()) for x, c in zip(out, chunks)):
                chunks = _SAFE_SPACE.split(text)
                return self._raw(chunks[0]) + b"".join(map(self._chunk, chunks[1:]))
            out = [self._chunk(c) if x is None else x for x, c in zip(out, chunks)]
        out[0] = self._raw(chunks[0])
        return b"".join(out)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // self.dtype.itemsize


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    return ChunkEncoder(path)
