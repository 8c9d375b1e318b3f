"""Byte-level BPE ids and token offsets of whole texts, and a bounded cache.

Texts whose characters every Unicode version classes alike are encoded by the
fast rank-based encoder, built from the tokenizer file's own vocabulary; it gives
the library's ids.  Any other text, and any text with an added token's string,
goes to the library itself.  Texts of any length are encoded whole: long runs of
white space, on which the encoder's pattern engine overflows its stack, are cut
out as the pattern would cut them.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache
from typing import Any

import numpy as np

#: Unicode white space, as the tokenizers' patterns see it.
WHITE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the splitting pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that never enter the pattern engine.
LONG_SPACE = re.compile(f"[{WHITE_SPACE}]{{1000,}}")
#: Entries of one generation of a cache (it holds two), and the longest key that enters it.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64


class ChunkCache:
    """chunk -> its encoding in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, make: Callable[[str], Any], size: int = CACHE_ENTRIES):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def look_up(self, chunks: list[str]) -> list:
        got = list(map(self.young.get, chunks))
        if None in got:
            for i, found in enumerate(got):
                if found is None:
                    got[i] = self._miss(chunks[i])
        return got

    def _miss(self, chunk: str):
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = self.make(chunk)
            if len(chunk) <= CACHE_LENGTH:
                if len(self.young) >= self.size:
                    self.old, self.young = self.young, {}
                self.young[chunk] = found
        return found


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def settled() -> np.ndarray:
    """For each code point, whether Unicode 3.2 has it and classes it as today."""
    old, now, table = unicodedata.ucd_3_2_0.category, unicodedata.category, np.zeros(sys.maxunicode + 1, bool)
    for c in range(0x10000):
        was = old(chr(c))
        table[c] = was != "Cn" and was[0] == now(chr(c))[0]
    return table


def is_settled(text: str) -> bool:
    return text.isascii() or bool(settled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].all())


class TextEncoder:
    """Ids (little-endian uint32) and character offsets of texts for one byte-level tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1 + len(self.added), np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for t in spec["added_tokens"]:
            self.lengths[t["id"]] = len(t["content"].encode())
        pre = spec["pre_tokenizer"] or {}
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = plain and spec["normalizer"] is None and joined == sorted(set(joined))
        self.fast = self._ranked(ranks) if plain else None

    @cached_property
    def library(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @staticmethod
    def _ranked(ranks: dict[bytes, int]):
        try:
            import tiktoken
        except ImportError:
            return None
        encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            ids, at = [], 0
            for m in LONG_SPACE.finditer(text):
                end = m.end() - (m.end() < len(text))  # the last one belongs to what follows the run
                ids += encoding.encode_ordinary(text[at : m.start()])
                ids += encoding._encode_single_piece(text[m.start() : end])
                at = end
            return ids + encoding.encode_ordinary(text[at:])

        return encode

    def encode(self, text: str) -> bytes:
        """The ids of a text as consecutive little-endian 32-bit integers."""
        if self.fast and is_settled(text) and not any(t in text for t in self.added):
            ids = array("I", self.fast(text))
        else:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def spans(self, text: str) -> np.ndarray:
        """First character of each token of a text, in order of the tokens.

        A character of several bytes may be split over tokens; each of them
        starts at that character, as the library's offsets say.
        """
        data = text.encode()
        size = self.lengths[np.frombuffer(self.encode(text), "<u4")]
        starts = np.cumsum(size) - size
        if len(data) == len(text):
            return starts
        characters = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        return characters[starts]


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    return TextEncoder(path)
