"""Byte-level BPE vocabulary files of the tokenizers library, and splitting of texts into pieces that can be cached.

The pre-tokenizer never joins characters across a plain space: a text cut before each space gives the same
pieces as the whole text, unless a space stands between white space (or white space and the end). Only such
texts, and texts that hold a special token, are treated whole.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from functools import partial

#: The published pattern of the byte-level pre-tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What remembered chunks may take in a worker, in bytes, with what an entry costs besides (as measured); longer chunks than KEPT characters aren't remembered.
CACHE_BYTES, KEPT, _ENTRY = 350_000_000, 1000, 330
_BETWEEN_SPACES = re.compile(r" (?<=\s )(?:\s|\Z)")


def chunks(text: str) -> list[str] | None:
    """The text cut before each space, or None if it must be treated whole."""
    if _BETWEEN_SPACES.search(text):
        return None
    head, *rest = text.split(" ")
    return [head, *map(" ".__add__, rest)] if head else list(map(" ".__add__, rest))


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabulary files."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class MergeCounter:
    """Counts a text's tokens by merging: heap of adjacent pairs by rank, symbols in a linked list; no ids come out."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = [vocab[c] for c in byte_letters()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.pieces = regex.compile(PIECES)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.cache: dict[str, int] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    def piece(self, word: str) -> int:
        """Initial symbols minus merges of one piece, in O(n log n)."""
        symbols = [self.start[b] for b in word.encode("utf-8", "surrogatepass")]
        n, get = len(symbols), self.merges.get
        many = list if n < 4096 else partial(array, "q")  # plain numbers for long pieces
        symbols, after, before = many(symbols), many(range(1, n + 1)), many(range(-1, n - 1))
        heap = [m[0] * n + i for i in range(n - 1) if (m := get((symbols[i], symbols[i + 1])))]  # rank and place in one number
        heapq.heapify(heap)
        merged = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or symbols[i] < 0 or (m := get((symbols[i], symbols[j]))) is None or m[0] != rank:
                continue  # one of the two was merged meanwhile
            new = symbols[i] = m[1]
            symbols[j] = -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get((new, symbols[k])):
                    heapq.heappush(heap, m[0] * n + i)
            if (h := before[i]) >= 0 and (m := get((symbols[h], new))):
                heapq.heappush(heap, m[0] * n + h)
        return n - merged

    def plain(self, text: str) -> int:
        return sum(map(self.piece, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(map(self.without_special, parts))
        return self.without_special(text)

    def without_special(self, text: str) -> int:
        cut = chunks(text)
        if cut is None:
            return self.plain(text)
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        try:
            return sum(map(self.cache.__getitem__, cut))
        except KeyError:
            rare = 0  # tokens of chunks that aren't remembered
            for c in [c for c in cut if len(c) > KEPT]:
                rare += self.plain(c)
            cut = [c for c in cut if len(c) <= KEPT]
            for c in set(cut).difference(self.cache):
                self.cache[c] = self.plain(c)
                self.held += len(c) + _ENTRY
            return rare + sum(map(self.cache.__getitem__, cut))


class CachedEncoder:
    """Ids by the tokenizers library, as packed bytes; the library encodes each distinct word with the space before it once and then a cache answers."""

    def __init__(self, path: str, dtype: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: the library's own threads would wait for each other on it
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(special_tokens(path))
        self.kind = {2: "H", 4: "I"}[int(dtype[-1])]  # little-endian, as the machines are
        self.cache_bytes, self.held = cache_bytes, 0
        self.cache: dict[str, bytes] = {}

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """The packed ids of each text. New chunks of some million characters at a time go to the library together."""
        out, some, size = [], [], 0
        for t in batch:
            some.append(t)
            size += len(t)
            if size > 2_000_000:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, batch: list[str]) -> list[bytes]:
        heads, cut = [], []  # what stands before a text's first space; the words behind each space, or None for a text that must be treated whole
        for t in batch:
            words = None if _BETWEEN_SPACES.search(t) or any(s in t for s in self.specials) else t.split(" ")
            heads.append(t if words is None else words.pop(0))
            cut.append(words)
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        new = list(set().union(*filter(None, cut)).difference(self.cache))
        rare: dict[str, bytes] = {}
        if new:
            encoded = self.tokenizer.encode_batch_fast(list(map(" ".__add__, new)), add_special_tokens=False)
            for w, e in zip(new, encoded, strict=True):
                packed = array(self.kind, e.ids).tobytes()
                if len(w) > KEPT:
                    rare[w] = packed
                else:
                    self.cache[w] = packed
                    self.held += len(w) + len(packed) + _ENTRY
        get = self.cache.__getitem__ if not rare else lambda w: rare[w] if w in rare else self.cache[w]
        firsts = [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
        return [first if words is None else first + b"".join(map(get, words)) for first, words in zip(firsts, cut, strict=True)]
