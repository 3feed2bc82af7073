"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are not known yet are joined into one indexed text. Every piece of the vocabulary is
binary-searched for its range of suffixes; the occurrences are the edges of a graph over the text's positions.
Edges are sorted by position and relaxed word by word. For a BPE model the relaxation joins two neighbouring
edges into the edge that spans both, best score first and then leftmost: the cheapest path over all edges, which
a unigram model takes, gives other pieces than the library does for such a model.
No piece has a space mark behind another character, so words (space marks, then other characters) are independent.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CHARS_PER_KEY, _SEPARATOR = 4, "\x00"
#: Rank of no piece; words longer than LONG are relaxed one by one.
NONE, LONG = 1 << 30, 64
#: Characters that are indexed at once; a longer text is indexed in overlapping blocks.
BLOCK = 400_000
#: What remembered words may take, in bytes; words longer than KEPT characters aren't remembered.
CACHE_BYTES, KEPT, _ENTRY = 96_000_000, 1000, 220


class Edges(NamedTuple):
    """Occurrences of pieces, sorted by position and length: those at a position p are first[p] to first[p + 1]."""

    first: object
    size: object
    rank: object
    ids: object

    def find(self, at, size):
        """The ids of the pieces that stand at some positions with some lengths; -1 where none does."""
        import numpy as np

        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * 64 + self.size
        wanted = at * 64 + size
        k = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        return np.where(key[k] == wanted, self.ids[k], -1) if len(key) else np.full(len(at), -1)


class SuffixIndex:
    """The text's suffixes sorted by as many first characters as the longest piece has, kept as packed keys."""

    def __init__(self, text: str, letters: dict[int, int], longest: int):
        import numpy as np

        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = max(1, len(letters).bit_length())
        table = np.zeros(0x110000, np.int64)
        table[np.fromiter(letters.keys(), np.int64, len(letters))] = np.fromiter(letters.values(), np.int64, len(letters))
        dense = np.concatenate([table[code], np.zeros(longest + _CHARS_PER_KEY, np.int64)])
        self.keys, n = [], len(code)
        for k in range(0, longest, _CHARS_PER_KEY):
            key = np.zeros(n, np.int64)
            for j in range(_CHARS_PER_KEY):
                key = (key << self.bits) | dense[k + j : k + j + n]
            self.keys.append(key)
        # The last key decides least: suffixes are ranked block by block, as in prefix doubling.
        self.order = np.lexsort(self.keys[::-1])
        self.keys = [key[self.order] for key in self.keys]

    def ranges(self, bounds):
        """For every piece, given by the least and greatest key of each of its blocks, the range of its suffixes."""
        import numpy as np

        low = np.searchsorted(self.keys[0], bounds[0][0], "left")
        high = np.searchsorted(self.keys[0], bounds[0][1], "right")
        for key, (least, greatest) in zip(self.keys[1:], bounds[1:], strict=True):
            live = np.flatnonzero(high > low)
            low[live], high[live] = _search(key, least[live], low[live], high[live], False), _search(key, greatest[live], low[live], high[live], True)
        return low, np.maximum(low, high)


def _search(key, wanted, low, high, after: bool):
    """np.searchsorted within a range of its own for each wanted value."""
    import numpy as np

    low, high = low.copy(), high.copy()
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        right = key[mid] <= wanted[live] if after else key[mid] < wanted[live]
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


class SuffixArrayPieces:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)  # read for its vocabulary alone
        n = model.get_piece_size()
        self.byte_id, kept, self.raw = {}, [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                kept.append((piece, -model.get_score(i), i))
        if any(MARK in p.lstrip(MARK) for p, _, _ in kept):
            raise ValueError("words of this model aren't independent")
        self.rank = {c: r for r, c in enumerate(sorted({c for _, c, _ in kept}))}  # equal scores share a rank
        letters = {c: k + 1 for k, c in enumerate(sorted({ord(c) for p, _, _ in kept for c in p}))}
        self.letters, self.longest = letters, max(len(p) for p, _, _ in kept)
        bits, top = max(1, len(letters).bit_length()), (1 << max(1, len(letters).bit_length())) - 1
        self.bounds = []
        for k in range(0, self.longest, _CHARS_PER_KEY):
            least, greatest = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
            for x, (p, _, _) in enumerate(kept):
                for j in range(_CHARS_PER_KEY):
                    c = letters[ord(p[k + j])] if k + j < len(p) else None
                    least[x] = (least[x] << bits) | (c or 0)
                    greatest[x] = (greatest[x] << bits) | (top if c is None else c)
            self.bounds.append((least, greatest))
        self.piece_len = np.array([len(p) for p, _, _ in kept], np.int64)
        self.piece_rank = np.array([self.rank[c] for _, c, _ in kept], np.int64)
        self.piece_id = np.array([i for _, _, i in kept], np.int64)
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    # Encoding

    def edges(self, text: str, block: int = BLOCK) -> Edges:
        """All pieces that stand in a text. Blocks overlap by the longest piece, so none is lost at an edge."""
        import numpy as np

        parts = []
        for lo in range(0, max(1, len(text)), block):
            at, size, piece = self._occurrences(text[lo : lo + block + self.longest])
            own = at < block
            parts.append(((at[own] + lo).astype(np.int64), size[own].astype(np.uint8), piece[own].astype(np.int32)))
        at, size, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(at * 64 + size)
        first = np.r_[0, np.cumsum(np.bincount(at, minlength=len(text)))].astype(np.int64)
        return Edges(first, size[by], self.piece_rank[piece[by]].astype(np.int32), self.piece_id[piece[by]].astype(np.int32))

    def _occurrences(self, text: str):
        import numpy as np

        found = SuffixIndex(text, self.letters, self.longest)
        low, high = found.ranges(self.bounds)
        n = high - low
        piece = np.repeat(np.arange(len(n)), n)
        at = found.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        size = self.piece_len[piece]
        inside = at + size <= len(text)
        return at[inside], size[inside], piece[inside]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of words, packed as unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        lo = 0
        while lo < len(units):
            hi, chars = lo, 0
            while hi < len(units) and (hi == lo or chars + len(units[hi]) < BLOCK):
                chars += len(units[hi]) + 1
                hi += 1
            self._learn(units[lo:hi], out)
            lo = hi
        return out

    def _learn(self, units: list[str], out: dict[str, bytes]) -> None:
        import numpy as np

        text = _SEPARATOR.join(units)
        edges = self.edges(text)
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        starts, owner = [], []
        if (size <= LONG).any():
            rank = np.full((len(text) + 1, self.longest + 1), NONE, np.int32)
            rank[np.repeat(np.arange(len(text)), np.diff(edges.first)), edges.size] = edges.rank
            cut, whose = relaxed_together(rank, np.where(size <= LONG, size, 0), begin, self.longest)
            starts, owner = [cut], [whose]
            del rank
        long = np.flatnonzero(size > LONG).tolist()
        sizes, ranks = (edges.size.tobytes(), array("i", edges.rank.tobytes())) if long else (b"", array("i"))
        for k in long:
            s, n = int(begin[k]), int(size[k])
            cut = np.frombuffer(relaxed(n, array("q", edges.first[s : s + n + 1].tobytes()), sizes, ranks), np.int64) + s
            starts.append(cut)
            owner.append(np.full(len(cut), k))
        starts, owner = np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*owner, np.empty(0, np.int64)])
        by = np.argsort(starts)
        starts, owner = starts[by], owner[by]
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
        ends = np.where(last, begin[owner] + size[owner], np.r_[starts[1:], 0])
        found = edges.find(starts, np.minimum(ends - starts, 63))
        n_ids = np.ones(len(starts), np.int64)
        bare = np.flatnonzero(found < 0).tolist()  # characters that no piece has: their bytes
        raw = {i: list(map(self.byte_id.__getitem__, text[starts[i] : ends[i]].encode("utf-8", "surrogatepass"))) for i in bare}
        n_ids[bare] = [len(raw[i]) for i in bare]
        at = np.cumsum(n_ids) - n_ids
        flat = np.repeat(found, n_ids)
        for i in bare:
            flat[at[i] : at[i] + len(raw[i])] = raw[i]
        data = flat.astype("<u4").tobytes()
        edge = (4 * np.r_[0, np.cumsum(np.bincount(owner, n_ids, len(units)).astype(np.int64))]).tolist()
        out.update((u, data[a:z]) for u, a, z in zip(units, edge[:-1], edge[1:], strict=True))

    def encode(self, texts: list[str]):
        """The ids of each text, as arrays of unsigned 32-bit integers."""
        import numpy as np

        out: list = []
        for g in common.sliced(texts, 1_000_000):
            cut = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[g]]
            if self.held > self.cache_bytes:
                self.cache.clear()
                self.held = 0
            found = self.learn(list(set().union(*cut).difference(self.cache)))
            rare = {u: found.pop(u) for u in [u for u in found if len(u) > KEPT]}
            self.held += sum(len(u) + len(d) + _ENTRY for u, d in found.items())
            self.cache.update(found)
            get = self.cache.__getitem__ if not rare else lambda u, rare=rare: rare.get(u) or self.cache[u]
            out.extend(np.frombuffer(b"".join(map(get, c)), "<u4") for c in cut)
        return out

    # Decoding

    def decode(self, ids) -> str:
        """The text of a row of ids. Bytes that are no UTF-8 become U+FFFD; the mark put before the first word goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def relaxed_together(rank, size, begin, longest: int):
    """Where the pieces of many words begin, and whose they are. Each round joins one pair in every word that still has one."""
    import numpy as np

    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    end = at + 1
    done_at, done_owner = [], []
    while len(at):
        pair = np.full(len(at), NONE, np.int64)
        if len(at) > 1:
            length = end[1:] - at[:-1]
            ok = (owner[1:] == owner[:-1]) & (length <= longest)
            pair[:-1] = np.where(ok, rank[at[:-1], np.where(ok, length, 0)], NONE)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat((pair << 32) | np.arange(len(at)), first)
        live = (best >> 32) < NONE
        n = np.diff(np.r_[first, len(at)])
        stays = np.repeat(live, n)
        done_at.append(at[~stays])
        done_owner.append(owner[~stays])
        left = best[live] & 0xFFFFFFFF
        end[left] = end[left + 1]
        stays[left + 1] = False
        at, end, owner = at[stays], end[stays], owner[stays]
    return np.concatenate([*done_at, np.empty(0, np.int64)]), np.concatenate([*done_owner, np.empty(0, np.int64)])


def relaxed(n: int, first: array, sizes: bytes, ranks: array) -> array:
    """Where the pieces of one long word of n characters begin, by a heap of pairs.

    first, sizes and ranks are those of its edges. An entry is (rank, start) in one number; it holds if the pair there still has that rank.
    """
    end, before, now = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", [-1]) * n  # of the piece that begins there
    heap: list[int] = []

    def offer(a: int) -> None:
        m = end[a]
        if m < n and (k := sizes.find(min(end[m] - a, 255), first[a], first[a + 1])) >= 0:
            now[a] = ranks[k]
            heapq.heappush(heap, (ranks[k] << 40) | a)
        else:
            now[a] = -1

    for a in range(n - 1):
        if (k := sizes.find(2, first[a], first[a + 1])) >= 0:
            now[a] = ranks[k]
            heap.append((ranks[k] << 40) | a)
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        a = top & ((1 << 40) - 1)
        if now[a] != top >> 40:
            continue
        m = end[a]
        end[a], end[m], now[m] = end[m], -1, -1
        if end[a] < n:
            before[end[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = array("q"), 0
    while a < n:
        out.append(a)
        a = end[a]
    return out


@lru_cache(maxsize=1)
def pieces(path: str) -> SuffixArrayPieces:
    return SuffixArrayPieces(path)


def _lists(rows):
    """Arrays of unsigned integers as one Arrow array of lists."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in rows])], pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, "<u4")]).view(np.int32)))


def encode_and_decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), same (decoding gives the text back),
    decoded_sha256 of each row's whole text.

    Null counts as empty: no pieces. Repeated rows stay, other columns are ignored, nothing is shuffled. The library's own mark for a
    space, U+2581, comes back as a space; no other character is lost.
    """

    def make():
        import hashlib

        def run(texts):
            ids = pieces(path).encode(texts)
            back = [pieces(path).decode(x.tolist()) for x in ids]
            return [len(x) for x in ids], [zlib.crc32(x) for x in ids], [x == t for x, t in zip(back, texts, strict=True)], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]

        return run

    return common.per_text(common.texts(df), {"n_pieces": "long", "ids_crc32": "long", "same": "boolean", "decoded_sha256": "string"}, make, 1_000_000)


def with_pieces(df: DataFrame, path: str) -> DataFrame:
    """df with columns piece_ids (array<int>) and decoded (the text they give back). Null and empty texts have no pieces and give an empty text.

    Both come from one pass over the texts, some at a time; other columns never leave the JVM.
    """

    common.modest_batches(df.sparkSession)
    @F.arrow_udf("struct<piece_ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = b.to_pylist()
            for g in common.sliced(texts, 1_000_000):
                ids = pieces(path).encode(texts[g])
                yield pa.StructArray.from_arrays([_lists(ids), pa.array([pieces(path).decode(x.tolist()) for x in ids], pa.string())], ["piece_ids", "decoded"])

    out = df.drop("piece_ids", "decoded").withColumn("_both", both(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.select(*[c for c in df.columns if c not in ("piece_ids", "decoded")], "_both.*")
