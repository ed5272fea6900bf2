"""Encode whole texts through a per-worker table of the chunks between single spaces.

Neither tokenizer joins anything across a space that has other characters on both sides:
pre-tokens of the byte-level pattern begin at that space, and no piece of the other vocabulary
holds its space mark after another character (checked when the model is opened).  The tokens of
a text are therefore those of its chunks, one after the other.  The library encodes each chunk
once; the table finds it again by a 64-bit hash.  Runs of spaces stay inside one chunk.
"""

from __future__ import annotations

import ctypes
import gc
import re

import numpy as np

from habitatrix.llm.hashing import Spans

#: Chunks that one worker remembers; the table starts anew beyond it.
TABLE_CHUNKS = 2_500_000

_open: dict = {}


def cut_points(data, bounds):
    """Start of every chunk: where a text begins, and at each space between two other bytes."""
    space = data == 0x20
    alone = space.copy()
    alone[1:] &= ~space[:-1]
    alone[:-1] &= ~space[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    held = first < bounds[1:]
    alone[first[held]] = True
    ends = last[held & (last > first)]
    alone[ends[space[ends]]] = False
    return np.flatnonzero(alone)


class ChunkTable:
    """Open-addressed table from chunk hashes to values that ``encode`` makes for new chunks."""

    def __init__(self, encode, limit: int = TABLE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.slots = 1 << (2 * limit - 1).bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype="uint64")
        self.values = np.zeros(self.slots, dtype="int64")
        self.n = 0

    def _find(self, h):
        """Slot of each hash: its own, or the free one where its search ends."""
        at = (h & np.uint64(self.slots - 1)).astype("int64")
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            got = self.keys[at[open_]]
            open_ = open_[(got != h[open_]) & (got != 0)]
        return at

    def _insert(self, h, values) -> None:
        todo = np.arange(len(h))
        while len(todo):
            at = self._find(h[todo])
            _, first = np.unique(at, return_index=True)  # one new key for each free slot
            self.keys[at[first]], self.values[at[first]] = h[todo[first]], values[todo[first]]
            todo = np.delete(todo, first)
        self.n += len(h)

    def look_up(self, data, bounds):
        """Value of each chunk of the texts, and the start of each chunk."""
        starts = cut_points(data, bounds)
        ends = np.append(starts[1:], len(data))
        h = Spans(data).hash(starts, ends) | np.uint64(1 << 63)  # 0 marks a free slot
        at = self._find(h)
        missing = np.flatnonzero(self.keys[at] != h)
        if len(missing):
            if self.n + len(missing) > self.limit:
                self.clear()
                missing = np.arange(len(h))
            new, first = np.unique(h[missing], return_index=True)
            spots = missing[first]
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            self._insert(new, self.encode(texts))
            at = self._find(h)
        return self.values[at], starts


class PieceCounter:
    """Token counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        same = self.model.normalize("x  y\n z") == "▁x▁▁y\n▁z"
        self.by_chunk = same and not any(re.search("[^▁]▁", p) for p in pieces)
        self.table = ChunkTable(self._count)

    def _count(self, chunks: list[str]):
        # The model puts a space mark before what it is given, in place of the chunk's own space.
        # A chunk that opens a text, or with a run of spaces, is taken as it stands.
        bare = [c[1:] if c[:1] == " " and c[1:2] != " " else c for c in chunks]
        got = self.model.encode(bare, num_threads=1)
        return np.fromiter(map(len, got), dtype="int64", count=len(got))

    def counts(self, texts: list[str], data, bounds):
        if not self.by_chunk:
            return np.array([len(x) for x in self.model.encode(texts, num_threads=1)], dtype="int64")
        n, starts = self.table.look_up(data, bounds)
        sums = np.concatenate([[0], np.cumsum(n)])
        at = np.searchsorted(starts, bounds)
        out = sums[at[1:]] - sums[at[:-1]]
        # The library takes a leading space for more than a chunk's own, and the mark for a space.
        for i in np.flatnonzero(bounds[:-1] < bounds[1:]):
            if data[bounds[i]] == 0x20 or "▁" in texts[i]:
                out[i] = len(self.model.encode(texts[i], num_threads=1))
        return out


class ByteEncoder:
    """Token ids, as little-endian 32-bit integers, of a byte-level tokenizer file.

    A text that contains an added token's string goes whole to the library; for others its
    vocabulary and merges are read from the same file.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.added
        }
        self.ranked = tiktoken.Encoding(
            "by-file", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={}
        )
        self.pool, self.used = np.zeros(1 << 20, dtype="uint32"), 0
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: list[str]):
        """Ids go to the pool; a value is where they begin, and how many there are."""
        if self.table.n == 0:
            self.used = 0
        ids = [self.ranked.encode_ordinary(c) for c in chunks]
        n = np.fromiter(map(len, ids), dtype="int64", count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype="uint32", count=int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(flat), dtype="uint32")])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(n) - n
        self.used += len(flat)
        return starts << 32 | n

    def encode(self, texts: list[str], data, bounds) -> list[bytes]:
        values, starts = self.table.look_up(data, bounds)
        n, begin = values & 0xFFFFFFFF, values >> 32
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.pool[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        at = total[np.searchsorted(starts, bounds)].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                got = self.library.encode(text, add_special_tokens=False).ids
                out[i] = np.array(got, dtype="<u4").tobytes()
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def forget() -> None:
    """Free what ``opened`` keeps: a worker process outlives its stage, and the next one may not need the tables."""
    if not _open:
        return
    _open.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def opened(kind: type, path: str):
    """One instance for each worker process."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]
