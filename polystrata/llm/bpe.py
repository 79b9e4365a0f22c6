"""Byte-level BPE encoding and decoding over length-bucketed padded NumPy matrices.

Pre-tokens of like length share a matrix of token ids.  In each round every row
merges its leftmost pair of minimum rank; the pair's rank comes from an
open-addressing hash table held in NumPy arrays, and the row is compacted one
place to the left.  Rows without a mergeable pair leave the matrix.

Defined results: NULL and empty texts have no tokens; repeated rows are encoded
alike; an empty table gives an empty table; other columns pass through, whatever
their names (the new columns' names must be free).
"""

from __future__ import annotations

import base64
import copy
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_NONE = np.int64(1 << 40)
#: Rows of more bytes than this have a matrix row per merge too costly; they go through a heap, with the same result.
LONG_ROW = 512
_CELLS = 1 << 18
_MEMO = 100_000
#: Bytes of text encoded at once.
_ENCODE = 2 << 20


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id, searched for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(len(left) * 4).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64), 0
        keys, pending = (left.astype(np.int64) << 20) | right, np.arange(len(left))
        while len(pending):
            slot = self._slot(keys[pending], self.probes)
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.values[slot[first]] = keys[pending[first]], merged[pending[first]]
            pending = np.delete(pending, first)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((((keys * np.int64(0x9E3779B1)) ^ (keys >> np.int64(13))) >> np.int64(7)) + probe) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or a number above every id."""
        keys = (left.astype(np.int64) << 20) | right
        out = np.full(keys.shape, _NONE, np.int64)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, res = keys.ravel(), out.ravel()
        for probe in range(self.probes):
            slot = self._slot(flat[todo], probe)
            held = self.keys[slot]
            hit = held == flat[todo]
            res[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
        return res.reshape(keys.shape)


class Codec:
    """Byte-level BPE by ranks (``{token bytes: rank}``, rank = id) after splitting by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        spelled = bytearray(int(lengths.sum()))
        for token, rank in ranks.items():
            spelled[self.starts[rank] : self.starts[rank] + len(token)] = token
        self.spelled = np.frombuffer(bytes(spelled), np.uint8)
        self.forget()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        """Read a file of lines ``base64-token rank``."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- one pre-token at a time -------------------------------------------------

    def _long(self, piece: bytes) -> np.ndarray:
        """Leftmost-minimum merging with a heap and a linked list: for rows too long for a matrix."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n, alive = len(ids), [True] * len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.find(np.array([a]), np.array([b]))[0])
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(ids[x], ids[y])) < _NONE:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x, live in zip(ids, alive, strict=True) if live], np.int64)

    # -- many pre-tokens ---------------------------------------------------------

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[raw]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)  # the first minimum: leftmost
            best = ranks[np.arange(len(rows)), at]
            done = best >= _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : sizes[k]].copy()
                keep = ~done
                ids, ranks, rows, sizes, at, best = ids[keep], ranks[keep], rows[keep], sizes[keep], at[keep], best[keep]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, at] = best
            width = ids.shape[1]
            cols = np.arange(width)
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), width - 1), 1)
            sizes = sizes - 1
            ids[k, sizes] = -1  # the place that compaction freed
            cols = cols[: width - 1]
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), width - 2), 1)
            ranks[k, sizes - 1 + (sizes == 0)] = _NONE
            right = np.minimum(at + 1, width - 1)
            follow = np.where(at + 1 < sizes, ids[k, right], -1)
            inside = at < width - 1
            ranks[k[inside], at[inside]] = self.pairs.find(best, follow)[inside]
            has = at > 0
            ranks[k[has], at[has] - 1] = self.pairs.find(ids[k[has], at[has] - 1], best[has])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int64)
            elif len(piece) > LONG_ROW:
                out[k] = self._long(piece)
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length() * 64 + (len(piece) if len(piece) <= 32 else 0), []).append(k)
            else:
                out[k] = np.zeros(0, np.int64)
        for members in buckets.values():
            step = max(1, _CELLS // max(len(pieces[k]) for k in members))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text). Each distinct pre-token of a slice is merged once."""
        if len(self._memo) > _MEMO:
            self.forget()
        memo, seen, counts, fresh = self._memo, [], [], []
        for text in texts:
            found = self.pattern.findall(text)
            counts.append(len(found))
            for p in found:
                k = memo.get(p)
                if k is None:
                    k = memo[p] = len(memo)
                    fresh.append(p.encode())
                seen.append(k)
        if fresh:
            new = self.encode_pieces(fresh)
            self._flat = np.concatenate([self._flat, *new])
            self._sizes = np.concatenate([self._sizes, np.fromiter(map(len, new), np.int64, len(new))])
        if not seen:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        flat, sizes = self._flat, self._sizes
        starts, seen = np.cumsum(sizes) - sizes, np.array(seen)
        n = sizes[seen]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[seen] - (ends - n), n)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def forget(self) -> None:
        """Drop the pre-tokens met so far; a worker keeps the codec for later tasks, but not these."""
        self._memo: dict[str, int] = {}
        self._flat, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) that the ids spell."""
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], n)
        return self.spelled[index], ends[offsets]


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec.from_file(path, pattern)
    return _CODECS[path, pattern]


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def encode(df: DataFrame, text_col: str, out_col: str, vocab_path: str, pattern: str) -> DataFrame:
    """Add ``out_col`` (array<int>): the ids of every whole text. ``vocab_path`` must be readable on the executors."""

    def work():
        codec = copy.copy(_codec(vocab_path, pattern))
        codec.forget()  # the pre-tokens met live as long as the task

        def ids_of(texts: pa.Array) -> pa.Array:
            ids, offsets = codec.encode_texts([t.decode("utf-8", "replace") for t in texts.to_pylist()])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

        return ids_of

    ids = common.arrow_column(work, T.ArrayType(T.IntegerType(), False), _ENCODE)
    return df.select("*", ids(common.utf8(text_col)).alias(out_col))


def decode(df: DataFrame, ids_col: str, out_col: str, vocab_path: str, pattern: str) -> DataFrame:
    """Add ``out_col`` (binary): the bytes that an array of ids spells; NULL ids spell nothing."""

    def work():
        codec = _codec(vocab_path, pattern)
        return lambda column: common.binary_array(*codec.decode(*_list_parts(column)))

    spelled = common.arrow_column(work, T.BinaryType(), common.SLICE_BYTES // 4)
    return df.select("*", spelled(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))).alias(out_col))
