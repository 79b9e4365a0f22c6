"""Language-model scores by logistic context mixing, beside a smoothed unigram base.

Every bit of a text is predicted by several predictors, each a hash table from
(context, bits of the byte so far) to counts of zeros and ones: the last two,
three, four and six bytes, and the word so far.  A context's hash picks a line of 16 slots for
each half of the byte.  A mixer adds their log-odds with weights that
a gate picks (how sure the longer contexts are, and the place of the bit); an adaptive
map from the mixed log-odds to what was seen refines the result.

Training passes over all training texts once.  Each task predicts a slice from
what it has seen before the slice, corrects the weights and the adaptive map
online from its errors, and only then counts the slice.  Counts of all tasks are
summed per table slot; weights are averaged by training bits.  The tables grow
with the fourth root of the training bytes (:func:`table_sizes`): all of them take
31 MB in the model that is broadcast up to 0.1 GB of text, four times that at 30 GB
and about 1 GB at 100 TB.

Within a slice equal (contexts, byte) are predicted once and weighted by their
number.  Texts are lower-cased (A-Z) and end in one zero byte, which is scored.

Defined results: NULL and empty texts consist of the end alone; a NULL id is
hashed as the empty string; repeated rows are scored each; an empty table, or
one without training rows, gives its rows scores from an untrained model.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, postings

#: Least slots (as a power of two) of the predictors: two, three, four and six bytes, and the word so far.
BITS = (20, 21, 22, 22, 22)
_K, _GATES, _BUCKETS = len(BITS), 128, 33
_PAD = 8
#: Most bytes of a slice; a task's slices double from an eighth of a megabyte up to this.
SLICE, _FIRST = 4 << 20, 128 << 10
_CHUNK = 1 << 13
#: Training bytes up to which tables have their least size.
BASE_BYTES = 100_000_000
#: Training bytes of a task: its tables are gathered once for so many, however finely the input is split.
TASK_BYTES = 32 << 20
_MIXER = -1
#: Items of one step of the mixer, and of a part; items whose log-odds are held at once; places of a piece; lines whose log-odds are made at once.
_MINI, _PART, _MOST, _PIECE, _LINES = 1 << 14, 1 << 16, 1 << 21, 1 << 17, 1 << 13
#: Items whose scores a worker remembers from slice to slice, in numbers of 16 bytes; most bytes of a slice that is scored.
_MET, _PAIR, _SCORED = 1 << 22, np.complex128, 1 << 21
_SCALE = 1024.0


def table_sizes(n_bytes: int) -> tuple[int, ...]:
    """Slots of each predictor's table for so many training bytes, in whole chunks; two bytes have few contexts at any size."""
    grown = max(1.0, n_bytes / BASE_BYTES) ** 0.25
    return tuple(int(-(-(1 << bits) * (grown if k else 1) // _CHUNK)) * _CHUNK for k, bits in enumerate(BITS))


_LEAST = table_sizes(0)
#: A random number for each (place in a word modulo 64, byte): a word's hash is the sum over its bytes.
_LETTERS = common.mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: How an item's place in the order takes bits of the four bytes before it: six of the last, five, four and three of the others.
_NEAR = tuple((np.uint64(mask), np.uint64(by)) for mask, by in ((0x3F << 56, 2), (0x1F << 48, 5), (0x0F << 40, 9), (0x07 << 32, 14)))

#: White space, which ends words.
_SPACE = b"\t\n\v\f\r "


def _spaces(buf: np.ndarray) -> np.ndarray:
    """Where white space is."""
    return ((buf - np.uint8(9)) < np.uint8(5)) | (buf == np.uint8(32))


#: What a line's hash takes from the byte's first half.
_HALVES = np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


class Items:
    """The distinct (contexts, byte) of a slice, those of like contexts together, their number, and the item of every place.

    Items from one of ``heads`` up to the next share contexts and the byte's first
    half; ``head_counts`` has their numbers, ``head_of`` the head of each item.

    ``find`` gives the scores of a run of keys, and whether each is known.  Known
    places make no items: their scores are in ``logs``, and ``fresh`` has the others.
    """

    def __init__(self, texts: list[bytes], want_places: bool = False, find=None):
        # Zero bytes before each text keep its contexts apart from the text before it; the one after it is its end.
        gap = bytes(_PAD + 1)
        joined = gap[:_PAD] + gap.join(texts).lower() + gap[:1]
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: The texts' first places; before each but the first are the zero bytes, at the places ``pads``.
        self.text_starts = np.cumsum(sizes) - sizes + np.arange(len(texts)) * _PAD
        self.pads = (self.text_starts[1:, None] - np.arange(_PAD, 0, -1)).ravel()
        n = len(buf)
        b, last = buf[_PAD:], np.ndarray((n - _PAD,), "<u8", joined, 0, (1,))  # the eight bytes before each place
        start, total = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.uint64)
        # Long arrays are filled piece by piece, without whole ones for what is between.
        for low in range(0, n, _PIECE):
            high = min(n, low + _PIECE)
            piece, letter = buf[low:high], np.arange(low, high, dtype=np.int32)
            after = (letter + np.int32(1)) * (_spaces(piece) | (piece == 0))
            np.maximum(after[:1], start[low : low + 1], out=after[:1])
            np.maximum.accumulate(after, out=start[low + 1 : high + 1])
            letter -= start[low:high]
            letter &= 63
            letter <<= 8
            letter |= piece
            own = _LETTERS.take(letter)
            own[:1] += total[low : low + 1]
            np.cumsum(own, out=total[low + 1 : high + 1])
        n -= _PAD
        shift = n.bit_length()
        place_bits, byte_bits, rest = np.uint64(shift), np.uint64(shift + 8), np.uint64(min(shift + 26, 63))
        keys, order, at, done = [], [], [], 0
        if find is not None:
            self.logs = np.zeros(n + _PAD)  # zeros after every text, so that its sum is the same anywhere
        else:
            keys, order = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for low in range(0, n, _PIECE):
            piece = slice(low, min(n, low + _PIECE))
            like = total[_PAD:-1][piece] - total.take(start[_PAD:-1][piece])
            like *= np.uint64(0xD1B54A32D192ED03)
            key = last[piece] >> np.uint64(16)
            key *= np.uint64(0x8CB92BA72F3D8DD7)
            like += key
            like ^= like >> np.uint64(32)
            like *= np.uint64(0xBF58476D1CE4E5B9)
            byte = b[piece].astype(np.uint64)
            np.multiply(byte, np.uint64(0xEB44ACCAB455D165), out=key)
            key += like
            key |= np.uint64(1)  # zero is no key
            # In the order of (parts of) the bytes before, contexts, byte and place: sorting such numbers is several times
            # faster than an argsort, and what is read or counted for an item is in the cache for the next.
            like >>= rest
            like <<= byte_bits
            byte <<= place_bits
            like |= byte
            for mask, by in _NEAR:
                before = last[piece] & mask
                before <<= by
                like |= before
            if find is None:
                keys[piece] = key
                like |= np.arange(piece.start, piece.stop, dtype=np.uint64)
                order[piece] = like
                continue
            known = find(key, self.logs[piece])
            known[self.pads[slice(*np.searchsorted(self.pads, (piece.start, piece.stop)))] - low] = True
            fresh = np.flatnonzero(~known)
            keys.append(key.take(fresh))
            order.append(like.take(fresh) | np.arange(done, done + len(fresh), dtype=np.uint64))
            at.append((fresh + low).astype(np.int32))
            done += len(fresh)
        if find is None:
            order[self.pads] = ~np.uint64(0)
        else:
            keys, order, self.fresh = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (order, np.uint64), (at, np.int32)))
            self.logs[self.pads] = 0
        order.sort()
        if find is None:
            order = order[: n - len(self.pads)]
        order &= np.uint64((1 << shift) - 1)
        order = order.astype(np.int32)
        new = np.ones(len(order), bool)
        for low in range(1, len(order), _PIECE):
            run = keys.take(order[low - 1 : low + _PIECE])
            np.not_equal(run[1:], run[:-1], out=new[low : low + _PIECE])
        first = np.flatnonzero(new)
        self.counts = np.diff(first, append=len(order))
        own = order.take(first)
        if find is not None:
            self.keys = keys.take(own)
        del keys
        if want_places:
            places = np.zeros(n if find is None else len(order), np.int32)
            places[order] = np.cumsum(new, dtype=np.int32) - 1
            self.places = np.delete(places, self.pads) if find is None else places
        del order, new, first
        places = own if find is None else self.fresh.take(own)
        word = total.take(places + np.int32(_PAD))
        word -= total.take(start.take(places + np.int32(_PAD)))
        del total, start
        self.byte, last = b.take(places), last[places]
        head = np.ones(len(places), bool)
        for low in range(1, len(places), _PIECE):
            some = slice(low - 1, low + _PIECE)
            same = np.diff(last[some] >> np.uint64(16)) == 0
            same &= np.diff(word[some]) == 0
            same &= np.diff(self.byte[some] >> 4) == 0
            head[low : low + _PIECE] = ~same
        self.heads = np.flatnonzero(head).astype(np.int32)
        self.head_counts = np.add.reduceat(self.counts, self.heads) if len(places) else self.counts
        self.head_of = np.cumsum(head, dtype=np.int32) - np.int32(1)
        last, word = last.take(self.heads), word.take(self.heads)
        self.hashes = [np.empty(len(word), np.uint64) for _ in range(_K)]
        for low in range(0, len(word), _MINI):
            piece = slice(low, low + _MINI)
            for k, m in enumerate((2, 3, 4, 6, None)):
                h = last[piece] >> np.uint64(64 - 8 * m) if m else word[piece]
                self.hashes[k][piece] = common.mix64((h + np.uint64(1)) * np.uint64(2 * k + 3) ^ np.uint64(k << 56))

    def lines(self, part: slice | np.ndarray, sizes: tuple[int, ...], half: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nibble of the byte's first half and the predictors' lines (their first slots) of some heads, or of the second half of some items."""
        byte, lines = (self.byte[part] if half else self.byte.take(self.heads[part])), []
        if half:
            part, halves = self.head_of[part].astype(np.intp), _HALVES.take(byte >> 4)
        for size, h in zip(sizes, self.hashes, strict=True):
            h = h.take(part) if isinstance(part, np.ndarray) else h[part].copy()
            if half:
                h += halves
                h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h >>= np.uint64(32)
            h *= np.uint64(size >> 4)
            h >>= np.uint64(32)
            h <<= np.uint64(4)
            lines.append(h.view(np.int64))
        return (byte & 15 if half else byte >> 4).astype(np.int64), lines

    def bits(self, part: slice, sizes: tuple[int, ...] = _LEAST):
        """For each of the eight bits: its place, the bits so far with a leading one, the bit, the predictors' slots."""
        byte = self.byte[part].astype(np.int64)
        for half in (0, 1):
            nibble, lines = self.lines(part if half else self.head_of[part].astype(np.intp), sizes, half)
            for j in range(4):
                node = (1 << j) | (nibble >> (4 - j))
                yield half * 4 + j, (byte >> (8 - half * 4 - j)) | (1 << (half * 4 + j)), (nibble >> (3 - j)) & 1, [line + node for line in lines]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    p = np.negative(z)
    np.exp(p, out=p)
    p += 1
    return np.divide(1, p, out=p)


class Mixer:
    """Gated weights and the adaptive map (counts of zeros and ones by cell)."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.full((_K + 1, _GATES), 0.3, np.float32) if weights is None else weights.astype(np.float32)
        if weights is None:
            self.weights[_K] = 0
        self.seen = np.zeros((256 * _BUCKETS, 2)) if seen is None else seen
        # the refined probability is linear in the mixed one: half of it, and half of (ones + 20 p) / (n + 20)
        n = self.seen.sum(1) + 20
        self._slope, self._base = (0.5 + 10 / n).astype(np.float32), (self.seen[:, 1] / n / 2).astype(np.float32)

    def predict(self, odds: list[np.ndarray], j: int, node: np.ndarray, one: float = 1):
        """(mixed probability of a one, gate of this bit, cell of the adaptive map) from log-odds in units of 1 / ``one``."""
        gate = _gates(odds[_K - 1], odds[_K - 2], one)
        own = self.weights[:, j * 16 : j * 16 + 16].T / np.float32([one] * _K + [1])
        own = own.take(gate, axis=0)  # a gate's weights are neighbours
        z = own[:, _K].copy()
        for k in range(_K):
            z += own[:, k] * odds[k]
        np.clip(z, -14, 14, out=z)
        return _sigmoid(z), gate, _cells(z, node).astype(np.intp)

    def refine(self, p: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The mean of the mixed probability and of what the adaptive map saw at its cell (as of when the mixer was made)."""
        out = self._slope.take(cell)
        out *= p
        out += self._base.take(cell)
        return np.clip(out, 1e-6, 1 - 1e-6, out=out)

    def learn(self, odds: np.ndarray, bounds: list[int], j: int, bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mixed log-odds of items that are sorted by gate (from ``bounds``), then one damped diagonal-Newton step per gate; squares ``odds``."""
        own, both = self.weights[:, j * 16 : j * 16 + 16], np.zeros((2, _K + 1, 16), np.float32)
        by_gate, z = np.ascontiguousarray(own.T), np.empty(len(bit), np.float32)
        of_gate = [(g, a, b) for g, (a, b) in enumerate(itertools.pairwise(bounds)) if a < b]
        for g, a, b in of_gate:
            np.dot(by_gate[g], odds[:, a:b], out=z[a:b])
        np.clip(z, -14, 14, out=z)
        p = _sigmoid(z)
        error = bit - p
        error *= count
        for g, a, b in of_gate:
            both[0, :, g] = np.dot(odds[:, a:b], error[a:b])
        np.subtract(1, p, out=error)
        p *= error
        p *= count
        np.multiply(odds, odds, out=odds)
        for g, a, b in of_gate:
            both[1, :, g] = np.dot(odds[:, a:b], p[a:b])
        own += 0.05 * (both[0] / (both[1] + 50))
        return z


def _gates(word: np.ndarray, longest: np.ndarray, one: float = 1) -> np.ndarray:
    """The gate of log-odds in units of 1 / ``one``: how sure the word and the longest context are."""
    gate = np.zeros(len(word), np.int8)
    for odds in (word, longest):
        sure = np.abs(odds)
        gate *= 4
        for least in (0, 2.5 * one, 4.5 * one):
            gate += sure > odds.dtype.type(least)
    return gate


def _cells(z: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cells of the adaptive map, as numbers that a float holds."""
    cell = z * 2
    np.rint(cell, out=cell)
    cell += _BUCKETS // 2
    np.clip(cell, 0, _BUCKETS - 1, out=cell)
    cell += np.multiply(node, np.float32(_BUCKETS), dtype=np.float32)
    return cell


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones.astype(np.float32) + np.float32(0.1)) / (zeros.astype(np.float32) + np.float32(0.1)))


def _stored(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds as tables hold them."""
    return np.rint(np.clip(_odds(zeros, ones) * _SCALE, -30000, 30000)).astype(np.int16)


class _Counts:
    """Counts and log-odds of all predictors' lines.

    A line counts the 16 values of the half byte; zeros and ones of its 15 slots
    are sums of these.  Log-odds are as of the last items that were added.
    """

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes, self.values, self.logs = sizes, [np.zeros(size, np.int32) for size in sizes], [np.zeros(size, np.int16) for size in sizes]

    @staticmethod
    def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones (slot, line) of lines' counts (line, value); slot 0 is not used."""
        sums = np.ascontiguousarray(values.reshape(-1, 16).T)
        zeros, ones = np.zeros_like(sums), np.zeros_like(sums)
        for n in (8, 4, 2, 1):
            zeros[n : 2 * n], ones[n : 2 * n] = sums[::2], sums[1::2]
            sums = sums[::2] + sums[1::2]
        return zeros, ones

    def slots(self, k: int, low: int, high: int) -> np.ndarray:
        """Counts of zeros (high half) and ones (low half) of a predictor's slots, whole lines."""
        zeros, ones = self._slots(self.values[k][low:high])
        return (zeros.astype(np.int64) << 32 | ones).T.ravel()

    @property
    def tables(self) -> list[np.ndarray]:
        return [self.slots(k, 0, size) for k, size in enumerate(self.sizes)]

    def look(self, items: Items, some: slice, parts: int, half: int, room: np.ndarray) -> np.ndarray:
        """Stored log-odds (bit, predictor, part, item) for the four bits of a half byte; every ``parts``-th item belongs to one part.

        ``some`` are places among the heads for the first half, which their items share, or among the items;
        ``room`` holds the result.
        """
        all_places = range(*some.indices(len(items.counts if half else items.heads)))
        n, rows = len(all_places), _MINI // parts + 1
        shape = (4, _K, parts, -(-n // parts))
        out = room[: np.prod(shape)].reshape(shape)
        held = np.empty(rows * parts, np.int16)
        by_part = np.arange(rows * parts).reshape(rows, parts).T.ravel()
        for row in range(0, out.shape[3], rows):
            # items are met nearly in their order, and a line is read for its four bits while it is in the cache
            own = np.minimum(by_part + row * parts, n - 1)
            own *= all_places.step
            own += all_places.start
            nibble, lines = items.lines(own, self.sizes, half)
            for j in range(4):
                node = (1 << j) | (nibble >> (4 - j))
                for k, line in enumerate(lines):
                    self.logs[k].take(line + node, out=held, mode="clip")
                    out[j, k, :, row : row + rows] = held.reshape(parts, rows)[:, : out.shape[3] - row]
        return out

    def add(self, items: Items) -> None:
        met = [np.zeros(size >> 4, bool) for size in self.sizes]
        for half, counts in enumerate((items.head_counts, items.counts)):
            for low in range(0, len(counts), _MINI):
                part = slice(low, low + _MINI)
                count = counts[part].astype(np.int32)
                nibble, lines = items.lines(part, self.sizes, half)
                for k, line in enumerate(lines):
                    met[k][line >> 4] = True
                    line += nibble
                    np.add.at(self.values[k], line, count)
        for k in range(_K):
            values, logs, lines = self.values[k].reshape(-1, 16), self.logs[k].reshape(-1, 16), np.flatnonzero(met[k])
            for low in range(0, len(lines), _LINES):
                own = lines[low : low + _LINES]
                logs[own] = np.ascontiguousarray(_stored(*self._slots(values.take(own, axis=0))).T)


def _fit(items: Items, counts: _Counts, mixer: Mixer) -> None:
    """Predict the items from the counts and correct the mixer; each step and part takes items from all over the slice.

    For the first half of the byte, items that share it and their contexts are
    one with their number; steps are as many as for the items.
    """
    stride = -(-len(items.counts) // _MOST)
    for first in range(stride):
        whole = slice(first, None, stride)
        n_items = len(items.counts[whole])
        parts = -(-n_items // _PART)
        room = np.empty(4 * _K * (n_items + parts), np.int16)
        for half in (0, 1):
            logs = counts.look(items, whole, parts, half, room)
            all_counts, all_bytes = (items.counts[whole], items.byte[whole]) if half else (items.head_counts[whole], items.byte.take(items.heads[whole]))
            for at in range(parts):
                count, byte = all_counts[at::parts].astype(np.float32), all_bytes[at::parts].astype(np.int16)
                n = len(count)
                steps = -(-len(range(at, n_items, parts)) // _MINI)
                step = np.tile(np.arange(steps, dtype=np.int16) * 16, -(-n // steps))[:n]
                for j in range(half * 4, half * 4 + 4):
                    own, prefix = logs[j - half * 4, :, at, :n], (byte | 256) >> 7 - j
                    # A gate doesn't depend on weights, so items of all steps are sorted at once, by step and gate.
                    key = step + _gates(own[_K - 1], own[_K - 2], _SCALE)
                    order = np.argsort(key, kind="stable")
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=16 * steps))])
                    for k in range(steps):
                        ends = bounds[16 * k : 16 * k + 17]
                        some = order[ends[0] : ends[-1]]
                        odds = np.ones((_K + 1, len(some)), np.float32)
                        for i in range(_K):
                            np.multiply(own[i].take(some), np.float32(1 / _SCALE), out=odds[i])
                        so_far, weight = prefix.take(some), count.take(some)
                        bit = (so_far & 1).astype(np.float32)
                        cell = _cells(mixer.learn(odds, (ends - ends[0]).tolist(), j, bit, weight), so_far >> 1)
                        cell -= _BUCKETS << j  # only this bit's nodes
                        cell *= 2
                        cell += bit
                        mixer.seen[_BUCKETS << j : _BUCKETS << j + 1] += np.bincount(cell.astype(np.intp), weight, _BUCKETS << j + 1).reshape(-1, 2)


def _ramp(ends: np.ndarray, size: int):
    """Row ranges as :func:`common.slices` gives them, with the size doubling; yields the next size as well."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = min(n, max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1))
        size = min(SLICE, size * 2)
        yield start, stop, size
        start = stop


def _train(batches, sizes: tuple[int, ...]):
    counts, mixer, size, bits = _Counts(sizes), Mixer(), _FIRST, 0
    for batch in batches:
        _, ends = common.byte_rows(batch.column(0))
        for start, stop, size in _ramp(ends, size):
            items = Items(batch.column(0).slice(start, stop - start).to_pylist())
            _fit(items, counts, mixer)
            counts.add(items)
            bits += int(items.counts.sum()) * 8
            del items  # before the next slice's are made
    if not bits:
        return
    state = np.concatenate([[bits], mixer.weights.astype(np.float64).ravel() * bits, mixer.seen.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([_MIXER], pa.int32()), pa.array([state.tobytes()], pa.binary())], names=["chunk", "data"])
    chunk = 0
    for k, size in enumerate(sizes):
        for low in range(0, size, _CHUNK):
            if counts.values[k][low : low + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.values[k][low : low + _CHUNK].tobytes()], pa.binary())], names=["chunk", "data"])
            chunk += 1


def _sum_chunks(batches, lines: bool = False):
    """Sum the rows of each chunk, one row at a time: rows of a chunk come together.

    A row has the slots' zeros and ones, or the lines' counts of half bytes, from
    which zeros and ones follow.  A task's numbers fit 32 bits each; their sums
    over tasks are 64 bits wide.
    """
    at, held = None, None

    def out():
        if at == _MIXER:
            data = held.tobytes()
        elif lines:
            data = np.ascontiguousarray(_stored(*_Counts._slots(held)).T).tobytes()
        else:
            data = _stored(*held).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "data"])

    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = np.frombuffer(data.as_buffer(), np.float64 if chunk == _MIXER else np.int32 if lines else np.int64)
            if chunk != _MIXER and not lines:
                row = np.stack([row >> 32, row & 0xFFFFFFFF])
            if chunk != at:
                if at is not None:
                    yield out()
                at, held = chunk, row.astype(np.float64 if chunk == _MIXER else np.int64)
            else:
                held += row
    if at is not None:
        yield out()


class Model:
    """Trained tables (log-odds of each slot) and mixer."""

    def __init__(self, rows: list[tuple[int, bytes]], sizes: tuple[int, ...] = _LEAST):
        flat, self.sizes = np.zeros(sum(sizes), np.int16), sizes
        self.mixer = Mixer()
        for chunk, data in rows:
            if chunk == _MIXER:
                state = np.frombuffer(data)
                n = (_K + 1) * _GATES
                self.mixer = Mixer((state[1 : n + 1] / state[0]).reshape(_K + 1, _GATES), state[n + 1 :].reshape(-1, 2).copy())
            else:
                flat[chunk * _CHUNK : chunk * _CHUNK + len(data) // 2] = np.frombuffer(data, np.int16)
        self.tables = np.split(flat, np.cumsum(sizes)[:-1])
        #: (key, score) of items that were scored (key 0: none), at one of two neighbours that the key gives; made by the first call.
        self._met = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text (and its end)."""
        out, ends = [], np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if self._met is None:
            self._met = np.zeros(_MET, _PAIR)
        for start, stop in common.slices(ends, min(SLICE, _SCORED)):
            items = Items(texts[start:stop], True, self._find)
            logs = np.ones(len(items.counts))  # probabilities: eight are at least 1e-48
            for low in range(0, len(logs), _MINI):
                part = slice(low, low + _MINI)
                for j, node, bit, slots in items.bits(part, self.sizes):
                    odds = [table.take(slot) for table, slot in zip(self.tables, slots, strict=True)]
                    p, _, cell = self.mixer.predict(odds, j, node, _SCALE)
                    p = self.mixer.refine(p, cell)
                    logs[part] *= np.abs(bit - 1 + p)
            np.log10(logs, out=logs)
            items.logs[items.fresh] = logs.take(items.places)
            out.append(np.add.reduceat(items.logs, items.text_starts))
            self._keep(items.keys, logs)
            del items
        return np.concatenate(out) if out else np.zeros(0)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The first of the two neighbours where a key's score may be."""
        at = keys >> np.uint64(32)
        at *= np.uint64(_MET >> 1)
        at >>= np.uint64(32)
        at <<= np.uint64(1)
        return at.view(np.int64)

    def _find(self, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Whether each key's score is remembered; writes scores to ``logs``."""
        at = self._places(keys)
        pairs = self._met.take(at)  # a key and its score are one number for NumPy, and so come together
        known = pairs.view(np.uint64)[::2] == keys
        logs[:] = pairs.view(np.float64)[1::2]
        others = np.flatnonzero(~known)
        pairs = self._met.take(at.take(others) + 1)
        found = np.flatnonzero(pairs.view(np.uint64)[::2] == keys.take(others))
        others = others.take(found)
        known[others] = True
        logs[others] = pairs.view(np.float64)[1::2].take(found)
        return known

    def _keep(self, keys: np.ndarray, logs: np.ndarray) -> None:
        """Remember scores: at the first place if it is free, or else at the second instead of what was there."""
        met = self._met.view(np.uint64)  # keys at even places
        pairs = np.empty(len(keys), _PAIR)
        pairs.view(np.uint64)[::2], pairs.view(np.float64)[1::2] = keys, logs
        at = self._places(keys)
        free = np.flatnonzero(met.take(at * 2) == 0)
        self._met[at.take(free)] = pairs.take(free)
        others = np.flatnonzero(met.take(at * 2) != keys)
        self._met[at.take(others) + 1] = pairs.take(others)


def train(texts: DataFrame) -> Model:
    """Train on all rows of a one-column table of UTF-8 bytes."""
    n_bytes = texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("long"))).first()[0] or 0
    sizes = table_sizes(n_bytes)
    # Merging splits moves no rows; small ones would each send tables of their own.
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    learned = texts.coalesce(tasks).mapInArrow(common.tidy(lambda batches: _train(batches, sizes)), "chunk int, data binary")
    summed = learned.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(common.tidy(lambda batches: _sum_chunks(batches, True)), "chunk int, data binary")
    return Model([(r.chunk, bytes(r.data)) for r in summed.collect()], sizes)  # the tables alone


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word among the distinct ones, words of each text, distinct words); words end at 09-0D and 20."""
    joined = b" ".join([*texts, b""]).lower()  # bytes: A-Z
    space = _spaces(np.frombuffer(joined, np.uint8))  # each text ends in one
    edges = np.flatnonzero(np.concatenate([~space[:1], space[1:] != space[:-1]]))
    starts, ends = edges[::2], edges[1::2]
    words = common.binary_array(np.frombuffer(joined.translate(None, _SPACE), np.uint8), np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]])))
    return words.indices.to_numpy(), sizes, words.dictionary


def scores(spark: SparkSession, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from rows whose crc32 of the id's text modulo 10 is not 0.
    """
    learn = (F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 10 != 0).cast("int")
    model = spark.sparkContext.broadcast(train(df.where(learn == 1).select(common.utf8(text_col).alias("text"))))
    packed = postings.build(df, id_col, text_col, lambda: _words, whole=True, weight=learn, measure=lambda texts: model.value.score(texts))

    def logs(_, counts: np.ndarray) -> np.ndarray:
        return np.stack([np.log10(counts + 0.1), counts > 0], 1)

    sums = common.stage_table(postings.value_terms(packed, lambda: logs, 2, tally=True), "lm")
    tally = F.when(F.col("block") == -1, F.col("tokens"))
    distinct, tokens, ends = sums.agg(F.sum(tally), F.sum(F.when(F.col("block") >= 0, F.col("tokens"))), F.sum("docs")).first()
    ends = ends or 0
    n, distinct = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    below = F.log10(F.lit(n + 0.1 * (distinct + 1)))
    return postings.sum_blocks(sums, df.schema[id_col].dataType, ["logs", "known"]).select(
        F.col("id").alias(id_col),
        (F.col("doc_weight") == 0).alias("held_out"),
        (F.col("n_terms") + 1).alias("n_tokens"),
        (F.col("known").cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.log10(F.lit(ends + 0.1)) - (F.col("n_terms") + 1) * below).alias("base_score"),
        F.col("measure").alias("score"),
        # the end is coded as a byte of its own
        (F.col("measure") * F.lit(-np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
