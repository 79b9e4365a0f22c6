"""Removal of repeated byte strings by a distributed suffix array.

A byte goes if a string of 200 bytes that covers it also starts anywhere else.
Texts are UTF-8 bytes; strings never cross texts; all strings are judged on the
input.

1. Sieve.  The hash of every 104-byte string is taken; in each window of 96 starts
   the smallest (ties: the last) is the window's anchor.  Equal 200-byte strings
   have equal anchors at equal places, so only strings whose anchor's hash occurs at
   two places or more can repeat.  Anchors are packed by bucket of their hash for
   the one shuffle this takes; exact copies of a text count as one place.
2. The context of an anchor, from 95 bytes before it to 200 bytes after its start,
   holds every string that it is the anchor of.  Contexts that occur twice settle
   all their strings at once (their hashes are shuffled, not they), and of these
   one stays as a partner for others.
3. Suffix array.  What is left is dealt out by the anchor's hash: suffixes that
   share their first 104 bytes come to one task.  There the difference-cover
   algorithm (:mod:`.suffixes`) sorts the suffixes from the 104th byte on and,
   backwards, what precedes the anchors; adjacent prefixes are compared.  A string
   that starts d bytes before its anchor repeats if another suffix shares its first
   200 - d bytes and the d bytes before it, which two runs over the sorted orders
   decide exactly for each d.
4. Texts that occur twice go as a whole if they have 200 bytes.

Defined results: NULL is the empty text; texts under 200 bytes are kept; repeated
rows are copies of a text; NULL ids pass through; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, suffixes

LENGTH, GRAM = 200, 104
WINDOW = LENGTH - GRAM
#: Suffixes that a task sorts at once, unless one hash has more.
_SORT = 20_000
_SEEN = 200_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BYTES = [common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * k)) for k in range(3)]


class _Grams:
    """Hashes of all substrings of given lengths, from sums of byte numbers times powers modulo 2**64."""

    def __init__(self):
        self.powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]

    def _upto(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        for j, base in enumerate((_BASES[k], pow(_BASES[k], -1, 1 << 64))):
            held = self.powers[k][j]
            while len(held) < n:
                held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
            self.powers[k][j] = held
        return self.powers[k][0][:n], self.powers[k][1][:n]

    def sums(self, k: int, raw: np.ndarray) -> np.ndarray:
        up, _ = self._upto(k, len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[k][raw] * up[:-1], out=out[1:])
        return out

    def spans(self, k: int, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        _, down = self._upto(k, len(sums))
        x = (sums[stops] - sums[starts]) * down[starts]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def grams(self, raw: np.ndarray) -> np.ndarray:
        sums = self.sums(0, raw)
        _, down = self._upto(0, len(sums))
        x = (sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def anchors(raw: np.ndarray, grams: _Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first and last string start) of the anchors of a text of at least 200 bytes."""
    h = grams.grams(raw)
    low = np.uint64((1 << int(len(h)).bit_length()) - 1)
    x = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # the place breaks ties: the last one wins
    for step in (1, 2, 4, 8, 16, 32):
        x = np.minimum(x[:-step], x[step:])
    x = np.minimum(x[:-32], x[32:])[: len(raw) - LENGTH + 1]  # 64 and 32: windows of 96
    place = (low - (x & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return place[first], h[place[first]], first, last


def _sieve(texts: DataFrame) -> DataFrame:
    """(h, len, pos): anchors whose hash occurs at two places or more, of texts (h, len, text)."""
    buckets = common.buckets(texts)
    names = ["bucket", "gram", "h", "place"]

    def pack(batches):
        grams, seen = _Grams(), set()
        for batch in batches:
            hs, ends = batch.column(0).to_numpy(), common.byte_rows(batch.column(2))[1]
            for start, stop in common.slices(ends, 8 << 20):
                raw = common.byte_rows(batch.column(2).slice(start, stop - start))[0]
                found, owners, places = [], [], []
                if len(seen) > _SEEN:
                    seen = set()
                for k in range(start, stop):
                    key = (int(hs[k]), int(ends[k + 1] - ends[k]))
                    if key in seen:  # a copy, in this task
                        continue
                    seen.add(key)
                    p, g, _, _ = anchors(raw[ends[k] - ends[start] : ends[k + 1] - ends[start]], grams)
                    found.append(g)
                    places.append(p | key[1] << 32)
                    owners.append(np.full(len(p), hs[k]))
                if not found:
                    continue
                g, o, p = np.concatenate(found), np.concatenate(owners), np.concatenate(places)
                bucket = (g % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                g, o, p, bucket = g[order], o[order], p[order], bucket[order]
                bounds = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(bounds)):
                    cut = slice(bounds[b], bounds[b + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([v[cut].tobytes()], pa.binary()) for v in (g, o, p)]], names=names)

    def pick(batches):
        at, held = None, []

        def done():
            g, h, p = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in enumerate((np.uint64, np.int64, np.int64)))
            order = np.lexsort((p, h, g))
            g, h, p = g[order], h[order], p[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1])])
            g, h, p = g[new], h[new], p[new]
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[:-1] |= same[1:]
            h, p = h[same], p[same]
            for low in range(0, len(h), 50_000):
                cut = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[cut]), pa.array((p[cut] >> 32).astype(np.int32)), pa.array((p[cut] & 0xFFFFFFFF).astype(np.int32))], names=["h", "len", "pos"])

        for batch in batches:
            for b, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != at and held:
                    yield from done()
                    held = []
                at = b
                held.append(row)
        if held:
            yield from done()

    packed = texts.mapInArrow(common.tidy(pack), "bucket int, gram binary, h binary, place binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(common.tidy(pick), "h long, len int, pos int")


def _contexts(batch: pa.RecordBatch, grams: _Grams):
    """For each text of a batch (h, len, text, pos): its bytes and its candidates' places and string starts."""
    for k in range(batch.num_rows):
        raw = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
        wanted = np.sort(batch.column(3)[k].values.to_numpy())
        place, _, first, last = anchors(raw, grams)
        at = np.searchsorted(place, wanted)
        yield batch.column(0)[k].as_py(), raw, place[at], first[at], last[at]


def _settled(cand: DataFrame) -> DataFrame:
    """(h, len, pos, many): whether the anchor's whole context occurs twice; of equal contexts all rows are kept, one with ``rep``."""
    schema = "a long, b long, h long, len int, pos int"

    def run(batches):
        grams = _Grams()
        for batch in batches:
            for h, raw, place, first, last in _contexts(batch, grams):
                low, high = np.maximum(place - (WINDOW - 1), 0), np.minimum(place + LENGTH, len(raw))
                # the ends of the text and the strings' starts are part of the context
                shape = (low - place).astype(np.uint64) << np.uint64(32) ^ (high - place).astype(np.uint64) << np.uint64(20) ^ (place - first).astype(np.uint64) << np.uint64(10) ^ (place - last).astype(np.uint64)
                keys = [common.mix64(grams.spans(k, grams.sums(k, raw), low, high) ^ shape) for k in (1, 2)]
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(np.full(n, h)), pa.array(np.full(n, len(raw), np.int32)), pa.array(place.astype(np.int32))], names=["a", "b", "h", "len", "pos"])

    # Counts combine before they are shuffled.  They are staged so that the join reads shuffles on both sides: adaptive
    # execution then splits the rows of a hot context, which it does not do beside an aggregation of the same stage.
    hashed = common.stage_table(cand.mapInArrow(common.tidy(run), schema), "hashed")
    place = F.struct("h", "len", "pos")
    twice = hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).where("c > 1").drop("c")
    rows = hashed.join(common.stage_table(twice, "twice"), ["a", "b"], "left")
    return rows.select("h", "len", "pos", F.col("first").isNotNull().alias("many"), (F.col("first").isNull() | (F.col("first") == place)).alias("rep"))


def _adjacent(rows: np.ndarray, have: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in the order (the first: 0)."""
    x, n = rows[order], have[order]
    differ = x[1:] != x[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], np.minimum(shared, np.minimum(n[1:], n[:-1]))])


def _symbols(rows: np.ndarray, have: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 6-byte numbers, behind the group and before the number of bytes there are."""
    width = -(-rows.shape[1] // 6) * 6
    padded = np.zeros((len(rows), width), np.int64)
    padded[:, : rows.shape[1]] = rows
    packed = padded.reshape(len(rows), -1, 6) @ (1 << np.arange(40, -1, -8, dtype=np.int64))
    return np.concatenate([group[:, None], packed, have[:, None]], 1)


def repeating(group: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Boolean (row, d): whether the string that starts d bytes before the row's anchor repeats.

    Rows of one ``group`` share the 104 bytes at their anchors; ``right`` follows
    them, ``left`` precedes the anchor backwards.  Only d in [low, high] is asked;
    a row with ``many`` is several equal ones.
    """
    out = np.zeros((len(group), WINDOW), bool)
    n = len(group)
    forward, backward = suffixes.order_rows(_symbols(right, n_right, group)), suffixes.order_rows(_symbols(left, n_left, group))
    after, before = _adjacent(right, n_right, forward), _adjacent(left, n_left, backward)
    breaks = [np.concatenate([[True], group[o][1:] != group[o][:-1]]) for o in (forward, backward)]
    weight = np.where(many, 2, 1)
    for d in range(WINDOW):
        asked = np.flatnonzero((low <= d) & (d <= high))
        if not len(asked):
            continue
        ends, starts = np.empty(n, np.int64), np.empty(n, np.int64)
        ends[forward] = np.cumsum(breaks[0] | (after < WINDOW - d))
        starts[backward] = np.cumsum(breaks[1] | (before < d))
        # rows too short for the d have runs of their own, as nothing is shared with them
        _, code = np.unique(ends * (n + 1) + starts, return_inverse=True)
        total = np.bincount(code, weight)
        out[asked, d] = total[code[asked]] > 1
    return out


def _decided(flagged: DataFrame) -> DataFrame:
    """(h, len, pos, starts): by the suffix array, for anchors whose context is alone; ``starts`` are the repeating d as bits."""
    schema = "g long, g2 long, h long, len int, pos int, many boolean, low int, high int, right binary, left binary"

    def cut(batches):
        grams = _Grams()
        for batch in batches:
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
                wanted, many = batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                place, g, first, last = anchors(raw, grams)
                at = np.searchsorted(place, wanted)
                second = grams.spans(1, grams.sums(1, raw), place[at], place[at] + GRAM)
                data, n = raw.tobytes(), len(wanted)
                lefts = [data[max(0, p - WINDOW + 1) : p][::-1] for p in wanted.tolist()]
                rights = [data[p + GRAM : p + LENGTH] for p in wanted.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), pa.array(second.view(np.int64)), pa.array([batch.column(0)[k].as_py()] * n, pa.int64()), pa.array(np.full(n, len(raw), np.int32)), pa.array(wanted.astype(np.int32)), pa.array(many), pa.array((place[at] - last[at]).astype(np.int32)), pa.array((place[at] - first[at]).astype(np.int32)), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary())],
                    names=["g", "g2", "h", "len", "pos", "many", "low", "high", "right", "left"],
                )

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = common.byte_rows(column)
        have = np.diff(ends)
        out = np.zeros((len(have), width), np.uint8)
        out[np.arange(width) < have[:, None]] = raw
        return out, have

    def solve(batches):
        held, size = [], 0

        def done(table):
            g, g2 = table.column("g").to_numpy(), table.column("g2").to_numpy()
            group = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])]))
            right, left = matrix(table.column("right"), WINDOW), matrix(table.column("left"), WINDOW - 1)
            many = table.column("many").to_numpy()
            bits = repeating(group, *right, *left, table.column("low").to_numpy(), table.column("high").to_numpy(), many)
            packed = np.packbits(bits, axis=1)
            hit = np.flatnonzero(bits.any(1) & ~many)
            for low in range(0, len(hit), 20_000):
                part = hit[low : low + 20_000]
                flat = common.binary_array(packed[part].ravel(), np.arange(len(part) + 1) * packed.shape[1])
                yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(pa.array(part)) for c in ("h", "len", "pos")], flat], names=["h", "len", "pos", "starts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= _SORT:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                at = int(np.searchsorted(g, g[-1]))  # the last hash may go on
                if at:
                    yield from done(table.slice(0, at).combine_chunks())
                    held, size = table.slice(at).combine_chunks().to_batches(), size - at
        if held:
            yield from done(pa.Table.from_batches(held))

    rows = flagged.mapInArrow(common.tidy(cut), schema).repartition("g").sortWithinPartitions("g", "g2")
    return rows.mapInArrow(common.tidy(solve), "h long, len int, pos int, starts binary")


def _removed(raw: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, whole: np.ndarray, own: dict[int, np.ndarray]) -> np.ndarray:
    """Boolean by byte: covered by a repeating string."""
    edge = np.zeros(len(raw) + 1, np.int64)
    index = {int(p): k for k, p in enumerate(place)}
    for p in whole.tolist():
        k = index[p]
        edge[first[k]] += 1
        edge[last[k] + LENGTH] -= 1
    for p, d in own.items():
        np.add.at(edge, p - d, 1)
        np.add.at(edge, p - d + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.xxhash64(body).alias("h"), F.octet_length(body).alias("len"), body.cast("binary").alias("text"))


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` extended to the UTF-8 characters that it cuts."""
    character = np.cumsum((raw & 0xC0) != 0x80)
    return (np.bincount(character, gone, character[-1] + 1) > 0)[character]


def changed_texts(df: DataFrame, text_col: str, whole_characters: bool = False) -> DataFrame:
    """(h, len, n_removed, n_spans, kept): distinct texts that lose bytes to strings elsewhere; exact copies are not among the reasons.

    ``h`` is xxhash64 of the text and ``len`` its bytes; the two name a text.
    ``whole_characters``: what a cut leaves of a character is not kept.
    """
    texts = _texts(df, text_col).where(F.col("len") >= LENGTH)
    cand = _sieve(texts).groupBy("h", "len").agg(F.collect_list("pos").alias("pos"))
    cand = common.stage_table(cand, "anchors")
    # a sieve of at most 2**20 numbers keeps texts without candidates out of the shuffle
    bucket = lambda: F.pmod(F.col("h"), F.lit(1 << 20))
    texts = texts.join(F.broadcast(cand.select(bucket().alias("_b")).distinct()), bucket() == F.col("_b"), "left_semi")
    held = common.stage_table(texts.dropDuplicates(["h", "len"]).join(cand, ["h", "len"]).select("h", "len", "text", "pos"), "candidates")
    marks = common.stage_table(_settled(held), "contexts")
    asked = marks.where("NOT many OR rep").groupBy("h", "len").agg(F.array_sort(F.collect_list(F.struct("pos", "many"))).alias("m"))
    asked = held.select("h", "len", "text").join(asked, ["h", "len"]).select("h", "len", "text", F.col("m.pos").alias("pos"), F.col("m.many").alias("many"))
    own = _decided(asked).groupBy("h", "len").agg(F.array_sort(F.collect_list(F.struct("pos", "starts"))).alias("own"))
    whole = marks.where("many").groupBy("h", "len").agg(F.collect_list("pos").alias("whole"))
    rows = held.select("h", "len", "text").join(whole, ["h", "len"], "left").join(own, ["h", "len"], "left").where("whole IS NOT NULL OR own IS NOT NULL")
    rows = rows.select("h", "len", "text", F.coalesce("whole", F.array().cast("array<int>")).alias("whole"), F.coalesce(F.col("own.pos"), F.array().cast("array<int>")).alias("pos"), F.coalesce(F.col("own.starts"), F.array().cast("array<binary>")).alias("starts"))

    def run(batches):
        grams = _Grams()
        for batch in batches:
            out: list = [[], [], []]
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
                place, _, first, last = anchors(raw, grams)
                bits = {p: np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))[:WINDOW]) for p, b in zip(batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), strict=True)}
                gone = _removed(raw, place, first, last, batch.column(3)[k].values.to_numpy(), bits)
                out[0].append(int(gone.sum()))
                out[1].append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
                out[2].append(raw[~(_whole_characters(raw, gone) if whole_characters else gone)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["h", "len", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(common.tidy(run), "h long, len int, n_removed long, n_spans long, kept binary")


def _second(body: Column) -> Column:
    """A second hash of a text: whole texts are removed only if 128 bits and the length agree."""
    return F.xxhash64(F.lit(1), body)


def _copied(df: DataFrame, text_col: str) -> DataFrame:
    """(h, len, h2) of texts of at least 200 bytes that occur more than once."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = df.select(F.xxhash64(body).alias("h"), F.octet_length(body).alias("len"), _second(body).alias("h2")).where(F.col("len") >= LENGTH)
    return names.groupBy("h", "len", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "len", "h2", F.lit(True).alias("copied"))


def report(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    changed = changed_texts(df, text_col).select("h", "len", F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.sha2("kept", 256).alias("k"))
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("h"), F.octet_length(body).alias("len"), _second(body).alias("h2"), F.sha2(body.cast("binary"), 256).alias("sha"))
    out = rows.join(changed, ["h", "len"], "left").join(_copied(df, text_col), ["h", "len", "h2"], "left")
    n = F.col("len").cast("long")
    return out.select(
        F.col("id").alias(id_col),
        n.alias("n_bytes"),
        F.when(F.col("copied"), n).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), 1).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
    )


def strip(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with repeated strings taken out of its texts; what a cut leaves of a character goes as well.

    Rows of which nothing but white space is left go; rows that lose nothing stay as
    they are, NULL, empty and blank ones among them.
    """
    changed = changed_texts(df, text_col, True).select(F.col("h").alias("_ps_h"), F.col("len").alias("_ps_len"), F.col("kept").alias("_ps_kept"))
    copied = _copied(df, text_col).withColumnsRenamed({"h": "_ps_h", "len": "_ps_len", "h2": "_ps_h2", "copied": "_ps_copied"})
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.withColumns({"_ps_h": F.xxhash64(body), "_ps_len": F.octet_length(body), "_ps_h2": _second(body)})
    rows = rows.join(changed, ["_ps_h", "_ps_len"], "left").join(copied, ["_ps_h", "_ps_len", "_ps_h2"], "left")
    left = F.when(F.col("_ps_copied"), F.lit("")).otherwise(F.col("_ps_kept").cast("string"))
    rows = rows.withColumn("_ps_left", left).where(F.col("_ps_left").isNull() | F.col("_ps_left").rlike(r"[^\t\n\x0B\f\r ]"))
    return rows.select(*[F.coalesce("_ps_left", F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
