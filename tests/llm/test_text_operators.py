"""Token counts, BPE, language model, quality rules, toxicity against plain Python."""

import base64
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polystrata.llm import bpe, lm, postings, quality, queries, token_count, toxicity

from .conftest import SF

VOCAB = P.path("byte_bpe_50k.tiktoken")


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def body(t):
    return "" if t is None else t


def test_token_counts_match_the_library(table, empty):
    path = P.path("byte_bpe_50k.json")
    got = collect(token_count.token_counts(table, "doc_id", "text", path, P.PATTERN))
    library = Tokenizer.from_file(path)
    want = [(r.doc_id, len(body(r.text).encode()), len(library.encode(body(r.text), add_special_tokens=False).ids)) for r in table.collect()]
    assert got == sorted(want, key=repr)
    assert token_count.token_counts(empty, "doc_id", "text", path, P.PATTERN).count() == 0


def test_bpe_matches_the_library_and_round_trips(table, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(table, "text", "ids", VOCAB, P.PATTERN), "ids", "back", VOCAB, P.PATTERN)
    for r in out.collect():
        assert r.ids == library.encode_ordinary(body(r.text)) and bytes(r.back) == body(r.text).encode()
    assert out.columns == [*table.columns, "ids", "back"]
    assert bpe.decode(bpe.encode(empty, "text", "ids", VOCAB, P.PATTERN), "ids", "back", VOCAB, P.PATTERN).count() == 0


def test_long_rows_merge_like_short_ones():
    codec = bpe.Codec.from_file(VOCAB, P.PATTERN)
    for piece in (b"thequickbrownfox" * 12, b"a" * 400, bytes(range(97, 123)) * 9):
        assert codec._long(piece).tolist() == codec._matrix([piece])[0].tolist()


def test_language_model_base_is_exact_and_score_is_a_probability(spark, table, empty):
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in lm.scores(spark, table, "doc_id", "text").collect()}
    rows = table.collect()
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0 for r in rows]
    words = [body(r.text).encode().lower().split() for r in rows]
    counts = Counter(w for ws, out in zip(words, held, strict=True) if not out for w in ws)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for r, ws, out in zip(rows, words, held, strict=True):
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*[counts[w] for w in ws], ends])
        x = got[r.doc_id, len(ws) + 1, round(base, 6)]
        assert x.held_out == out and x.train_tokens == n and x.n_known == sum(counts[w] > 0 for w in ws) + 1
        assert x.score < 0 and math.isfinite(x.score)
    assert lm.scores(spark, empty, "doc_id", "text").count() == 0


def test_language_model_learns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in lm.scores(spark, docs, "doc_id", "text").collect() if r.held_out]
    size = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    bits = -sum(r.score for r in rows) * math.log2(10) / sum(size[r.doc_id] for r in rows)
    assert bits < 4.0  # a uniform byte takes 8


def test_probabilities_of_a_bit_sum_to_one():
    model = lm.Model([])
    items = lm.Items([b"abc"], True)
    for j, node, _, slots in items.bits(slice(None)):
        odds = [model.tables[k][slots[k]].astype(np.float32) for k in range(len(slots))]
        p, _, cell = model.mixer.predict(odds, j, node)
        assert np.allclose(model.mixer.refine(p, cell), 0.5, atol=1e-6)  # untrained


def plain_statistics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics_and_base_rule(table, empty):
    for r in quality.judge(table, "text", []).collect():
        want = plain_statistics(body(r.text))
        assert tuple(r._ps_stats)[:5] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(empty, "text", []).count() == 0


def test_quality_rules_learn_from_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality.fit(docs, labels, "doc_id", "text", "quality")
    assert rules
    got = quality.judge(docs, "text", rules).where("NOT base_failed").join(labels, "doc_id")
    right = got.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.95 * got.count()
    assert got.where("quality = 1 AND NOT kept").count() <= 0.02 * got.where("quality = 1").count()
    none = labels.where("quality = 1")
    assert quality.fit(docs, none, "doc_id", "text", "quality") == []


def test_decision_list_finds_a_threshold():
    x = np.arange(300.0)
    table = {r: np.zeros(300) for r in quality.RATIOS} | {"upper": x, "digits": x[::-1].copy()}
    rules = quality.learn(table, x > 200, np.arange(300) % 3)
    bad = np.zeros(300, bool)
    for r in rules:
        bad |= quality._covers(r, table)
    assert (bad == (x > 200)).mean() > 0.98


def test_toxicity_chain(spark, table, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    got = toxicity.score(docs, "text", chain).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    assert got.where("is_toxic AND label = 0").count() <= 0.02 * got.where("label = 0").count()
    assert got.where("is_toxic AND label = 1").count() >= 0.7 * got.where("label = 1").count()
    assert toxicity.score(table, "text", chain).count() == table.count() and toxicity.score(empty, "text", chain).count() == 0
    with pytest.raises(StopIteration):  # the later model sees the earlier one
        next(k for k in range(1, len(chain.categories)) if len(chain.by_earlier[k]) != k)


def test_chain_without_examples():
    x = np.ones((6, 2), np.float32)
    chain = toxicity.fit_chain(x, ["a", "b"], {"c": np.zeros(6, bool), "d": np.ones(6, bool)}, np.arange(6) % 5)
    p = chain.probabilities(np.zeros((1, len(chain.vocabulary)), np.float32))
    assert p[0, 0] < 1e-6 and p[0, 1] > 1 - 1e-6


def test_query_columns(spark):
    df = queries.op6_bpe(spark, SF)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert queries.op1_token_count(spark, SF).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_language_model_has_contexts_of_two_three_four_and_six_bytes():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 90))).encode() for _ in range(40)]
    items = lm.Items(texts)
    padded = [bytes(8) + t + b"\0" for t in texts]
    want = [len({t[k - m : k] for t in padded for k in range(8, len(t))}) for m in (2, 3, 4, 6)]
    assert [len(np.unique(h)) for h in items.hashes[:-1]] == want


def test_language_model_slices_take_little_memory():
    """What a slice takes beside the tables, in bytes a byte of text; predicting, learning and counting each place once."""
    rnd = random.Random(7)
    words = [bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(20000)]
    texts = [b" ".join(rnd.choices(words, k=500)) for _ in range(700)]
    n_bytes = sum(map(len, texts))
    assert n_bytes > 2 << 20
    counts, mixer = lm._Counts(lm._LEAST), lm.Mixer()
    tracemalloc.start()
    try:
        items = lm.Items(texts)
        counts.add(items)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100 * n_bytes
    assert items.counts.sum() == n_bytes + len(texts)
    for table in counts.tables:
        assert int((table & 0xFFFFFFFF).sum() + (table >> 32).sum()) == 8 * (n_bytes + len(texts))
    before = mixer.weights.copy()
    lm._fit(items, counts, mixer)
    assert int(mixer.seen.sum()) == 8 * (n_bytes + len(texts)) and (mixer.weights != before).any()
    # every place finds the item of its byte
    some = lm.Items(texts[:50], True)
    assert some.byte[some.places].tobytes() == b"".join(t + b"\0" for t in texts[:50])


def test_language_model_counts_of_many_tasks_do_not_overflow():
    zeros, ones = 1_500_000_000, 1_000_000_000
    data = np.full(16, zeros << 32 | ones, np.int64).tobytes()
    rows = [pa.RecordBatch.from_arrays([pa.array([0] * 5, pa.int32()), pa.array([data] * 5, pa.binary())], names=["chunk", "data"])]
    (got,) = lm._sum_chunks(rows)
    odds = np.frombuffer(got.column(1)[0].as_py(), np.int16) / lm._SCALE
    assert np.allclose(odds, math.log(ones / zeros), atol=1e-3)


def test_language_model_tables_grow_with_the_corpus():
    least, more, most = (lm.table_sizes(n) for n in (0, 30 * 10**9, 10**14))
    assert least == tuple(1 << bits for bits in lm.BITS) and lm.table_sizes(lm.BASE_BYTES) == least
    assert all(4 < b / a < 4.3 for a, b in zip(least[1:], more[1:], strict=True)) and more[0] == least[0]
    assert 2 * sum(most) < 1 << 30 and all(size % lm._CHUNK == 0 for size in most)
    items = lm.Items([bytes(range(1, 200)) * 50])
    slots = [np.stack([s[k] for _, _, _, s in items.bits(slice(None), more)]) for k in range(len(more))]
    assert all(s.min() >= 0 and s.max() < size for s, size in zip(slots, more, strict=True))
    assert all(s.max() > size * 0.9 for s, size in zip(slots, more, strict=True))


def some_texts(seed, n):
    rnd = random.Random(seed)
    words = [bytes(rnd.choices(b"abcdefghij", k=rnd.randint(1, 7))) for _ in range(300)]
    return [b" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(n)]


def test_language_model_predicts_an_item_once(monkeypatch):
    """Items that a worker met in an earlier slice are not predicted again, and forgetting them changes nothing."""
    texts, sizes = some_texts(11, 80), []
    predict = lm.Mixer.predict

    def counted(self, odds, *more):
        sizes.append(len(odds[0]))
        return predict(self, odds, *more)

    def model():
        made = lm.Model([])
        for k, table in enumerate(made.tables):
            table[:] = np.random.default_rng(k).integers(-4000, 4000, len(table))
        return made

    want = [model().score([t])[0] for t in texts[:20]]
    monkeypatch.setattr(lm.Mixer, "predict", counted)
    monkeypatch.setattr(lm, "SLICE", 2000)
    own = model()
    first = own.score(texts)
    assert sum(sizes) == 8 * len(lm.Items(texts).counts)
    sizes.clear()
    assert np.array_equal(own.score(texts[::-1])[::-1], first) and not sum(sizes)
    assert np.allclose(first[:20], want, rtol=1e-6)
    monkeypatch.setattr(lm, "_MET", 500)
    assert np.allclose(model().score(texts), first, rtol=1e-12)


def test_language_model_counts_and_learns_like_plain_python():
    counts, mixer = lm._Counts(lm._LEAST), lm.Mixer()
    items = lm.Items(some_texts(12, 60))
    counts.add(items)
    seen, tables = [Counter() for _ in lm.BITS], counts.tables
    for _, _, bit, slots in items.bits(slice(None)):
        for k, own in enumerate(slots):
            for slot, b, c in zip(own.tolist(), bit.tolist(), items.counts.tolist(), strict=True):
                seen[k][slot] += c if b else c << 32
    for k, table in enumerate(tables):
        assert {int(s): int(table[s]) for s in np.flatnonzero(table)} == seen[k]
    more = lm.Items(some_texts(13, 60))
    assert len(more.counts) < lm._MINI
    lm._fit(more, counts, mixer)
    want, cells = lm.Mixer().weights.astype(float), Counter()
    start = want.copy()
    for j, node, bit, slots in more.bits(slice(None)):
        grad, curve = np.zeros((6, 16)), np.zeros((6, 16))
        zeros, ones = ([(t[s] >> 32 if high else t[s] & 0xFFFFFFFF) for t, s in zip(tables, slots, strict=True)] for high in (True, False))
        for at in range(len(bit)):
            odds = [round(math.log((o[at] + 0.1) / (z[at] + 0.1)) * 1024) / 1024 for z, o in zip(zeros, ones, strict=True)] + [1.0]
            gate = sum(unit * (abs(odds[k]) > t) for k, unit in ((4, 4), (3, 1)) for t in (0, 2.5, 4.5))
            z = max(-14.0, min(14.0, sum(w * o for w, o in zip(start[:, j * 16 + gate], odds, strict=True))))
            p, c = 1 / (1 + math.exp(-z)), int(more.counts[at])
            grad[:, gate] += [c * (int(bit[at]) - p) * o for o in odds]
            curve[:, gate] += [c * p * (1 - p) * o * o for o in odds]
            cells[int(node[at]), int(bit[at])] += c
        want[:, j * 16 : j * 16 + 16] += 0.05 * grad / (curve + 50)
    assert np.allclose(mixer.weights, want, atol=1e-4) and np.abs(want - start).max() > 0.01
    got = mixer.seen.reshape(256, lm._BUCKETS, 2).sum(1)
    assert {(n, b): int(got[n, b]) for n in range(256) for b in (0, 1) if got[n, b]} == cells


def test_language_model_learns_the_first_half_of_a_byte_once_for_like_items(monkeypatch):
    texts, sizes = some_texts(14, 200), []
    items = lm.Items(texts)
    padded = [bytes(8) + t + b"\0" for t in texts]
    want = Counter((t[k - 6 : k], re.split(rb"[\s\0]", t[:k])[-1], t[k] >> 4) for t in padded for k in range(8, len(t)))
    assert len(items.heads) == len(want) < 0.9 * len(items.counts)
    assert sorted(items.head_counts.tolist()) == sorted(want.values())
    learn = lm.Mixer.learn

    def counted(self, odds, bounds, j, bit, count):
        sizes.append((j, len(bit), int(count.sum())))
        return learn(self, odds, bounds, j, bit, count)

    monkeypatch.setattr(lm.Mixer, "learn", counted)
    lm._fit(items, lm._Counts(lm._LEAST), lm.Mixer())
    for j in range(8):
        own = [x for x in sizes if x[0] == j]
        assert len(own) == -(-len(items.counts) // lm._MINI)  # as many steps as for the items
        assert sum(n for _, n, _ in own) == len(items.counts if j > 3 else items.heads)
        assert sum(n for _, _, n in own) == sum(len(t) + 1 for t in texts)


def test_language_model_sends_four_bytes_a_slot():
    """Tasks send counts of half bytes; log-odds of their sums are those of the zeros and ones, and do not overflow."""
    texts, sizes = some_texts(15, 60), lm._LEAST
    both = [list(lm._train([pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["text"])], sizes)) for own in (texts[:40], texts[40:])]
    assert all(len(b.column(1)[0].as_py()) == 4 * lm._CHUNK for own in both for b in own[1:])
    rows = sorted((b for own in both for b in own), key=lambda b: b.column(0)[0].as_py())
    model = lm.Model([(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in lm._sum_chunks(rows, True)])
    counts = lm._Counts(sizes)
    for own in (texts[:40], texts[40:]):
        counts.add(lm.Items(own))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, counts.logs, strict=True))
    data = np.full(16, 2_000_000_000, np.int32).tobytes()
    (got,) = lm._sum_chunks([pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array([data] * 3, pa.binary())], names=["chunk", "data"])], True)
    assert not np.frombuffer(got.column(1)[0].as_py(), np.int16).any()  # as many zeros as ones


def test_words_of_a_block():
    texts = [b"", b" ", b"A b\x0bC\x0c a\x00\xc3\x84", b"\t\n", b"x" * 70 + b" b", b"\x1c\xc2\xa0 \x85", *some_texts(16, 30)]
    codes, sizes, words = lm._words(texts)
    words, at = words.to_pylist(), np.cumsum([0, *sizes])
    assert [[words[c] for c in codes[a:b]] for a, b in zip(at, at[1:], strict=False)] == [re.findall(rb"[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    assert len(set(words)) == len(words)
    none = lm._words([b"", b"\n"])
    assert not len(none[0]) and none[1].tolist() == [0, 0] and not len(none[2])


def test_bucket_of_a_term_follows_from_its_bytes():
    rnd = random.Random(17)
    terms = [bytes(rnd.choices(b"abc\x00\xff", k=rnd.randint(0, 200))) for _ in range(5000)] + [b"y" * n for n in (postings._RUN, postings._RUN + 1)]
    whole = postings._buckets(pa.array(terms, pa.binary()), 97)
    assert [int(postings._buckets(pa.array([t], pa.binary()), 97)[0]) for t in terms] == whole.tolist()
    assert np.bincount(postings._buckets(pa.array(list(set(terms)), pa.binary()), 97), minlength=97).max() < 120
    values = np.array([0, 127, 128, 2**14 - 1, 2**14, 2**21, 2**28 - 1, 2**28, 2**35 - 1])
    packed, ends = postings._varints(values)
    assert ends.tolist() == [1, 2, 4, 6, 9, 13, 17, 22, 27] and np.array_equal(postings._numbers(packed.tobytes()), values)
    assert not len(postings._buckets(pa.array([], pa.binary()), 97))
