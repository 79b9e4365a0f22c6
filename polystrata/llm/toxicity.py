"""Toxicity by a chain of linear classifiers over words.

Categories are predicted one after the other.  Each is a logistic model with an
L1 penalty; later models also get the log-odds that the earlier ones give.  In
training those come from models that did not see the row (out of fold), so a later
model learns how far to trust them; the same out-of-fold probabilities set each
category's threshold (best F1).  Features are words and beginnings of longer words
(3 to 8 letters); a feature's value is log2(1 + number of the text's distinct words
that have it), so an inflected stem counts as often as it is inflected.

The chain is fitted on at most :data:`SAMPLE` labelled rows (those of smallest id
hash); every row is scored over its whole text.

Defined results: NULL and empty texts have no words and get the models' bias; rows
with a NULL label or text are not learned from; of repeated labels of an id the
highest counts; a category without examples of both kinds gets probability 0 (or
1); repeated rows are scored each; an empty table gives an empty table; other
columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most labelled rows the chain is fitted on, most features it may use, and folds.
SAMPLE, FEATURES, FOLDS = 10_000, 400, 5

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a task remembers at most.
_MEMO = 400_000


def words(text: bytes) -> set[str]:
    """Distinct words (runs of letters), lower-cased."""
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


def features(word: str) -> list[str]:
    """The word, and its proper beginnings of 3 to 8 letters, marked by a star."""
    return [word[:64], *[word[:n] + "*" for n in range(3, min(9, len(word)))]]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> np.ndarray:
    """Weights (the last is the bias) of an L1-penalised logistic model, by accelerated proximal gradient."""
    n = len(y)
    x, y = np.concatenate([x, np.ones((n, 1))], 1).astype(np.float32), y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = _logit(np.array([y.mean()]))[0]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # largest eigenvalue, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    rate = np.float32(4 * n / max(float(np.linalg.norm(x.T @ (x @ v))), 1e-9))
    seen, t = w.copy(), 1.0
    for _ in range(steps):
        new = seen - rate * (x.T @ (_sigmoid(x @ seen) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * np.float32(penalty), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w.astype(float)


@dataclass
class Chain:
    """Fitted chain: for each category weights by feature, weights of the earlier categories, bias and threshold."""

    categories: list[str]
    vocabulary: list[str]
    by_feature: np.ndarray
    by_earlier: list[np.ndarray]
    bias: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories) from feature values (rows, vocabulary)."""
        out = np.zeros((len(x), len(self.categories)))
        for k in range(len(self.categories)):
            z = x @ self.by_feature[k] + self.bias[k]
            if k:
                z = z + _logit(out[:, :k]) @ self.by_earlier[k]
            out[:, k] = _sigmoid(z)
        return out


class Counter:
    """Counts, for each text, its distinct words that have each feature of a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.place = {f: k for k, f in enumerate(vocabulary)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def values(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.place)), np.float32)
        if len(self.memo) > _MEMO:
            self.memo = {}
        memo, place = self.memo, self.place
        for row, text in zip(out, texts, strict=True):
            for w in words(text):
                hits = memo.get(w)
                if hits is None:
                    hits = memo[w] = tuple(place[f] for f in features(w) if f in place)
                for k in hits:
                    row[k] += 1
        return np.log2(1 + out)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Cut of the best F1, half way to the next lower probability."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def fit_chain(x: np.ndarray, vocabulary: list[str], labels: dict[str, np.ndarray], folds: np.ndarray, penalty: float = 0.0003) -> Chain:
    """Fit the chain on feature values; ``labels`` in order of the chain; ``folds`` 0 to FOLDS - 1."""
    names, width = list(labels), x.shape[1]
    by_feature, by_earlier = np.zeros((len(names), width)), []
    bias, thresholds = np.zeros(len(names)), np.full(len(names), 0.5)
    earlier = np.zeros((len(x), 0), np.float32)
    for k, y in enumerate(labels.values()):
        y = y.astype(float)
        if not 0 < y.sum() < len(y):
            bias[k] = 30.0 if len(y) and y[0] else -30.0
            by_earlier.append(np.zeros(k))
            out_of_fold = np.full(len(y), float(len(y) and y[0]))
        else:
            data = np.concatenate([x, earlier], 1)
            out_of_fold = np.full(len(y), y.mean())
            for f in range(FOLDS):
                rest, own = folds != f, folds == f
                if own.any() and 0 < y[rest].sum() < rest.sum():
                    w = _fit_linear(data[rest], y[rest], penalty)
                    out_of_fold[own] = _sigmoid(data[own] @ w[:-1] + w[-1])
            w = _fit_linear(data, y, penalty)
            by_feature[k], bias[k] = w[:width], w[-1]
            by_earlier.append(w[width:-1])
            thresholds[k] = _best_threshold(out_of_fold, y)
        earlier = np.concatenate([earlier, _logit(out_of_fold)[:, None].astype(np.float32)], 1)
    used = np.flatnonzero(np.abs(by_feature).sum(0) > 0)
    return Chain(names, [vocabulary[c] for c in used], by_feature[:, used], by_earlier, bias, thresholds)


def telling_features(rows: DataFrame, most: int = FEATURES) -> tuple[list[str], list[str]]:
    """(features that go most with the label, those of them that mark label 1) of rows (label, text)."""

    def run(batches):
        for batch in batches:
            found = [sorted({f for w in words(t) for f in features(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["label", "f"])

    totals = rows.groupBy("label").count().collect()
    n1, n0 = (sum(r["count"] for r in totals if (r["label"] == 1) == hit) for hit in (True, False))
    counts = rows.select("label", "text").mapInArrow(common.tidy(run), "label int, f array<string>").select("label", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count(F.lit(1)).alias("c")).where("c >= 4")
    ratio = F.log((F.col("c1") + 0.5) / (n1 + 1) / ((F.col("c") - F.col("c1") + 0.5) / (n0 + 1)))
    best = counts.withColumn("ratio", ratio).orderBy((F.sqrt("c") * F.abs("ratio")).desc(), "f").limit(most).collect()
    return [r.f for r in best], [r.f for r in best if r.c1 >= 10 and r.c1 >= 0.9 * r.c]


def _severe(x: np.ndarray, vocabulary: list[str], marks: list[str], toxic: np.ndarray) -> np.ndarray:
    """A graded category: toxic rows with at least the median number of marking words."""
    own = [k for k, f in enumerate(vocabulary) if f in set(marks)]
    counts = np.round(2 ** x[:, own] - 1).sum(1)
    return toxic & (counts >= max(1.0, float(np.median(counts[toxic])) if toxic.any() else 1.0))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Chain:
    """Fit the chain ``toxic`` (the label), then ``severe`` (graded by the number of marking words)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_ps_id")).agg(F.max(label_col).alias("_ps_label"))
    known = known.orderBy(F.xxhash64("_ps_id"), "_ps_id").limit(SAMPLE)
    rows = df.select(F.col(f"`{id_col}`").alias("_ps_id"), F.col(f"`{text_col}`").alias("_ps_body")).where("_ps_body IS NOT NULL")
    rows = rows.join(F.broadcast(known), "_ps_id").select(F.col("_ps_label").cast("int").alias("label"), common.utf8("_ps_body").alias("text"), "_ps_id")
    rows = common.stage_table(rows.limit(2 * SAMPLE), "labelled")
    vocabulary, marks = telling_features(rows)

    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            values = counter.values(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(values), pa.list_(pa.float32()))], names=["label", "fold", "x"])

    fold = (F.crc32(F.col("_ps_id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold")
    got = rows.orderBy("_ps_id", "text").select("label", fold, "text").mapInArrow(common.tidy(run), "label int, fold int, x array<float>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(vocabulary)) if len(got) else np.zeros((0, len(vocabulary)), np.float32)
    toxic, folds = got["label"].to_numpy() == 1, got["fold"].to_numpy()
    return fit_chain(x, vocabulary, {"toxic": toxic, "severe": _severe(x, vocabulary, marks, toxic)}, folds)


def score(df: DataFrame, text_col: str, chain: Chain) -> DataFrame:
    """Add ``p_<category>`` (double) and ``is_<category>`` (boolean) for each category of the chain."""
    fields = [T.StructField(f"p_{c}", T.DoubleType(), False) for c in chain.categories]
    schema = T.StructType([*df.schema.fields, *fields])
    held = df.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES features

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model = to_arrow_schema(schema), held.value
        counter = Counter(model.vocabulary)
        for batch in batches:
            _, ends = common.byte_rows(batch.column(batch.num_columns - 1))
            for start, stop in common.slices(ends):
                part = batch.slice(start, stop - start)
                p = model.probabilities(counter.values(part.column(batch.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])]], schema=arrow)

    out = df.select("*", common.utf8(text_col).alias("_ps_text")).mapInArrow(common.tidy(run), schema)
    return out.withColumns({f"is_{c}": F.col(f"p_{c}") >= float(t) for c, t in zip(chain.categories, chain.thresholds, strict=True)})
