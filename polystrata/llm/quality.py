"""Quality rules: a learned decision list over text statistics, as ordered Spark conditions.

Sequential covering: a rule is a conjunction of thresholds that is grown on two
thirds of the labelled rows (condition of most information gain, one after the
other), pruned on the rest, kept if it is precise enough there, and its rows are
taken out before the next rule is grown.  The list becomes
``CASE WHEN rule THEN false ... ELSE true END``.

The list is fitted on at most :data:`SAMPLE` labelled rows (those of smallest id
hash); everything else covers every row.

Defined results: NULL and empty texts have no words and fail the base rule; rows
with a NULL label or without a text are not learned from; of repeated labels of an
id the lowest counts; repeated rows are judged each; without labels of both kinds
there are no rules; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most labelled rows that the list is fitted on.
SAMPLE = 20_000

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_distinct", "n_lines", "n_bars"]

# Bytes counted as symbols, and white space.
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS_SYMBOL, _IS_SPACE = _class(_SYMBOLS), _class(_SPACE)
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if distinct < 1 << 21:
        keys = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    else:  # too many words for one number: name the pairs first
        _, pairs = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)
        keys = pairs[:-1] * distinct + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    covered = np.zeros(len(codes), bool)
    for k in (order[same], order[same + 1]):
        for j in range(3):
            covered[k + j] = True
    return int(covered.sum())


def _measure(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), len(STATISTICS)), np.int64)
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        if not words:
            continue
        raw = np.frombuffer(text, np.uint8)
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        counts = np.bincount(raw, minlength=256)
        row[:] = (
            len(words),
            counts[_STARTS_CHAR & ~_IS_SPACE].sum(),
            counts[_IS_SYMBOL].sum(),
            len(lines) - len(set(lines)),
            _repeated_words(codes, len(known)),
            counts[65:91].sum(),
            counts[48:58].sum(),
            len(known),
            len(lines),
            counts[124],
        )
    return out


_STATISTICS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATISTICS])


def _measured():
    fields = [pa.field(s, pa.int64()) for s in STATISTICS]

    def work(texts: pa.Array) -> pa.Array:
        found = _measure(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATISTICS))], fields=fields)

    return work


def statistics(df: DataFrame, text_col: str) -> DataFrame:
    """Add a struct ``_ps_stats`` of :data:`STATISTICS` of every whole text; only the text crosses to Python."""
    return df.withColumn("_ps_stats", common.arrow_column(_measured, _STATISTICS_TYPE)(common.utf8(text_col)))


def base_failed(stats: str = "_ps_stats") -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    s = F.col(stats)
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


#: What rules test: name, and (numerator, denominator) among the statistics.
RATIOS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "distinct": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _ratio(stats: Column, name: str) -> Column:
    top, bottom = RATIOS[name]
    value = stats.getField(top).cast("double")
    return value if bottom is None else value / F.greatest(stats.getField(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    """``ratio <= limit`` or ``ratio > limit``."""

    ratio: str
    above: bool
    limit: float

    def column(self, stats: Column) -> Column:
        value = _ratio(stats, self.ratio)
        return value > self.limit if self.above else value <= self.limit

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.ratio] > self.limit if self.above else table[self.ratio] <= self.limit


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """Condition of the largest FOIL gain over the rows given."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for name, values in table.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        for above in (False, True):
            p = (p0 - b[cut]) if above else b[cut]
            total = (len(v) - cut - 1) if above else cut + 1
            gain = p * (np.log2(np.maximum(p, 1e-9) / total) - before)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, folds: np.ndarray, most: int = 16, precision: float = 0.9, support: int = 3) -> list[Rule]:
    """Ordered rules for ``bad`` rows; ``folds`` (0, 1, 2): fold 0 prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    take = lambda rows: {k: v[rows] for k, v in table.items()}
    while len(rules) < most:
        grow, prune = left & (folds != 0), left & (folds == 0)
        rule: Rule = ()
        rows = grow.copy()
        while bad[rows].any() and not bad[rows].all() and len(rule) < 6:
            gain, condition = _best_condition(take(rows), bad[rows])
            if condition is None or gain <= 0:
                break
            rule += (condition,)
            rows &= condition.holds(table)
        if not rule:
            break
        held = take(prune)

        def worth(r: Rule) -> float:
            hit = _covers(r, held)  # noqa: B023
            p = int((hit & bad[prune]).sum())  # noqa: B023
            return (p + 0.5) / (hit.sum() + 1)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, take(left))
        right = int((hit & bad[left]).sum())
        if worth(rule) < precision - 0.15 or right < support or right < precision * hit.sum():
            break
        rules.append(rule)
        left[np.flatnonzero(left)[hit]] = False
    return rules


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[Rule]:
    """Learn rules for label 0 from at most :data:`SAMPLE` labelled rows that pass the base rule."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_ps_id")).agg(F.min(label_col).alias("_ps_label"))
    known = known.orderBy(F.xxhash64("_ps_id"), "_ps_id").limit(SAMPLE)
    rows = df.select(F.col(f"`{id_col}`").alias("_ps_id"), F.col(f"`{text_col}`").alias("_ps_body")).where("_ps_body IS NOT NULL")
    rows = statistics(rows.join(F.broadcast(known), "_ps_id"), "_ps_body").where(~base_failed())
    stats = F.col("_ps_stats")
    fold = (F.crc32(F.col("_ps_id").cast("string").cast("binary")) % 3).alias("fold")
    found = rows.select("_ps_id", F.col("_ps_label").alias("label"), fold, *[_ratio(stats, r).alias(r) for r in RATIOS])
    found = found.orderBy(F.xxhash64("_ps_id"), "_ps_id", *RATIOS).limit(2 * SAMPLE).toPandas()
    found = found.sort_values(["_ps_id", *RATIOS], kind="stable")
    bad = found["label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn({r: found[r].to_numpy(float) for r in RATIOS}, bad, found["fold"].to_numpy())


def verdict(rules: list[Rule], stats: str = "_ps_stats") -> Column:
    """The rules as one ordered conditional expression: false where a rule holds, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(F.col(stats))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(df: DataFrame, text_col: str, rules: list[Rule]) -> DataFrame:
    """Add the struct ``_ps_stats``, ``base_failed`` and ``kept`` (names that must be free)."""
    common.free_names(df, "_ps_stats", "base_failed", "kept")
    return statistics(df, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
