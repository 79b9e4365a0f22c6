"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed per cell (source, language, topic).  Round after round the
cells' weights are scaled so that each dimension in turn has its target
marginals.  A document is kept with the probability (fitted / observed tokens of
its cell), scaled so that the largest is 1: kept tokens have the fitted marginals
in expectation.  The draw is a hash of the id, so it can be repeated.  DataFrame
functions only.

Targets of a dimension: a dict of weights (``other`` is the weight of values not
named), or a number a: observed share to the power a (1 keeps shares, 0 makes
them equal).

Defined results: NULL in a dimension is a value of its own, ``(none)``; a NULL or
empty text has no tokens and is drawn like the others of its cell, and kept if the
whole cell has none, as targets say nothing of it; repeated ids
share their draw; a NULL id draws as the empty string; an empty table gives an
empty table; other columns pass through (the new names must be free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: Cells that are broadcast at most; with more, documents are joined by a shuffle.
BROADCAST_CELLS = 100_000
SPACE = r"[\x20\x09-\x0D]+"

Target = dict[str, float] | float


def word_count(text_col: str) -> Column:
    """Words between white space (20, 09-0D)."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE, " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def length_topic(tokens: Column) -> Column:
    """A topic for tables without one: the length class."""
    return F.when(tokens < 200, "short").when(tokens < 1000, "medium").otherwise("long")


def _target(dim: str, spec: Target) -> Column:
    if isinstance(spec, dict):
        out = F.lit(float(spec.get("other", 0.0)))
        for value, weight in spec.items():
            if value != "other":
                out = F.when(F.col(dim) == value, float(weight)).otherwise(out)
        return out
    return F.pow(F.sum("t").over(Window.partitionBy(dim)), F.lit(float(spec)))


def fit(cells: DataFrame, targets: dict[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """Cells (dimensions, t) with ``w``: the fitted weight. Cells of weight 0 stay at 0."""
    out = cells.withColumn("w", F.col("t").cast("double"))
    for dim, spec in targets.items():
        out = out.withColumn(f"_ps_to_{dim}", _target(dim, spec))
    for _ in range(rounds):
        for dim in targets:
            total = F.sum("w").over(Window.partitionBy(dim))
            out = out.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"_ps_to_{dim}") / total).otherwise(0.0))
    return out.select(*targets, "t", "w")


def draw(id_col: str) -> Column:
    """A number in [0, 1) that follows from the id."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(df: DataFrame, id_col: str, tokens: Column, dims: dict[str, Column], targets: dict[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """Add ``tokens``, ``keep_prob``, ``kept``, and ``cell_<dimension>`` for each of ``dims``."""
    names = {f"cell_{d}": F.coalesce(c.cast("string"), F.lit("(none)")) for d, c in dims.items()}
    rows = df.withColumn("tokens", tokens).withColumns(names)
    cells = rows.groupBy(*names).agg(F.sum("tokens").alias("t")).where("t > 0")
    fitted = fit(cells, {f"cell_{d}": targets[d] for d in dims}, rounds).withColumn("_ps_ratio", F.col("w") / F.col("t"))
    # groupBy() without keys: one row of one maximum, and no window over all cells
    fitted = common.stage_table(fitted.select(*names, "_ps_ratio"), "cells")
    most = fitted.agg(F.max("_ps_ratio")).first()[0] or 1.0
    probs = fitted.select(*[F.col(n).alias(f"_ps_{n}") for n in names], F.round(F.col("_ps_ratio") / F.lit(most), 9).alias("_ps_prob"))
    if fitted.count() <= BROADCAST_CELLS:
        probs = F.broadcast(probs)
    on = [F.col(n) == F.col(f"_ps_{n}") for n in names]
    out = rows.join(probs, on, "left").withColumn("keep_prob", F.coalesce("_ps_prob", F.lit(1.0)))
    return out.withColumn("kept", draw(id_col) < F.col("keep_prob")).drop("_ps_prob", *[f"_ps_{n}" for n in names])


def sql(targets: dict[str, Target], rounds: int = ROUNDS) -> str:
    """The query over ``documents`` with dimensions source, lang and topic (length class) as DuckDB SQL."""
    flat = f"trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g'))"
    count = f"CASE WHEN {flat} = '' THEN 0 ELSE length({flat}) - length(replace({flat}, ' ', '')) + 1 END"
    steps = [
        f"d0 AS (SELECT doc_id, coalesce(source, '(none)') AS cell_source, coalesce(lang, '(none)') AS cell_lang, CAST({count} AS BIGINT) AS tokens FROM documents)",
        "d AS (SELECT *, CASE WHEN tokens < 200 THEN 'short' WHEN tokens < 1000 THEN 'medium' ELSE 'long' END AS cell_topic FROM d0)",
        "c AS (SELECT cell_source, cell_lang, cell_topic, sum(tokens)::DOUBLE AS t FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    marks = []
    for dim, spec in targets.items():
        if isinstance(spec, dict):
            cases = " ".join(f"WHEN cell_{dim} = '{v}' THEN {float(w)}::DOUBLE" for v, w in spec.items() if v != "other")
            marks.append(f"CASE {cases} ELSE {float(spec.get('other', 0.0))}::DOUBLE END" if cases else f"{float(spec.get('other', 0.0))}::DOUBLE")
        else:
            marks.append(f"pow(sum(t) OVER (PARTITION BY cell_{dim}), {float(spec)}::DOUBLE)")
    steps.append("w0 AS (SELECT *, t AS w, " + ", ".join(f"{m} AS to_{d}" for m, d in zip(marks, targets, strict=True)) + " FROM c)")
    k = 0
    for _ in range(rounds):
        for dim in targets:
            total = f"sum(w) OVER (PARTITION BY cell_{dim})"
            steps.append(f"w{k + 1} AS (SELECT * REPLACE (CASE WHEN {total} > 0 THEN w * to_{dim} / {total} ELSE 0 END AS w) FROM w{k})")
            k += 1
    steps.append(f"p AS (SELECT cell_source, cell_lang, cell_topic, round((w / t) / max(w / t) OVER (), 9) AS prob FROM w{k})")
    steps.append("j AS (SELECT d.*, coalesce(prob, 1.0) AS keep_prob FROM d LEFT JOIN p USING (cell_source, cell_lang, cell_topic))")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT doc_id, cell_source, cell_lang, cell_topic, tokens, round(keep_prob, 6) AS keep_prob,"
        " CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) / 4503599627370496.0 < keep_prob AS kept FROM j"
    )
