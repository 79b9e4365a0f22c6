"""License scans by canonical digest: texts are brought to one form, hashed, and hash-joined to known digests.

The form: A-Z lower-cased; copyright lines out; every run of characters that are
neither letters nor digits is one space; equivalent spellings are replaced word by
word.  DataFrame functions only.

Defined results: NULL and empty texts, and texts that are nothing but punctuation
or copyright lines, match nothing; repeated rows are scanned each; an empty table
gives an empty table; other columns pass through (the new names must be free).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Spellings that count as the same word, and the lines taken out.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("whilst", "while"), ("noncommercial", "non commercial")]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Known one-line notices, by identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]


def _bodies() -> list[tuple[str, str]]:
    """Whole license texts, from the files beside this module; a body with a title line is known without it as well."""
    out = []
    for path in sorted((Path(__file__).parent / "known").glob("*.txt")):
        name, text = path.stem, path.read_text()
        out.append((name, text))
        if name in ("MIT", "BSD-2-Clause", "BSD-3-Clause"):
            out.append((name, text.split("\n", 1)[1]))
    return out


#: Known texts: license bodies and notices.
KNOWN = [*_bodies(), *NOTICES]


def canonical(line: Column) -> Column:
    """The one form of a line."""
    out = F.translate(line, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for variant, word in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {word} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def forms(text: Column) -> Column:
    """The forms of a text's lines, without empty ones; the text's own form is these with spaces between."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical), lambda x: x != "")


def whole(lines: Column) -> Column:
    """SHA-256 of the text that has these line forms, NULL if there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " ").cast("binary"), 256))


def _known(df: DataFrame, known: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest): as many rows as the list has; the first of equal texts."""
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(i).alias("license_id"), F.lit(t).alias("text")) for k, (i, t) in enumerate(known)])
    table = df.sparkSession.range(1, numPartitions=1).select(F.inline(rows)).select("rank", "license_id", whole(forms(F.col("text"))).alias("_ps_known"))
    return table.groupBy("_ps_known").agg(F.min_by("license_id", "rank").alias("license_id"))


def scan(df: DataFrame, text_col: str, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """Add ``text_digest``, ``license_id`` (of the whole text), and of lines that are whole license texts: ``n_license_lines``, ``line_licenses``.

    Every line is brought to its form once; the whole text's form follows from them.
    ``known`` is broadcast: it is a literal list of the caller's, a few thousand texts
    at most; scan once per part of a longer list.
    """
    if len(known) > 5000:
        raise ValueError("more than 5,000 known texts: scan once per part of the list")
    common.free_names(df, "text_digest", "license_id", "n_license_lines", "line_licenses", "_ps_known", "_ps_lookup", "_ps_lines", "_ps_found")
    table = _known(df, known)
    # A map of all known digests as one row, so that lines are looked up without a row per line.
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("_ps_known", "license_id"))).alias("_ps_lookup"))
    out = df.withColumn("_ps_lines", forms(F.col(f"`{text_col}`").cast("string"))).withColumn("text_digest", whole(F.col("_ps_lines")))
    out = out.join(F.broadcast(table), F.col("text_digest") == F.col("_ps_known"), "left").drop("_ps_known").join(F.broadcast(lookup))
    found = F.filter(F.transform("_ps_lines", lambda x: F.try_element_at("_ps_lookup", F.sha2(x.cast("binary"), 256))), lambda x: x.isNotNull())
    out = out.withColumn("_ps_found", found).drop("_ps_lines", "_ps_lookup")
    return out.withColumns({"n_license_lines": F.size("_ps_found").cast("long"), "line_licenses": F.array_join(F.array_sort(F.array_distinct("_ps_found")), ",")}).drop("_ps_found")


def sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The query over ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINE)}, ' ', 'g')"
        x = f"' ' || regexp_replace({x}, {quote('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    rows = ", ".join(f"({k}, {quote(i)}, {quote(t)})" for k, (i, t) in enumerate(known))
    lines = lambda x: f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {form('l')}), lambda f: f <> '')"
    return f"""
WITH known AS (SELECT sha256(array_to_string(ls, ' ')) AS d, min_by(i, k) AS license_id FROM (SELECT k, i, {lines('t')} AS ls FROM (VALUES {rows}) v(k, i, t)) GROUP BY 1),
forms AS (SELECT doc_id, {lines('text')} AS fs FROM documents),
digests AS (SELECT doc_id, CASE WHEN len(fs) > 0 THEN sha256(array_to_string(fs, ' ')) END AS d, list_transform(fs, lambda f: sha256(f)) AS ds FROM forms),
looked AS (SELECT *, (SELECT map_from_entries(list((d, license_id))) FROM known) AS m FROM digests),
found AS (SELECT doc_id, d, list_filter(list_transform(ds, lambda x: m[x]), lambda x: x IS NOT NULL) AS l FROM looked)
SELECT found.doc_id, found.d AS text_digest, known.license_id, len(l)::BIGINT AS n_license_lines, array_to_string(list_sort(list_distinct(l)), ',') AS line_licenses
FROM found LEFT JOIN known ON found.d = known.d"""
