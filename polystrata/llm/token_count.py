"""Token counts: pieces per distinct pre-token, joined to per-document pre-token frequencies.

No ids are made for documents: every distinct pre-token of the corpus is handed
to the tokenizer once, its number of pieces is joined to the postings of that
pre-token (a hash join within the bucket of pre-tokens that a task gets), and
frequency times pieces is summed per document.

Defined results: NULL and empty texts count 0; repeated rows are counted each;
an empty table gives an empty table; strings of added tokens inside a text count
as the library's default has it, as one token each; NULL ids pass through.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _splitter(path: str, pattern: str):
    """Text bytes -> pre-tokens, with added tokens cut out first as the library does."""
    import regex

    added = _tokenizer(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    find = regex.compile(pattern).findall
    names = sorted((t.content for t in added), key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def split(raw: bytes) -> list[str]:
        text = raw.decode("utf-8", "replace")
        if cut is None or not any(name in text for name in names):
            return find(text)
        out: list[str] = []
        for k, part in enumerate(cut.split(text)):
            out += [part] if k % 2 else find(part)
        return out

    return split


def _piece_counter(path: str):
    """Distinct pre-tokens -> pieces of each."""
    tokenizer = _tokenizer(path)

    def count(terms: list[bytes], _: np.ndarray) -> np.ndarray:
        words = [t.decode() for t in terms]
        sizes = [len(e.ids) for low in range(0, len(words), 2000) for e in tokenizer.encode_batch_fast(words[low : low + 2000], add_special_tokens=False)]
        return np.array(sizes, float)[:, None]

    return count


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every whole text, for a byte-level BPE tokenizer file.

    ``pattern`` is the file's pre-tokenization; ``path`` must be readable on the executors.
    """
    packed = postings.build(df, id_col, text_col, lambda: _splitter(path, pattern))
    sums = postings.value_terms(packed, lambda: _piece_counter(path), 1)
    docs = postings.sum_blocks(sums, df.schema[id_col].dataType, ["pieces"])
    return docs.select(F.col("id").alias(id_col), "n_bytes", F.col("pieces").cast("long").alias("n_tokens"))
