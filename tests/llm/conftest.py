"""A small table with the awkward cases, and the test tables."""

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    rnd = random.Random(5)
    words = ["the", "of", "Zürich", "naïve", "data", "spark", "run", "code", "日本", "🙂", "x" * 40, "don't", "3.14"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 160))) for _ in range(40)]
    passage = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(60))
    out += [f"{out[k]}\n{passage}\n{out[k + 1]}" for k in range(6)]
    out += [out[3], out[3], None, "", " \n\t ", "one", "a b c d e", "a b c d e f", "the same " * 400, "y" * 3000, "ab" * 1500, "<|endoftext|> end  of   text\n\n", "\x00\x01 bytes\x85 and　space"]
    long = " ".join(rnd.choice(words) for _ in range(20_000))
    return [*out, long, long.replace("spark", "flink", 3)]


@pytest.fixture(scope="session")
def table(spark, texts):
    """doc_id with a NULL and a repeat, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None if t is None else len(t), k, "x", 1.0) for k, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1", 1, 0, None, None), (None, texts[8] + " tail", "de", "s2", 1, 0, "y", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, sig string, kept_score double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, table):
    return spark.createDataFrame([], table.schema)
