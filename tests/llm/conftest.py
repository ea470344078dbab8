from __future__ import annotations

import pytest

WORDS = "stone river cloud apple winter garden silver candle market bridge forest window yellow copper saddle meadow".split()


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns whose names clash with results."""
    long_text = " ".join(WORDS[(i * i) % 16] + str(i % 7) for i in range(30_000))
    texts = [None, "", " \n\t", "a", "one two three four five six", "one two three four five six", "ONE two three four five six", long_text, "x" * 5_000, "naïve 日本語 🥰 ▁ text"]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "s1", 27), (None, "one two three four five six", None, None, None), (None, None, None, None, None)]
    return [(*r, -1.0, "mine", 7, "shard", 3, "p") for r in rows]


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, n_tokens int, shard string, epoch int, pieces string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session", params=[1_024, 4_096])
def confused(request):
    """Two different words that polynomial hashes modulo 2**64 take for one: the Thue-Morse word and its complement."""
    n = request.param
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))
