import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, base int, found string, shard int, _id int, ids string"


def table(spark, texts, ids=None):
    """Documents of the given texts, with more columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None, 1, "k", 2, "f", 3, 4, "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None: table(spark, texts, ids)


@pytest.fixture(scope="session")
def odd_texts():
    return [None, "", "   \n\t ", "a", "word " * 30_000, "x" * 100_000, "same text here for all", "same text here for all", "é😀 ß 日本語", "  ", "1 2 3", "line\nline\nline", "\x00\x1c\x7f", "a  b   c\n\n d"]
