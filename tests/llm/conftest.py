import pytest

#: One of everything awkward: nulls, empties, a tie, repeated rows, very long texts, marks, non-ASCII.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the farm."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the farm."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a row without an id, and nothing else of note in it at all, not a thing"),
    (None, "another row without an id; it shares no more than five of the words in a row"),
    (6, "été ça où naïve – 中文字符 😀 " * 7),
    (7, "word " * 30_000),
    (8, "x" * 5000),
    (9, "12345 67890"),
    (9, "the same id but another text that is not short at all, to be sure of it"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string, shard string, size string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with awkward values, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None, "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
