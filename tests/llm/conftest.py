import pytest

LONG = "lorem ipsum dolor " * 20_000

#: nulls, empty and very long texts, ties, repeated rows and columns named like those that operators use inside
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (2, None, None, None), (3, "", "en", "s2"), (4, " \n\t\n ", "en", "s2"), (None, "a text without a key", None, "s3"),
    (5, LONG, "la", "s1"), (6, "!!! 123 ...", "en", None), (7, "the quick brown fox jumps over the lazy dog again and again", "de", "s4"),
    (8, "Ünïcödé 中文 текст\nline two\nline two", "xx", "s1"),
]
CLASHES = ("key", "h", "fp", "text_hash", "row", "rank", "score", "spans", "items", "n_words", "chunk", "payload", "train", "id", "u", "v")


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
