import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, fp long, digest string, value string, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(15_000))
    texts = [
        (1, "Hello  World token = \"abcdef0123456789\" MIT License"), (2, "hello  world TOKEN = \"abcdef0123456789\" mit license"), (2, "hello  world TOKEN = \"abcdef0123456789\" mit license"),
        (3, None), (4, ""), (5, " \t\n "), (6, long), (7, long + " tail"), (8, "é▁日本 \x00 😀"), (None, "no id"), (None, None), (9, "a"), (10, "a"), (11, "A"),
    ]
    rows = [(k, t, None if i % 3 else "en", None if i % 4 == 3 else f"src{i % 4}", None if t is None else len(t), i, -i, i, None, "v", None) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
