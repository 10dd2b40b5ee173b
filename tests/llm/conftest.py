import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k0 string, key string, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = "The anthon of the erhan. " * 3000
    rows = [
        (1, "The quick erthan idiot you are.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", "b"),
        (4, long, "en", None),
        (5, "Le aiment éreau du les.", "fr", "b"),
        (5, "Le aiment éreau du les.", "fr", "b"),
        (None, "Der achlich und die.", None, "c"),
        (7, "12345 !!! \t\n", None, "c"),
        (8, "one two", "en", "a"),
        (9, "ONE  two", "en", "a"),
        (10, long + "x", "en", "a"),
        (11, "nul\0 and ퟿ emoji 🤖 ▁mark", None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def texts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
