import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, content string"
TEXTS = [None, "", " \n\t", "one", "two words", "two words", "twowords", "A b c", "x" * 5000, "é" * 300 + " " + "y z " * 2000, "same text here", "same text here", "same  texthere", "é", "é", "<s> <|endoftext|> </s>", "a  b\n\n c\t", "😀 😀😀", "▁ x▁y"]


@pytest.fixture(scope="session")
def tricky(spark):
    """Null and repeated ids, null and odd values, whole rows that repeat, columns named like the operators' own."""
    rows = [(i, t, [None, "en", "", "é", "de"][i % 5], "s" if i % 3 else None, i if i % 4 else None, "a", "b", "c") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", None, None, None, None, None, None)] * 3 + [(3, "one", "en", "s", 1, "", "", "")] * 2 + [(-7, "same text here", "fr", "s", -1, "", "", "")]
    rows += [(None, "same text here", "fr", None, 2, "", "", "")] * 2
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
