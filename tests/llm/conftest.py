import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_tokens int, kept double, bits string, predicted string"


def rows(*texts):
    """Documents with repeated rows, nulls in every column, and extra columns whose names clash."""
    made = [(i, t, "en", f"s{i % 2}", len(t or ""), "x", 1, 1.0, "y", "z") for i, t in enumerate(texts)]
    return made + made[:1] + [(None, "no id here", None, None, None, None, None, None, None, None)]


@pytest.fixture
def odd(spark):
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    return spark.createDataFrame(rows("plain words of a short text", None, "", " \n\t ", long, "x" * 20_000, "a  b　c \n\n d <|endoftext|> e", "tie one", "tie one", "é ß 日本 🎉"), SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
