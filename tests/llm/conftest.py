import pytest

LONG = "ein sehr langer text mit worten " * 4000
ROWS = [
    (1, "The cat sat on the mat. It was warm, and the day was long."),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, LONG),
    (6, "The cat sat on the mat. It was warm, and the day was long."),
    (6, "The cat sat on the mat. It was warm, and the day was long."),
    (7, "1234 !!"),
    (8, "é́ 日本語 \x00 \x1c <|endoftext|> don't  stop\r\n"),
    (None, "a row without an id"),
]


@pytest.fixture
def odd(spark):
    """Odd rows, with extra columns whose names clash with those used inside."""
    rows = [(*r, "en", "src", 1, 0.5, "x", 7) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, token string, shard int")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
