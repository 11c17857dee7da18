import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, digest INT, n_tokens STRING, piece STRING, class STRING, score STRING, features STRING, v INT, size STRING, list INT"
CLASH = ("clash", 1, "clash", "clash", "clash", "clash", "clash", 1, "clash", 1)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with every clashing column from (doc_id, text[, lang[, source]])."""
    def make(rows):
        full = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1]) if r[1] is not None else None,) + CLASH for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


LONG = "many words in a very long text without end " * 20_000

ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "The same text twice, the same text twice."), (5, "The same text twice, the same text twice."),
    (6, "one"), (6, "one"), (None, "A row without an id but with words in it"), (None, None), (7, LONG),
    (8, "日本語 and 😀 <|endoftext|> <s> \x00 \x1c x"), (9, "  two  blanks ▁ and\r\nlines\n\n"), (10, "123 456 !!!"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
