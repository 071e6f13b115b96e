import pytest

#: Nulls, empty and blank texts, ties, repeated rows and one very long text.
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and runs away from it all day long."),
    (4, "The quick brown fox jumps over the lazy dog and runs away from it all day long."),
    (None, "Null id, don't lose it!"),
    (6, "Ünïcode çafé naïve £5 日本語 🎉 end"),
    (7, "word " * 30_000),
    (8, "<|endoftext|> special  text here"),
    (9, "x"),
    (10, "#### ||| $$$ !!!\n#### ||| $$$ !!!"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names operators would give to their own."""
    rows = [(i, t, "keep", n) for n, (i, t) in enumerate(ODD_TEXTS)]
    schema = "doc_id long, text string, Score string, position int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without any row."""
    return odd.limit(0)
