import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a null id, long text, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} stands here." for i in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It runs home again, quietly and fast. Then it sleeps.", "en", "s", 0, "x"),
        (2, "The quick brown fox jumps over the lazy dog. It runs home again, quietly and fast. Then it sleeps.", "en", "s", 0, "x"),
        (2, "The quick brown fox jumps over the lazy dog. It runs home again, quietly and fast. Then it sleeps.", "en", "s", 0, "x"),
        (3, None, None, None, None, None),
        (4, "", "en", "s", 0, "x"),
        (5, "  \n ", "en", "s", 0, "x"),
        (6, "one", "en", "s", 0, "x"),
        (7, "é" * 5000, "fr", "s", 0, "x"),
        (8, long, "en", "s", 0, "x"),
        (9, "mail a.b@mail7.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, 10.1.2.3", "en", "s", 0, "x"),
        (10, "again a.b@mail7.example.com here", "en", "s", 0, "x"),
        (None, "no id at all", "en", "s", 0, "x"),
        (12, "😀 <|endoftext|> ÀÉ \x00 中文", "zh", "s", 0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
