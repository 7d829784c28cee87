import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text), ...] or (doc_id, text, source)) with columns of clashing names beside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), None, None, None) for r in rows]
        return spark.createDataFrame(full, TEXT)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return docs_of([(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (6, long), (7, long), (7, long), (None, "no id"), (8, "é ü 字 " * 40, None), (9, "a a a a " * 300, None)])
