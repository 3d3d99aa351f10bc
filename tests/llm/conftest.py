import pytest

TEXTS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One two\nthree four five six seven eight nine ten"),
    (6, "one two\nthree four five six seven eight nine ten"), (7, "x " * 4000), (8, "wörd ß 😀 \x00 end"), (9, "wörd ß 😀 \x00 end"), (9, "wörd ß 😀 \x00 end"),
    (None, "no id here"), (11, "a" * 5000),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if k % 3 else None, "src0", 0, "x", "y", 5) for k, (i, t) in enumerate(TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, group_size int"
    return spark.createDataFrame(rows, names)
