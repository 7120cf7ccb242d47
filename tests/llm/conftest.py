import pytest


def pytest_collection_modifyitems(items):
    for item in items:
        if "/llm/" in str(item.fspath):
            item.add_marker(pytest.mark.filterwarnings("ignore::DeprecationWarning"))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with outputs."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    rows = [
        (1, base, "en", "a"), (2, base + " tail", "en", "a"), (2, base + " tail", "en", "a"), (3, None, None, None), (4, "", "en", ""), (5, " \n\t ", "en", "b"), (None, base, "en", "b"),
        (None, None, None, None), (6, long_text, "en", "b"), (7, long_text, "en", "b"), (8, "Ünïcode ŝigns — 漢字 😀 <|endoftext|> a b", "de", "c"), (9, "same", "en", None), (10, "same", "en", None),
        (11, "Released under the MIT License.", "en", "c"),
    ]
    wide = [(i, t, lang, s, None, -1, True, "x", 0, None, "y") for i, t, lang, s in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept boolean, w string, taken int, fp string, spans string"
    )


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
