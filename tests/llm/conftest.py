import pytest

#: Texts with the cases every text operator has to define: null, empty, blank, repeated, long, and not ASCII.
TEXTS = [
    None, "", "   \n\t ", "one", "a b c", "Zażółć gęślą jaźń \U0001f600 'll x's 1234 !!? <|endoftext|> end",
    "same words again and again in a row here", "same words again and again in a row here",
    " ".join(f"w{i % 211}x{i // 7}" for i in range(6000)), "tail\r\n\r\nline  two\t\tthree",
]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with a null key, a repeated key and other columns whose names clash with results."""
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no key", None, None), (3, "one", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens long")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)
