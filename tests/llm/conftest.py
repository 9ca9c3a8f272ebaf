import pytest

#: Rows that every operator on documents must survive: nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (None, "a document without an id"), (1, None), (2, ""), (3, "   \n\t "), (4, "x"),
    (5, "the same text here twice"), (6, "the same text here twice"), (6, "the same text here twice"),
    (7, "The SAME text here Twice"), (8, "word " * 30000), (9, "é" * 70000), (10, "nul \x00 and \u2028 marks"),
]


@pytest.fixture
def docs(spark):
    def make(rows, extra=True):
        """Documents with extra columns whose names clash with those that operators use."""
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        full = [(i, t, "en", "s", 1, "d", 1, 2, True, [3]) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n int, "
                                           "digest string, fp int, part int, kept boolean, ids array<int>")
    return make


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])
