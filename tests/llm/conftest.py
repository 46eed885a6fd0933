import pytest

#: Edge rows: null, empty, blank, repeated, tied and clashing values.
COLUMNS = "doc_id long, text string, lang string, _id string, _text string, group_size int, node int"


@pytest.fixture(scope="session")
def edge(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(450))
    long = " ".join(f"word{i * i % 977}" for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three four"), (None, "one"),
        (6, passage), (7, "x" + passage + "y"), (8, long), (9, long), (10, "é" * 300 + "字" * 300),
        (11, "\x00\x1c\x85 a"), (12, "a\n\na\na"), (12, "other text with the same id"), (13, "W" * 5000),
    ]
    rows = [(i, t, None if i == 5 else "en", "clash", None, 1, None) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
