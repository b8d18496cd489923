import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null and repeated ids, null, empty, blank, short and very long texts, exact and near copies, odd characters.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    (3, BASE), (1, BASE), (7, BASE.replace("word60", "other")), (2, None), (4, ""), (5, "   \n\t "), (None, "a row without an id"), (None, None), (8, "one"), (8, "one"), (9, "ONE"),
    (10, LONG), (11, LONG + " end"), (12, "tab\there\x00 null ▁ mark 👍🏽 é"), (13, "two words"), (14, "a b c d e"), (15, "a b c d e"), (16, BASE), (16, "another text with the same id as a copy"), (17, "line one.\nline two.\nline three."),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "src", None) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows under columns whose names the operators use themselves."""
    names = "score predicted ord range ahead cid n token comp msg text_ media ids sig z start".split()
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(1) for c in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
