import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


LONG = " ".join(f"word{i % 700}x{i % 11}" for i in range(9000))
PASSAGE = " ".join(f"common{i}" for i in range(60))


def edge_rows():
    """Nulls, empty and blank texts, a very long one, copies, near copies, shared passages, odd characters."""
    base = " ".join(f"near{i}" for i in range(120))
    rows = [
        (None, "a text without a key " * 8), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one two three"), (5, LONG), (6, LONG),
        (7, base), (8, base), (9, base.replace("near3 ", "other ")), (9, base.replace("near3 ", "other ")), (10, "X " + base.upper()),
        (11, "begin " + PASSAGE + " end " + "pad " * 10), (12, "start " + PASSAGE + " stop"), (13, PASSAGE + " " + PASSAGE),
        (14, "ab" * 300), (15, "ünï¢ödé   x" * 20), (16, "a  b\n\n c\r\nd"), (17, "tie tie tie tie tie"), (18, "x" * 5000), (19, "the same\n" * 30), (20, "~!@#$%^&*|<>" * 12),
    ]
    return [(i, t, ("en", "de", None)[n % 3], ("s1", "s2", None, "")[n % 4], len(t or ""), "clash", 7) for n, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {}"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame(edge_rows(), SCHEMA.format("k string, size int"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA.format("b string, kept int"))
