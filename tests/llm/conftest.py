import pytest
from invented import prose

CLASHING = ["score", "label", "part", "tie", "row", "kept", "set", "size", "token", "n", "raw", "predicted"]


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=False):
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            for i, name in enumerate(CLASHING):
                table = table.selectExpr("*", f"{i} AS {name}")
        return table

    return docs


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows and ids, a long text, odd characters."""
    long = prose(7, 30_000)
    return [
        (1, prose(1, 60)), (1, prose(1, 60)), (1, prose(2, 40)), (2, None), (None, prose(3, 50)), (None, None),
        (3, ""), (4, " \n\t "), (5, "one"), (6, "one"), (7, "a b c d"), (8, long), (9, prose(1, 60)),
        (10, "  日本語 𝄞 ▁x\u0000y"), (11, "é" * 50), (12, "\n".join(["same line"] * 30)), (13, "!!! ??? ###"),
    ]
