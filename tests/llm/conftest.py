import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, repeated and long texts, with columns whose names the operators use themselves."""
    base = " ".join(f"word{i}" for i in range(60))
    edited = base.replace("word30 ", "other ")
    rows = [
        (1, base, "a", 3, "x"), (2, base, "a", 3, "y"), (3, edited, None, 4, None), (4, "", "b", 0, "z"), (5, None, "b", None, "z"),
        (6, "two words", "c", 9, "z"), (7, "TWO words", "c", 9, "z"), (8, " \n\t ", None, 4, "z"), (9, "!!!\nété naïve\n", "d", 1, "z"),
        (10, f"{base}\n{base}\nlast line of its own kind here", "d", 1, "z"), (None, base, "e", 2, "z"), (2, base, "a", 3, "y"),
        (11, " ".join(f"long{i % 5000}" for i in range(30_000)), "f", 1, "q"),
    ]
    schema = "doc_id bigint, text string, source string, n_chars bigint, sid string"
    return spark.createDataFrame(rows, schema)
