import pytest

#: Rows that every operator must take: nulls, empty and blank texts, repeats, ties, and columns with names of its own.
EXTRA = "chunk long, content string, item binary, row int, line int, `group` string, tier int, value string, _row string, `a.b` string"


@pytest.fixture(scope="session")
def odd(spark):
    long = "word " * 40 + "\n" + "The quick brown fox jumps over the lazy dog near the river bank every single day of the year " * 30
    rows = [
        (1, "the cat sat on the mat and looked at the big red dog that ran over the green hill today", "s"),
        (1, "the cat sat on the mat and looked at the big red dog that ran over the green hill today", "s"),
        (2, "the cat sat on the mat and looked at the big red dog that ran over the green hill today", None),
        (None, "the cat sat on the mat and looked at the big red dog that ran over the green hill today", "s"),
        (3, None, "s"),
        (4, "", "s"),
        (5, " \n\t \n", None),
        (6, "one", "t"),
        (7, "one two", "t"),
        (8, long, "t"),
        (9, "naïve Ünïcode 😀 text\r\nwith lines\n\nand more", "t"),
        (None, None, None),
    ]
    return spark.createDataFrame([(i, t, "en", s, None, *([None] * 10)) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
