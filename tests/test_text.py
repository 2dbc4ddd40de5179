import re

import pytest
from pyspark.sql import functions as F

from gapgraph.functions import text


def values(spark, rows, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [tuple(r) for r in df.select(*exprs).collect()]


@pytest.mark.parametrize(
    ("raw", "name"),
    [("(  foo_bar).", " foo_bar"), ("-hdl-", "-hdl-"), ('"PM2.5"', "pm2.5"), (" X  y ", "x y"), ("a]", "a"), ("\\b^", "b"), ("( foo)", " foo"), ("", "")],
)
def test_node_name(spark, raw, name):
    assert values(spark, [raw], text.node_name(F.col("s"))) == [(name,)]


#: Texts and their paragraphs: blank lines part them, short ones go, long ones are cut at sentence ends.
GOLDENS = [
    ("", []),
    (" \n\n ", []),
    ("a" * 79, []),
    ("a" * 80, ["a" * 80]),
    ("a\r\n\r\n" + "b" * 90, ["b" * 90]),
    ("  one\t\t two \n three " + "c" * 80, ["one two   three " + "c" * 80]),
    ("d" * 90 + "\r\r" + "e" * 90, ["d" * 90, "e" * 90]),
    ("z" * 2500, ["z" * 2500]),
    ("F" + "f" * 1498 + ". G" + "g" * 998 + ". H" + "h" * 88 + ".", ["F" + "f" * 1498 + ".", "G" + "g" * 998 + ". H" + "h" * 88 + "."]),
    ("I" + "i" * 1990 + ". J" + "j" * 30 + ".", ["I" + "i" * 1990 + "."]),
]


def test_paragraphs(spark):
    assert [r[0] for r in values(spark, [raw for raw, _ in GOLDENS], text.paragraphs(F.col("s")))] == [want for _, want in GOLDENS]


def test_paragraphs_of_documents(spark, sf):
    """Bounds, order and cover over a whole table."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for raw, found in zip(texts, (r[0] for r in values(spark, texts, text.paragraphs(F.col("s")))), strict=True):
        squeezed, at = "".join(raw.split()), 0
        for p in found:
            assert len(p) >= 80 and p == p.strip() and "\n" not in p and "\t" not in p
            assert len(p) <= 2000 or not re.search(r"[.!?]\s[A-Z]", p)
            at = squeezed.index("".join(p.split()), at) + len("".join(p.split()))
        # what is left out are short pieces only
        assert sum(len(x) for x in found) or all(len(" ".join(x.split())) < 80 for x in raw.split("\n\n"))


def test_paragraphs_of_null(spark):
    df = spark.createDataFrame([(None,)], "s string").select(text.paragraphs(F.col("s")).alias("p"))
    assert df.collect()[0].p == []


def test_display_forms(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a"])], "many array<string>, one array<string>")
    row = df.select(text.some_of(F.col("many")), text.some_of(F.col("one")), text.arrow(F.lit("x"), F.lit("y")), text.shorten(F.lit("abcdef"), 3), text.fill("{a} and {b}, {c} {a}", a=F.lit("{b}"), b=F.lit("2"))).first()
    assert tuple(row) == ("a, b, c, ...", "a", "x → y", "abc", "{b} and 2, {c} {b}")


def test_sql_functions(spark):
    text.register(spark)
    long = "It was seen. " * 20
    assert spark.sql("SELECT node_name('(A  b).')").first()[0] == "a b"
    assert spark.createDataFrame([(long,)], "t string").selectExpr("paragraphs(t)").first()[0] == [long.strip()]
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM split_text('{long}')").collect()] == [(0, long.strip())]
