"""Text functions as Column expressions: paragraphs, names and display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of the shortest paragraph that is kept, and of the longest before it is cut at sentences (fixed values).
MIN_PARAGRAPH = 80
MAX_PARAGRAPH = 2000
#: ASCII punctuation but the hyphen, which may be part of a name's end (fixed values).
EDGE_PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"
#: A mechanism that holds one of these says nothing (fixed values).
PLACEHOLDERS = ("not specified", "unknown")


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_paragraph(p: Column) -> Column:
    """Runs of blanks and tabs made one blank, ends trimmed, then line breaks made blanks."""
    return F.regexp_replace(trim_space(F.regexp_replace(p, r"[ \t]+", " ")), "\n", " ")


def pack_sentences(p: Column, longest: int = MAX_PARAGRAPH, shortest: int = MIN_PARAGRAPH) -> Column:
    """Greedy packing of a paragraph's sentences into chunks of at most ``longest`` characters.

    A longer sentence is a chunk of its own; chunks shorter than ``shortest`` are dropped.
    """
    sentences = F.split(p, r"(?U)(?<=[.!?])\s+(?=[A-Z])", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + 1 + F.length(s) <= longest
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["out"].alias("out"), s.alias("cur")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.lit(" "), s).alias("cur")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), s.alias("cur")))
        )

    packed = F.aggregate(sentences, start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))
    return F.filter(F.transform(packed, trim_space), lambda c: F.length(c) >= shortest)


def paragraphs(text: Column, shortest: int = MIN_PARAGRAPH, longest: int = MAX_PARAGRAPH) -> Column:
    """The paragraphs of a text: blank-line pieces, cleaned, short ones dropped, long ones cut at sentences."""
    pieces = F.transform(F.split(unify_newlines(F.coalesce(text, F.lit(""))), "\n{2,}", -1), clean_paragraph)
    kept = F.filter(pieces, lambda p: F.length(p) >= shortest)
    return F.flatten(F.transform(kept, lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(pack_sentences(p, longest, shortest))))


def split_papers(papers: DataFrame, shortest: int = MIN_PARAGRAPH, longest: int = MAX_PARAGRAPH) -> DataFrame:
    """papers(paper_ord, source_paper, content) -> (paper_ord, source_paper, chunk_ord, paragraph)."""
    return papers.select("paper_ord", "source_paper", F.posexplode(paragraphs(F.col("content"), shortest, longest)).alias("chunk_ord", "paragraph"))


def node_name(c: Column) -> Column:
    """Lower case, trimmed, edge punctuation removed, inner white space collapsed (not trimmed again)."""
    return F.regexp_replace(F.btrim(trim_space(F.lower(c)), F.lit(EDGE_PUNCTUATION)), r"(?U)\s+", " ")


def is_placeholder(c: Column) -> Column:
    low = F.lower(c)
    found = F.contains(low, F.lit(PLACEHOLDERS[0]))
    for p in PLACEHOLDERS[1:]:
        found = found | F.contains(low, F.lit(p))
    return found


def arrow(cause: Column, effect: Column) -> Column:
    return F.concat(cause, F.lit(" → "), effect)


def some_of(items: Column, n: int = 3) -> Column:
    """The first n items, with an ellipsis if there are more than three."""
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(F.size(items) > 3, ", ...").otherwise(""))


def shorten(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def two_digits(c: Column) -> Column:
    return F.format_string("%.2f", c)


def fill(template: str, **values: Column) -> Column:
    """A text with each {name} of ``values`` replaced by its column, once: names inside a value stay."""
    parts = re.split("|".join(rf"(\{{{re.escape(name)}\}})" for name in values), template) if values else [template]
    return F.concat(*(values[x[1:-1]] if x[:1] == "{" and x[1:-1] in values else F.lit(x) for x in parts if x))


#: The functions above in SQL, for register().
_SPACE_ENDS = r"'(?U)^\\s+|\\s+$'"


def _node_name_sql() -> str:
    marks = EDGE_PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_replace(btrim(regexp_replace(lower(s), {_SPACE_ENDS}, ''), '{marks}'), '(?U)\\\\s+', ' ')"


def _paragraphs_sql() -> str:
    piece = f"regexp_replace(regexp_replace(regexp_replace(p, '[ \\\\t]+', ' '), {_SPACE_ENDS}, ''), '\\n', ' ')"
    pack = (
        "filter(transform(aggregate(split(q, '(?U)(?<=[.!?])\\\\s+(?=[A-Z])', -1), struct(cast(array() as array<string>) as out, cast(null as string) as cur), "
        "(a, x) -> CASE WHEN a.cur IS NULL THEN struct(a.out as out, x as cur) "
        f"WHEN length(a.cur) + 1 + length(x) <= {MAX_PARAGRAPH} THEN struct(a.out as out, concat(a.cur, ' ', x) as cur) "
        "ELSE struct(concat(a.out, array(a.cur)) as out, x as cur) END, a -> concat(a.out, array(a.cur))), "
        f"c -> regexp_replace(c, {_SPACE_ENDS}, '')), c -> length(c) >= {MIN_PARAGRAPH})"
    )
    pieces = f"filter(transform(split(regexp_replace(coalesce(s, ''), '\\r\\n?', '\\n'), '\\n{{2,}}', -1), p -> {piece}), p -> length(p) >= {MIN_PARAGRAPH})"
    return f"flatten(transform({pieces}, q -> CASE WHEN length(q) <= {MAX_PARAGRAPH} THEN array(q) ELSE {pack} END))"


def register(spark) -> None:
    """SQL functions node_name(s) and paragraphs(s), and the table function split_text(s)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION node_name(s STRING) RETURNS STRING RETURN {_node_name_sql()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION paragraphs(s STRING) RETURNS ARRAY<STRING> RETURN {_paragraphs_sql()}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION split_text(s STRING) RETURNS TABLE (chunk_ord INT, paragraph STRING) RETURN SELECT e.pos, e.col FROM (SELECT paragraphs(s) AS p) AS t, LATERAL posexplode(t.p) AS e")
