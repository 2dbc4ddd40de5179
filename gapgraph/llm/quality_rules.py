"""Quality rules: per-text counts and cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gapgraph.llm.common import GAPS, Stages, compact, part_count

#: A line is boilerplate on a host if it is in more distinct documents than both limits.
MIN_DOCS = 20
MAX_SHARE = 0.1
#: A document is depleted if fewer words stay, or a smaller share of them.
MIN_WORDS = 20
MIN_KEPT = 0.5
#: Words of a repeated window, and the percentage of words in such windows that fails a text.
WINDOW = 8
MAX_REPEAT = 30
#: Frequent lines of one host, and of all, up to which they are broadcast (8 bytes each); beyond it they are joined.
HOST_LINES = 256
BROADCAST_LINES = 1 << 19


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS, -1), "")


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in an 8-word window found twice or more, the first included.

    Window hashes come from three doublings of word hashes. Only if two are equal are they sorted
    with their places; the covered words are the steps between the places of repeated windows, of
    at most eight words each.
    """

    def doubled(arr: Column, by: int) -> Column:
        return _let(arr, lambda a: F.zip_with(F.slice(a, 1, F.size(a) - by), F.slice(a, by + 1, F.size(a) - by), lambda x, y: F.xxhash64(x, y)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def flags(p: Column) -> Column:
            n = F.size(p)
            same = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: a.h == b.h)
            either = _let(same, lambda s: F.zip_with(F.concat(s, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), s), lambda a, b: a | b))
            marked = F.zip_with(p, either, lambda a, b: F.struct(a.p.alias("p"), b.alias("f")))
            return F.sort_array(F.transform(F.filter(marked, lambda m: m.f), lambda m: m.p))

        def steps(d: Column) -> Column:
            after = F.concat(F.slice(d, 2, F.size(d) - 1), F.array(F.element_at(d, -1) + WINDOW))
            return F.aggregate(F.zip_with(d, after, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)

        return _let(_let(placed, flags), steps)

    hashes = doubled(doubled(doubled(F.transform(tokens, lambda w: F.xxhash64(w)), 1), 2), 4)
    repeated = _let(hashes, lambda o: F.when(F.size(F.array_distinct(o)) < F.size(o), covered(o)).otherwise(F.lit(0)))
    return F.when(F.size(tokens) < 2 * WINDOW - (WINDOW - 1), F.lit(0)).otherwise(repeated).cast("long")


def _text(docs: DataFrame, col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with ``text``."""
    with_words = rows.withColumn("_w", words(F.col("text")))
    worded = F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = with_words.select(
        *rows.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), GAPS, " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line_hash) of the lines above their host's limits; rows: doc_id, host, text.

    A document (a doc_id; the null ids of a host are one) counts once for a line, and copies of a text
    are documents of their own. Counting pre-aggregates before each shuffle; a frequent line of a hot host
    is one row for each document and task, spread by the document.
    """
    document = F.struct("doc_id")
    lines = rows.select("doc_id", "host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    lines = lines.select("doc_id", "host", normal_line(F.col("line")).alias("line")).filter("line <> ''").select("doc_id", "host", F.xxhash64("line").alias("line_hash"))
    sizes = rows.groupBy("host").agg(F.count_distinct(document).alias("_docs"))
    counts = lines.groupBy("host", "line_hash").agg(F.count_distinct(document).alias("_n")).filter(F.col("_n") > min_docs)
    return counts.join(sizes, "host").filter(F.col("_n") > max_share * F.col("_docs")).select("host", "line_hash")


def _with_places(rows: DataFrame, frequent: DataFrame, host_lines: int, broadcast_lines: int) -> DataFrame:
    """Adds to rows (doc_id, host, text, ...) the sorted ``places`` of boilerplate lines in the text, null if there are none.

    While all hosts' lines are few (a written table of counted size) they are broadcast, a list for each
    host, and nothing else moves. Beyond that the lines that are boilerplate are joined back by row.
    """
    many = frequent.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (many[0] or 0) <= host_lines and (many[1] or 0) <= broadcast_lines:
        lists = frequent.groupBy("host").agg(F.sort_array(F.collect_list("line_hash")).alias("_list"))
        found = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.when(F.array_contains(F.col("_list"), _line_hash(x)), i)), lambda i: i.isNotNull())
        joined = rows.join(F.broadcast(lists), "host", "left").withColumn("places", F.when(F.col("_list").isNotNull(), found)).drop("_list")
        return joined.withColumn("places", F.when(F.size("places") > 0, F.col("places")))
    lines = rows.select("doc_id", "host", F.xxhash64("text").alias("_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "host", "_hash", "pos", _line_hash(F.col("line")).alias("line_hash")).join(frequent, ["host", "line_hash"])
    places = lines.distinct().groupBy("doc_id", "host", "_hash").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), "_hash", "places")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.xxhash64("text") == F.col("_hash"))
    return rows.join(places, match, "left").drop("_id", "_host", "_hash")


def _judged(rows: DataFrame, frequent: DataFrame, host_lines: int, broadcast_lines: int) -> DataFrame:
    """Adds the base counts, places, n_boiler_words and kept."""
    counted = base_counts(_with_places(rows, frequent, host_lines, broadcast_lines))
    at_places = F.transform("places", lambda p: F.size(words(F.get(F.col("_l"), p))))
    removed = F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.aggregate(at_places, F.lit(0), lambda a, x: a + x)).cast("long")
    counted = counted.withColumn("_l", F.when(F.col("places").isNotNull(), _lines(F.col("text")))).withColumn("n_boiler_words", removed)
    left = F.col("n_words") - F.col("n_boiler_words")
    return counted.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= MIN_KEPT * F.col("n_words")))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, host_lines: int = HOST_LINES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, the base counts, base_failed, n_boiler_words and kept, one row per row.

    A null text is empty (no words, so it fails); a null host is the host ""; repeated rows get
    equal verdicts; an empty table gives no rows; other columns are not read. The text itself is
    not shuffled while the hosts' frequent lines are few.
    """
    rows = compact(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), _text(docs, text_col).alias("text")))
    frequent = Stages(docs.sparkSession, "quality").write(frequent_lines(rows, min_docs, max_share), "frequent", part_count(docs))
    return _judged(rows, frequent, host_lines, broadcast_lines).drop("text", "host", "places", "_l")


def _without(lines: Column, places: Column) -> Column:
    """``lines`` but for those at the sorted ``places``, in one walk: a text of flags says for each line whether it goes."""
    after = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.size(places) - 1))
    flags = F.array_join(F.zip_with(places, after, lambda p, before: F.concat(F.repeat(F.lit("0"), p - before - 1), F.lit("1"))), "").cast("binary")
    return _let(flags, lambda f: F.filter(lines, lambda _, i: F.substring(f, i + 1, F.lit(1)) != F.lit(b"1")))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, host_lines: int = HOST_LINES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, boilerplate lines removed from the text.

    Rows go if they fail the base rules or are depleted; so do null, empty and blank texts, which have
    too few words. A null host is the host ""; a null id is kept like any other; repeated rows stay or go
    together; an empty table gives no rows; other columns may have any name.
    """
    own = compact(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = own.select("_row", F.col("_row")[id_col].alias("doc_id"), F.coalesce(F.col("_row")[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")).alias("text"))
    frequent = Stages(docs.sparkSession, "quality").write(frequent_lines(rows.select("doc_id", "host", "text"), min_docs, max_share), "frequent", part_count(docs))
    kept = _judged(rows, frequent, host_lines, broadcast_lines).filter("kept")
    left = F.array_join(_without(F.col("_l"), F.col("places")), "\n")
    kept = kept.select("_row", F.when(F.col("places").isNull(), F.col("text")).otherwise(left).alias("_text"))
    return kept.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
