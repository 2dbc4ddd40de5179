"""Proportional stratified interleaving of rows into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapgraph.llm.common import Stages, compact

#: Rows that one sorted range should hold; it sets how far the work is split, not what comes out.
RANGE_ROWS = 1 << 18


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _sorted(rows: DataFrame, stages: Stages, name: str, parts: int, *by: str) -> DataFrame:
    """The rows, written, with ``part`` and ``idx``: the range of the sorted order that a row is in, and its place there."""
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id())
    return stages.write(ordered.select(*rows.columns, F.shiftright("_n", 33).cast("int").alias("part"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("idx")), name)


def interleave_shards(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Assigns every row to a shard so that each shard holds every source in proportion.

    Rows of a source are put in a seeded random order (md5 of seed, id and text checksum) and
    get the fraction (rank - 1/2) / rows of the source. All rows are then sorted by fraction
    (ties: source, then the random order) and the sorted list is cut into ``shards`` runs whose
    row counts differ by one at most. Both orders are sorts by ranges of all the sort columns and a row
    number, so a hot source, millions of sources of one row and repeats of a row are split alike; ranks are a
    row's place in its range plus the rows of the ranges before. Texts are read once and stay
    where they are: their size and checksum are written and sorted.

    Null ids, sources and texts count as empty strings in the order (null source is its own
    source ""); repeated rows each get a slot; an empty table gives no rows. Only the three
    named columns are read, so other columns can have any name.

    Returns id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (null), source.
    """
    stages = Stages(docs.sparkSession, "shards")
    rows = compact(docs).select(
        F.col(id_col).alias("doc_id"),
        _text(source_col).alias("source"),
        (F.octet_length(_text(text_col)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(_text(text_col)).alias("text_crc32"),
    ).withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))
    rows = stages.write(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    parts = max(8, total // range_rows)
    placed = _sorted(rows, stages, "by-source", parts, "source", "_key", "doc_id", "size", "_row")
    held = placed.groupBy("source", "part").agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("source", "part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("source")).alias("_rows"))
    ranked = placed.join(held, ["source", "part"]).withColumn("_frac", (2 * (F.col("_before") + F.col("idx") - F.col("_first") + 1) - 1) / (2 * F.col("_rows")))
    mixed = _sorted(ranked.select(*rows.columns, "_frac"), stages, "mixed", parts, "_frac", "source", "_key", "doc_id", "size", "_row")
    stages.drop("rows", "by-source")
    # one row for each range
    starts = mixed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = mixed.join(starts, "part").withColumn("_at", F.col("_start") + F.col("idx"))
    exact = F.expr(f"(_at * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(_shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return at.withColumn("_shard", exact).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
