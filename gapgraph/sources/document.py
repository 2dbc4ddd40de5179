"""The graph document: one JSON object with nodes, edges, claims, gaps and hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gapgraph.schemas import CLAIM, DOCUMENT, EDGE, GAP, HYPOTHESIS
from gapgraph.stages import Stages

#: The arrays of a document, each with the fields of its elements and the column that orders them.
ARRAYS = {"nodes": (None, "node"), "edges": (EDGE, "edge_key"), "claims": (CLAIM, "claim_seq"), "gaps": (GAP, "gap_key"), "hypotheses": (HYPOTHESIS, "rank")}
HEAD = "papers_analyzed INT, created_at STRING, model_used STRING"


def _names(ddl: str) -> list[str]:
    depth, names, start = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            names.append(ddl[start:i].split()[0])
            start = i + 1
    return names


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The one-row document of a JSON file, with the document's schema."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def tables(document: DataFrame) -> dict[str, DataFrame]:
    """The document's arrays as tables, each with its position ``ord``."""
    out = {}
    for name in ("edges", "claims", "gaps", "hypotheses"):
        fields = document.select(F.posexplode(name).alias("ord", "x"))
        out[name] = fields.select("ord", "x.*")
    out["nodes"] = document.select(F.posexplode("nodes").alias("ord", "node"))
    return out


def _array(df: DataFrame | None, ddl: str | None, order: list[Column], alias: str) -> DataFrame | None:
    if df is None:
        return None
    value = F.struct(*_names(ddl)) if ddl else F.col("node")
    keyed = df.select(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("v")).alias("kv"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list("kv")), lambda x: x["v"]).alias(alias))


def to_document(spark: SparkSession, nodes=None, edges=None, claims=None, gaps=None, hypotheses=None, papers_analyzed: int = 0, created_at: str = "", model_used: str = "unknown") -> DataFrame:
    """One document row of tables. A table's order is its ``ord`` column, or the named columns of it."""

    def order(df: DataFrame | None, *names: str) -> list[Column]:
        if df is None:
            return []
        return [F.col("ord")] if "ord" in df.columns else [F.col(n) for n in names]

    parts = [
        ("nodes", _array(nodes, None, order(nodes, "node"), "nodes"), "array<string>"),
        ("edges", _array(edges, EDGE, order(edges, "edge_key"), "edges"), None),
        ("claims", _array(claims, CLAIM, order(claims, "claim_seq"), "claims"), None),
        ("gaps", _array(gaps, GAP, order(gaps, "gap_key"), "gaps"), None),
        ("hypotheses", _array(hypotheses, HYPOTHESIS, order(hypotheses, "rank"), "hypotheses"), None),
    ]
    out = spark.range(1).select(F.lit(papers_analyzed).alias("papers_analyzed"), F.lit(created_at).alias("created_at"), F.lit(model_used).alias("model_used"))
    for name, part, _ in parts:
        out = out.crossJoin(part) if part is not None else out.withColumn(name, F.lit(None))
    empty = spark.createDataFrame([], DOCUMENT)
    return out.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.from_json(F.lit("[]"), f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in empty.schema.fields])


def to_json(document: DataFrame) -> DataFrame:
    """The document as one text row, indented by two."""
    return document.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    """One JSON file: ``path`` itself if it ends in .json, else a text file in the folder ``path``, which must not exist.

    A document is one row by its form; write_parts() and write_tables() take what is too large for that.
    """
    if not path.endswith(".json"):
        to_json(document).coalesce(1).write.text(path)
        return
    spark = document.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(to_json(document).first()[0].encode()))
    finally:
        out.close()


def _piece(path: str, name: str) -> str:
    return f"{path}/{list(ARRAYS).index(name) + 1}-{name}"


def _write_text(spark: SparkSession, name: str, content: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_parts(spark: SparkSession, path: str, papers_analyzed: int = 0, created_at: str = "", model_used: str = "unknown", **arrays: DataFrame | None) -> None:
    """A document of any size in the folder ``path``, which must not exist: its text files, one after another by their paths, are one JSON object.

    Each array is a folder of sorted text files with an element a line, all but the first after a comma; what
    stands before an array is a file of its own. No task holds more than its lines.
    """
    if unknown := set(arrays) - set(ARRAYS):
        raise ValueError(f"no arrays of a document: {', '.join(sorted(unknown))}")
    head = spark.createDataFrame([(papers_analyzed, created_at, model_used)], HEAD)
    before = to_json_line(head, F.struct("*")).first()[0][:-1] + "\n"
    for name, (ddl, key) in ARRAYS.items():
        _write_text(spark, f"{_piece(path, name)}-0", f'{before},"{name}":[\n')
        before = "]"
        df = arrays.get(name)
        if df is None:
            continue
        rows = df.orderBy("ord" if "ord" in df.columns else key)
        line = to_json_line(rows, F.struct(*_names(ddl)) if ddl else F.col("node"))
        # the first row of the first task is the array's first: ranges of a sort have rows as long as there are any
        comma = F.when(F.monotonically_increasing_id() == 0, "").otherwise(",")
        line.select(F.concat(comma, "value").alias("value")).write.option("lineSep", "\n").text(f"{_piece(path, name)}-1")
    _write_text(spark, f"{path}/{len(ARRAYS) + 1}-end", "]}\n")


def to_json_line(df: DataFrame, value: Column) -> DataFrame:
    """A value of each row as one line of JSON."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return df.select(F.substring(text, F.lit(2), F.length(text) - 2).alias("value"))


def read_head(spark: SparkSession, path: str) -> DataFrame:
    """The one row of what a document in parts says besides its arrays."""
    lines = spark.read.text(f"{_piece(path, next(iter(ARRAYS)))}-0", lineSep="\n").filter("value like '{%'")
    return lines.select(F.from_json(F.concat("value", F.lit("}")), HEAD, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_parts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The arrays of a document that write_parts() wrote, as tables, each with its position ``ord``; a broken element is an error.

    Lines are parsed where they are read and written once as tables; a line's position is that in its block
    of a file and the lines of the blocks before.
    """
    fs, stages, out = spark._jvm.org.apache.hadoop.fs, Stages(spark, "parts"), {}
    for name, (ddl, _) in ARRAYS.items():
        where = fs.Path(f"{_piece(path, name)}-1")
        kind = spark.createDataFrame([], DOCUMENT).schema[name].dataType
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            value = F.from_json(F.concat(F.lit("["), F.ltrim("value", F.lit(",")), F.lit("]")), kind, {"mode": "FAILFAST"})[0]
            place = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
            rows = stages.write(spark.read.text(where.toString(), lineSep="\n").select(*place, value.alias("x")), name)
            blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
            before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
            blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
            rows = rows.join(F.broadcast(blocks), ["file", "block"]).select((F.col("line") + F.col("shift")).alias("ord"), "x")
        else:
            rows = spark.createDataFrame([], f"ord long, x {kind.elementType.simpleString()}")
        out[name] = rows.select("ord", "x.*") if ddl else rows.select("ord", F.col("x").alias("node"))
    return out


def write_tables(parts: dict[str, DataFrame], path: str) -> None:
    """Nodes, edges, claims, gaps and hypotheses as Parquet tables under ``path``, each written by all its tasks."""
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "claims", "gaps")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
