"""Tolerant parsing of model answers with VARIANT, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapgraph.functions.text import trim_space

NO_MECHANISM = "mechanism not specified"
DEFAULT_SCORE = 0.5


def strip_fences(raw: Column) -> Column:
    """Without code fences anywhere and without one backtick at either end."""
    text = F.regexp_replace(raw, r"```(?:json|JSON)?", "")
    return trim_space(F.regexp_replace(trim_space(text), r"^`|`$", ""))


def _balanced(text: Column, left: str, right: str) -> Column:
    """From the first ``left`` to the mark that closes it, or null; marks inside strings count as well."""
    at = F.instr(text, left)
    tail = F.substr(text, at)
    # pieces that end in a mark each, so a step is taken for each mark and not for each character
    pieces = F.split(tail, rf"(?<=[\{left}\{right}])", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        mark, pos = F.right(piece, F.lit(1)), acc["pos"] + F.length(piece)
        depth = acc["depth"] + F.when(mark == left, 1).when(mark == right, -1).otherwise(0)
        return F.struct(depth.alias("depth"), pos.alias("pos"), F.when((acc["end"] == 0) & (depth == 0), pos).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.when(at > 0, F.when(end > 0, F.substr(tail, F.lit(1), end)))


def _parsed(answers: DataFrame) -> DataFrame:
    """With the parsed answer in _v; a generator keeps later filters from parsing again."""
    return answers.select("*", F.explode(F.array(parse_answer(F.col("raw")))).alias("_v"))


def first_json(text: Column) -> Column:
    """The first balanced object; if no brace opens one, the first balanced array; else the text."""
    return F.coalesce(_balanced(text, "{", "}"), _balanced(text, "[", "]"), text)


def parse_answer(raw: Column) -> Column:
    """VARIANT of the answer as it is, without fences, or of the first JSON in it; null if none parses."""
    bare = strip_fences(raw)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(bare), F.try_parse_json(first_json(bare)))


def _kind(v: Column) -> Column:
    k = F.schema_of_variant(v)
    return F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").otherwise("scalar")


def _name(item: Column, field: str, default: str) -> Column:
    """Text of a field: the default if it is not there, "None" for a JSON null."""
    at = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(at.isNull(), F.lit(default)).when(F.is_variant_null(at), F.lit("None")).otherwise(F.try_variant_get(item, f"$.{field}", "string"))


def _score(item: Column, field: str) -> Column:
    """Number of a field: 0.5 if it is not there, null if it is no number."""
    at = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(at.isNull(), F.lit(DEFAULT_SCORE)).otherwise(F.try_variant_get(item, f"$.{field}", "double"))


def parse_claims(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, failures) of answers with ``raw`` and ``source_paper``.

    claims: the answer's columns but raw, claim_ord, and the six claim fields. Items that are no
    objects or whose confidence is no number in [0, 1] are left out; an answer that is no object and no
    array is a failure.
    """
    keep = [c for c in answers.columns if c != "raw"]
    parsed = _parsed(answers).withColumn("_k", _kind(F.col("_v")))
    failed = parsed.filter(F.col("_v").isNull() | (F.col("_k") == "scalar")).select(*answers.columns)
    good = parsed.filter(F.col("_v").isNotNull() & (F.col("_k") != "scalar"))
    items = F.when(F.col("_k") == "array", F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.try_variant_get("_v", "$.claims", "array<variant>"))
    rows = good.select(*keep, F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("claim_ord", "_i")).filter(_kind(F.col("_i")) == "object")
    item = F.col("_i")
    claims = rows.select(
        *[c for c in keep if c != "source_paper"],
        "claim_ord",
        F.lower(trim_space(_name(item, "cause", ""))).alias("cause"),
        F.lower(trim_space(_name(item, "effect", ""))).alias("effect"),
        _score(item, "confidence").alias("confidence"),
        trim_space(_name(item, "mechanism", NO_MECHANISM)).alias("mechanism"),
        "source_paper",
        trim_space(_name(item, "evidence", "")).alias("evidence"),
    )
    return claims.filter(F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))), failed


def parse_hypotheses(answers: DataFrame, deterministic_ids: bool = False, accept_array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, failures) of answers with ``raw`` and ``gap`` (a gap struct); other columns are kept.

    An answer must be an object (with ``accept_array`` also an array whose first item is one) with
    both scores in [0, 1].
    """
    keep = [c for c in answers.columns if c not in ("raw", "gap")]
    parsed = _parsed(answers)
    if accept_array:
        parsed = parsed.withColumn("_v", F.coalesce(F.when(_kind(F.col("_v")) == "array", F.try_variant_get("_v", "$[0]", "variant")), F.col("_v")))
    v = F.col("_v")
    parsed = parsed.withColumn("_t", _score(v, "testability_score")).withColumn("_n", _score(v, "novelty_score"))
    ok = F.col("_v").isNotNull() & (_kind(v) == "object")
    for c in ("_t", "_n"):
        ok = ok & F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False))
    code = F.substring(F.sha2(F.concat_ws("|", F.col("gap.variable"), F.col("gap.gap_type")), 256), 1, 8) if deterministic_ids else F.substring(F.uuid(), 1, 8)
    out = parsed.filter(ok).select(
        *keep,
        F.concat(F.lit("H"), F.upper(code)).alias("id"),
        F.col("gap").alias("gap_addressed"),
        trim_space(_name(v, "hypothesis_text", "")).alias("hypothesis_text"),
        F.lower(trim_space(_name(v, "predicted_cause", ""))).alias("predicted_cause"),
        F.lower(trim_space(_name(v, "predicted_effect", ""))).alias("predicted_effect"),
        trim_space(_name(v, "predicted_mechanism", "")).alias("predicted_mechanism"),
        F.col("_t").alias("testability_score"),
        F.col("_n").alias("novelty_score"),
        trim_space(_name(v, "suggested_experiment", "")).alias("suggested_experiment"),
        trim_space(_name(v, "supporting_context", "")).alias("supporting_context"),
    )
    return out, parsed.filter(~ok).select(*answers.columns)
