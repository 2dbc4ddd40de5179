"""Schemas of the engine's tables, and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GAP_TYPES = ("MISSING_CAUSE", "MISSING_EFFECT", "ISOLATED_NODE", "LOW_CONFIDENCE_CHAIN", "BROKEN_CHAIN")

PAPERS = "paper_ord BIGINT, source_paper STRING, content STRING"
PARAGRAPHS = "paper_ord BIGINT, source_paper STRING, chunk_ord INT, paragraph STRING"
COMPLETIONS = "paper_ord BIGINT, source_paper STRING, chunk_ord INT, attempt INT, raw STRING, status STRING"
CLAIM = "cause STRING, effect STRING, confidence DOUBLE, mechanism STRING, source_paper STRING, evidence STRING"
EDGE = "cause STRING, effect STRING, avg_confidence DOUBLE, paper_count INT, mechanisms ARRAY<STRING>, evidence_sentences ARRAY<STRING>"
GAP = "variable STRING, gap_type STRING, gap_score DOUBLE, neighboring_nodes ARRAY<STRING>, existing_edges ARRAY<STRING>, gap_explanation STRING"


def _struct(ddl: str) -> str:
    depth, parts, start = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return "STRUCT<" + ", ".join(p.replace(" ", ": ", 1) for p in parts) + ">"


HYPOTHESIS = (
    f"id STRING, gap_addressed {_struct(GAP)}, hypothesis_text STRING, predicted_cause STRING, predicted_effect STRING, predicted_mechanism STRING, "
    "testability_score DOUBLE, novelty_score DOUBLE, suggested_experiment STRING, supporting_context STRING"
)
DOCUMENT = (
    f"nodes ARRAY<STRING>, edges ARRAY<{_struct(EDGE)}>, claims ARRAY<{_struct(CLAIM)}>, papers_analyzed INT, gaps ARRAY<{_struct(GAP)}>, "
    f"hypotheses ARRAY<{_struct(HYPOTHESIS)}>, created_at STRING, model_used STRING"
)


def unit(col: str) -> Column:
    """A score in [0, 1]; null and NaN are not."""
    return F.coalesce(F.col(col).between(0.0, 1.0) & ~F.isnan(col), F.lit(False))


#: What a row of each table must meet.
RULES = {
    "claims": lambda: F.col("cause").isNotNull() & F.col("effect").isNotNull() & unit("confidence"),
    "edges": lambda: unit("avg_confidence") & (F.col("paper_count") >= 1),
    "gaps": lambda: F.col("gap_type").isin(*GAP_TYPES) & unit("gap_score"),
    "hypotheses": lambda: unit("testability_score") & unit("novelty_score"),
}


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a table."""
    ok = F.coalesce(RULES[table](), F.lit(False))
    return df.filter(ok), df.filter(~ok)
