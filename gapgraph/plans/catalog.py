"""Registered queries of the engine, and for each that SQL can express its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapgraph import prompts as P, report
from gapgraph.functions import jsonparse, text
from gapgraph.functions.scoring import composite_score
from gapgraph.operators import gaps as G, hypotheses as H, merge
from gapgraph.operators.claims import dedup_within_paper, extract_claims
from gapgraph.operators.completion import OfflineClient
from gapgraph.operators.graph import KnowledgeGraph, build_graph, cycle_edges, graph_nodes
from gapgraph.plans.mapping import MIN_PAPERS, claims_from_events, claims_sql, edges_sql, events, gaps_sql, graph_sql
from gapgraph.schemas import validate
from gapgraph.sources.corpus import from_table, from_texts, load_directory, load_files
from gapgraph.sources.document import read_parts, to_document
from gapgraph.stages import Stages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _claims(spark: SparkSession, sf_dir: str, base: int = 0) -> DataFrame:
    return claims_from_events(events(spark, sf_dir), base)


def _edges(spark: SparkSession, sf_dir: str, base: int = 0, min_confidence: float = 0.0) -> DataFrame:
    """The filtered edges without their texts."""
    counts = merge.merge_counts(merge.normalize_claims(_claims(spark, sf_dir, base)))
    return merge.filter_edges(counts, min_confidence, MIN_PAPERS)


def _graph(spark: SparkSession, sf_dir: str, base: int = 0, min_confidence: float = 0.0) -> KnowledgeGraph:
    stages = Stages(spark, "query-graph")
    edges = stages.write(_edges(spark, sf_dir, base, min_confidence), "edges")
    dag = stages.write(edges.join(cycle_edges(edges), ["cause", "effect"], "left_anti"), "dag")
    return KnowledgeGraph(edges, dag, graph_nodes(edges), _claims(spark, sf_dir, base))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return G.detect_gaps(graph.dag, graph.nodes)


def _literal(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def _list(c: str) -> Column:
    return F.array_join(c, "|")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to claims, edges, an acyclic graph and its scored gaps."""
    gaps = _gaps(spark, sf_dir)
    return gaps.select("variable", "gap_type", F.round("gap_score", 6).alias("gap_score"), _list("neighboring_nodes").alias("neighbours"), "gap_explanation")


# names and texts


@_query(f"WITH {claims_sql()} SELECT claim_seq, n_cause AS cause, n_effect AS effect FROM claims")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.normalize_claims(_claims(spark, sf_dir)).select("claim_seq", "cause", "effect")


_PIECES = r"""
pieces AS (SELECT doc_id, replace(trim(regexp_replace(p, '[ \t]+', ' ', 'g'), E' \n\t\r\x0b\x0c'), E'\n', ' ') AS p FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace({text}, '\r\n?', E'\n', 'g'), '\n{{2,}}')) AS p FROM documents)),
kept AS (SELECT doc_id, p FROM pieces WHERE length(p) >= 80)"""


@_query(f"WITH {_PIECES.format(text="replace(text, E'\\n', E'\\n\\n')")} SELECT doc_id, count(*) AS n_paragraphs, sum(length(p))::BIGINT AS n_chars, max(length(p))::BIGINT AS longest FROM kept GROUP BY doc_id")
def split_paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line pieces of texts whose lines are taken as paragraphs, before long ones are cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    papers = from_table(docs)
    rows = text.split_papers(papers, longest=1 << 30)
    return rows.groupBy(F.col("paper_ord").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("paragraph")).cast("long").alias("n_chars"), F.max(F.length("paragraph")).cast("long").alias("longest"))


_PACKED = r"""
sentences AS (SELECT doc_id, p, string_split(regexp_replace(p, '([.!?])\s+([A-Z])', E'\\1\x01\\2', 'g'), E'\x01') AS s FROM kept WHERE length(p) > 2000),
packed AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {'o': []::VARCHAR[], 'c': x}), lambda a, b: CASE WHEN length(a.c) + 1 + length(b.c) <= 2000 THEN {'o': a.o, 'c': a.c || ' ' || b.c} ELSE {'o': list_append(a.o, a.c), 'c': b.c} END) AS r FROM sentences),
chunks AS (SELECT doc_id, p AS chunk FROM kept WHERE length(p) <= 2000 UNION ALL SELECT doc_id, trim(unnest(list_append(r.o, r.c))) FROM packed)"""


@_query(f"WITH {_PIECES.format(text='text')}, {_PACKED} SELECT doc_id, md5(chunk) AS chunk_md5, length(chunk) AS n_chars FROM chunks WHERE length(chunk) >= 80")
def split_long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of whole texts, long ones cut at sentences and packed."""
    papers = from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return text.split_papers(papers).select(F.col("paper_ord").alias("doc_id"), F.md5("paragraph").alias("chunk_md5"), F.length("paragraph").cast("long").alias("n_chars"))


@_query(f"WITH {_PIECES.format(text='text')}, {_PACKED} SELECT doc_id, md5(replace({_literal(P.EXTRACT)}, '{{paragraph}}', chunk)) AS prompt_md5 FROM chunks WHERE length(chunk) >= 80")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each paragraph of whole texts."""
    papers = from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    prompt = text.fill(P.EXTRACT, paragraph=F.col("paragraph"))
    return text.split_papers(papers).select(F.col("paper_ord").alias("doc_id"), F.md5(prompt).alias("prompt_md5"))


# answers


def _answers(spark: SparkSession, sf_dir: str, damaged: bool) -> DataFrame:
    """Model-like answers of the mapped claims: plain, fenced and in prose; every tenth broken if ``damaged``."""
    rows = _claims(spark, sf_dir)
    item = F.to_json(F.struct("cause", "effect", "confidence", "mechanism", "evidence"))
    body = F.when(F.col("claim_ord") % 2 == 0, F.concat(F.lit('{"claims": ['), item, F.lit("]}"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), F.lit('{"claims": ['), item, F.lit("]} as asked."))
    raw = F.when(F.col("claim_ord") % 5 == 1, fenced).when(F.col("claim_ord") % 5 == 2, prose).otherwise(body)
    if damaged:
        raw = F.when(F.col("claim_ord") % 10 == 0, F.substr(raw, F.lit(1), F.length(raw) - 5)).when(F.col("claim_ord") % 10 == 5, F.lit("no claims here")).otherwise(raw)
    return rows.select("paper_ord", F.col("claim_ord").alias("answer"), "source_paper", raw.alias("raw"))


@_query(f"WITH {claims_sql()} SELECT claim_ord AS answer, lower(trim(cause)) AS cause, lower(trim(effect)) AS effect, cents / 100.0::DOUBLE AS confidence, trim(mechanism) AS mechanism, trim(evidence) AS evidence, source_paper FROM claims")
def parse_claims_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = jsonparse.parse_claims(_answers(spark, sf_dir, damaged=False))
    return claims.select("answer", "cause", "effect", "confidence", "mechanism", "evidence", "source_paper")


@_query(f"WITH {claims_sql()} SELECT claim_ord AS answer, CASE WHEN claim_ord % 5 = 0 THEN 'failed' ELSE 'claim' END AS outcome FROM claims")
def parse_claims_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, failed = jsonparse.parse_claims(_answers(spark, sf_dir, damaged=True))
    return claims.select("answer", F.lit("claim").alias("outcome")).unionByName(failed.select("answer", F.lit("failed").alias("outcome")))


@_query("SELECT event_id AS answer, 'HYPOTHESIS ' || event_id AS hypothesis_text, 'k' || (event_id % 7) AS predicted_cause, 'user ' || user_id AS predicted_effect, (event_id % 11) / 10.0::DOUBLE AS testability_score, 0.5::DOUBLE AS novelty_score FROM events")
def hypothesis_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event; the novelty score is missing and so 0.5."""
    e = F.col("event_id")
    fields = F.struct(F.concat(F.lit(" HYPOTHESIS "), e.cast("string")).alias("hypothesis_text"), F.concat(F.lit("K"), (e % 7).cast("string"), F.lit(" ")).alias("predicted_cause"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("predicted_effect"), ((e % 11) / 10.0).alias("testability_score"))
    gap = F.struct(F.lit("x").alias("variable"), F.lit("ISOLATED_NODE").alias("gap_type"), F.lit(0.5).alias("gap_score"), F.array().cast("array<string>").alias("neighboring_nodes"), F.array().cast("array<string>").alias("existing_edges"), F.lit("").alias("gap_explanation"))
    raw = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(fields), F.lit("\n```"))).otherwise(F.to_json(fields))
    good, _ = jsonparse.parse_hypotheses(events(spark, sf_dir).select(e.alias("answer"), gap.alias("gap"), raw.alias("raw")), deterministic_ids=True)
    return good.select("answer", "hypothesis_text", "predicted_cause", "predicted_effect", "testability_score", "novelty_score")


# claims and edges


@_query(
    f"""WITH {claims_sql()}, best AS (SELECT *, row_number() OVER (PARTITION BY paper_ord, n_cause, n_effect ORDER BY cents DESC, claim_ord) AS rn, min(claim_ord) OVER (PARTITION BY paper_ord, n_cause, n_effect) AS first_ord FROM claims)
SELECT paper_ord, first_ord, n_cause AS cause, n_effect AS effect, cents / 100.0::DOUBLE AS confidence, evidence FROM best WHERE rn = 1"""
)
def dedup_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = merge.normalize_claims(_claims(spark, sf_dir)).drop("claim_seq")
    return dedup_within_paper(claims).select(F.col("claim_seq.paper_ord").alias("paper_ord"), F.col("claim_seq.claim_ord").alias("first_ord"), "cause", "effect", "confidence", "evidence")


@_query(f"WITH {edges_sql()} SELECT cause, effect, avg_confidence, paper_count, q AS first_claim FROM edges")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = merge.merge_counts(merge.normalize_claims(_claims(spark, sf_dir)))
    return counts.select("cause", "effect", "avg_confidence", F.col("paper_count").cast("long").alias("paper_count"), F.col("edge_key.q").alias("first_claim"))


_TEXTS = "once AS (SELECT cause, effect, v, q, row_number() OVER (PARTITION BY cause, effect, {key} ORDER BY q) AS rn FROM (SELECT n_cause AS cause, n_effect AS effect, trim({col}) AS v, claim_seq AS q FROM claims {where}) WHERE v <> '') SELECT cause, effect, string_agg(v, '|' ORDER BY q) AS {name} FROM once WHERE rn = 1 GROUP BY 1, 2"


@_query(f"WITH {claims_sql()}, " + _TEXTS.format(key="lower(v)", col="mechanism", where="WHERE lower(mechanism) NOT LIKE '%not specified%' AND lower(mechanism) NOT LIKE '%unknown%'", name="mechanisms"))
def merge_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_mechanisms(merge.normalize_claims(_claims(spark, sf_dir))).withColumn("mechanisms", _list("mechanisms"))


@_query(f"WITH {claims_sql()}, " + _TEXTS.format(key="v", col="evidence", where="", name="evidence"))
def merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_evidence(merge.normalize_claims(_claims(spark, sf_dir))).select("cause", "effect", _list("evidence_sentences").alias("evidence"))


@_query(f"WITH RECURSIVE {graph_sql(30, 0.5)} SELECT cause, effect, avg_confidence, paper_count FROM fe")
def filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, 30, 0.5).select("cause", "effect", "avg_confidence", F.col("paper_count").cast("long").alias("paper_count"))


@_query(f"WITH {claims_sql()} SELECT count(DISTINCT source_paper) AS papers_analyzed FROM claims")
def papers_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).agg(F.count_distinct("source_paper").alias("papers_analyzed"))


@_query(f"WITH {claims_sql()}, scored AS (SELECT claim_seq, (cents - 40) / 50.0::DOUBLE AS confidence FROM claims) SELECT claim_seq, confidence, confidence BETWEEN 0 AND 1 AS valid FROM scored")
def validate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose confidences are stretched beyond 0 and 1, told apart by the rules of their table."""
    stretched = merge.normalize_claims(_claims(spark, sf_dir)).withColumn("confidence", (F.round(F.col("confidence") * 100) - 40) / 50.0)
    good, bad = validate(stretched, "claims")
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).select("claim_seq", "confidence", "valid")


# graph


@_query(f"WITH RECURSIVE {graph_sql()}, n AS (SELECT cause AS node, 2 * eo AS o FROM fe UNION ALL SELECT effect, 2 * eo + 1 FROM fe) SELECT node, row_number() OVER (ORDER BY min(o)) AS node_ord FROM n GROUP BY node")
def graph_nodes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return graph_nodes(_edges(spark, sf_dir)).select("node", F.row_number().over(Window.orderBy("node_key")).cast("long").alias("node_ord"))


@_query(f"WITH RECURSIVE {graph_sql()} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT effect AS node, 1 AS i, 0 AS o FROM dag UNION ALL SELECT cause, 0, 1 FROM dag) GROUP BY node")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_graph(spark, sf_dir).dag)


@_query(
    f"""WITH RECURSIVE {graph_sql()}, roles AS (SELECT effect AS node, cause AS other, 0 AS role, eo FROM dag UNION ALL SELECT cause, effect, 1, eo FROM dag)
SELECT node, coalesce(string_agg(other, '|' ORDER BY eo) FILTER (role = 0), '') AS parents, coalesce(string_agg(other, '|' ORDER BY eo) FILTER (role = 1), '') AS children FROM roles GROUP BY node"""
)
def parents_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = G.node_profile(_graph(spark, sf_dir).dag)

    def side(role: int) -> Column:
        return F.array_join(F.transform(F.filter("ties", lambda t: t["role"] == role), lambda t: t["other"]), "|")

    return profile.select("node", side(0).alias("parents"), side(1).alias("children"))


@_query(f"WITH RECURSIVE {graph_sql()} SELECT u AS cause, v AS effect FROM gone")
def cycle_removed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_edges(Stages(spark, "edges").write(_edges(spark, sf_dir), "edges"))


@_query(f"WITH RECURSIVE {graph_sql(30, 0.5)} SELECT cause, effect, avg_confidence FROM dag")
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, 30, 0.5).dag.select("cause", "effect", "avg_confidence")


@_query(f"WITH RECURSIVE {gaps_sql()} SELECT (SELECT count(DISTINCT source_paper) FROM claims) AS papers, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM nord) AS nodes, (SELECT count(*) FROM fe) AS edges, (SELECT count(*) FROM gaps) AS gaps")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    parts = [graph.claims.agg(F.count_distinct("source_paper").alias("papers"), F.count(F.lit(1)).alias("claims"))]
    parts += [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("gaps", G.detect_gaps(graph.dag, graph.nodes)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


_COMPONENTS = """
pairs AS (SELECT cause AS u, effect AS v FROM dag UNION SELECT effect, cause FROM dag),
reach(u, v) AS (SELECT u, u FROM pairs UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON pairs.u = reach.v),
comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY u)"""


@_query(
    f"""WITH RECURSIVE {graph_sql(30, 0.5)}, {_COMPONENTS},
ties AS (SELECT DISTINCT effect AS node, cause AS other FROM edges UNION SELECT DISTINCT cause, effect FROM edges)
SELECT ties.node AS variable, 'BROKEN_CHAIN' AS gap_type FROM ties JOIN comp ON comp.node = ties.other GROUP BY ties.node HAVING count(DISTINCT component) >= 2"""
)
def broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = merge.merge_counts(merge.normalize_claims(_claims(spark, sf_dir, 30)))
    return G.broken_chains(every, _graph(spark, sf_dir, 30, 0.5).dag)


# gaps


def _gap_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _gaps(spark, sf_dir).filter(F.col("gap_type") == kind).select("variable", F.round("gap_score", 6).alias("gap_score"))

    run.__name__ = "gaps_" + kind.lower()
    _query(f"WITH RECURSIVE {gaps_sql()} SELECT variable, round(gap_score, 6) AS gap_score FROM gaps WHERE gap_type = '{kind}'")(run)


for _kind in ("MISSING_CAUSE", "MISSING_EFFECT", "ISOLATED_NODE", "LOW_CONFIDENCE_CHAIN"):
    _gap_query(_kind)


@_query(
    f"""WITH RECURSIVE {gaps_sql()}, lists AS (SELECT node, (SELECT string_agg(other, '|' ORDER BY other) FROM (SELECT DISTINCT other FROM roles x WHERE x.node = n.node)) AS neighbours, (SELECT string_agg(CASE role WHEN 0 THEN other || ' → ' || node ELSE node || ' → ' || other END, '|' ORDER BY role, eo) FROM roles x WHERE x.node = n.node) AS existing FROM (SELECT DISTINCT node FROM roles) n)
SELECT variable, gap_type, round(gap_score, 6) AS gap_score, neighbours, existing FROM gaps JOIN lists ON lists.node = gaps.variable"""
)
def gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("variable", "gap_type", F.round("gap_score", 6).alias("gap_score"), _list("neighboring_nodes").alias("neighbours"), _list("existing_edges").alias("existing"))


@_query(f"WITH RECURSIVE {gaps_sql()} SELECT row_number() OVER (ORDER BY round(gap_score, 12) DESC, phase, node_ord, type_ord) AS rank, variable, gap_type FROM gaps QUALIFY rank <= 10")
def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_gaps(_gaps(spark, sf_dir), 10).select(F.col("rank").cast("long").alias("rank"), "variable", "gap_type")


def _two(hundredths: str) -> str:
    """A number of whole hundredths with its two digits, in SQL."""
    return f"(({hundredths}) // 100)::BIGINT || '.' || lpad((({hundredths}) % 100)::BIGINT::VARCHAR, 2, '0')"


def _some(items: str, n: int = 3) -> str:
    return f"array_to_string({items}[1:{n}], ', ') || CASE WHEN len({items}) > 3 THEN ', ...' ELSE '' END"


#: CTEs after those of gaps_sql(): told has each gap with the text that explains it.
_TOLD = f"""
around AS (SELECT node, list(other ORDER BY eo) FILTER (role = 0) AS ps, list(other ORDER BY eo) FILTER (role = 1) AS cs, sum(round(avg_confidence * 10000)::BIGINT) AS s, count(*) AS n,
  arg_min(CASE role WHEN 0 THEN other || ' → ' || node ELSE node || ' → ' || other END, (role, eo)) AS tie FROM roles GROUP BY node),
told AS (SELECT gaps.*, CASE gap_type
  WHEN 'MISSING_CAUSE' THEN chr(39) || variable || chr(39) || ' is said to lead to ' || {_some('cs')} || ', but no paper names a cause of it.'
  WHEN 'MISSING_EFFECT' THEN chr(39) || variable || chr(39) || ' is said to follow from ' || {_some('ps')} || ', but no paper names an effect of it.'
  WHEN 'ISOLATED_NODE' THEN chr(39) || variable || chr(39) || ' has one edge only, ' || tie || ', so its place among the other variables is open.'
  ELSE 'The chain from ' || {_some('ps', 2)} || ' over ' || chr(39) || variable || chr(39) || ' to ' || {_some('cs', 2)} || ' rests on weak evidence (mean confidence ' || {_two('(2 * s + 100 * n) // (200 * n)')} || ').' END AS gap_explanation
  FROM gaps JOIN around ON around.node = variable)"""


@_query(f"WITH RECURSIVE {gaps_sql()}, {_TOLD} SELECT variable, gap_type, gap_explanation FROM told")
def gap_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("variable", "gap_type", "gap_explanation")


# hypotheses


@_query(f"WITH {claims_sql()} SELECT cause, effect, arg_min(mechanism, claim_seq) AS mechanism FROM claims WHERE lower(mechanism) NOT LIKE '%not specified%' GROUP BY 1, 2")
def first_mechanisms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mechanisms by the names that claims have before they are normalised."""
    return H.first_mechanisms(_claims(spark, sf_dir))


@_query(f"WITH {claims_sql()}, once AS (SELECT cause, effect, mechanism, min(claim_seq) AS q FROM claims WHERE mechanism <> '' AND lower(mechanism) NOT LIKE '%not specified%' GROUP BY 1, 2, 3) SELECT cause, effect, string_agg(mechanism, '|' ORDER BY q) AS mechanisms FROM once GROUP BY 1, 2")
def mechanism_lists_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mechanism_lists(_claims(spark, sf_dir)).withColumn("mechanisms", _list("mechanisms"))


#: CTEs after those of graph_sql(): context has the one text of a prompt's edges. Mechanisms are looked up by raw names.
_CONTEXT = f"""
raw AS (SELECT cause, effect, arg_min(mechanism, claim_seq) AS mechanism FROM claims WHERE lower(mechanism) NOT LIKE '%not specified%' GROUP BY 1, 2),
known AS (SELECT cause, effect, '- ' || cause || ' → ' || effect AS head, avg_confidence, paper_count, eo, coalesce(mechanism, 'mechanism not specified') AS mechanism, row_number() OVER (ORDER BY eo) AS rank FROM dag LEFT JOIN raw USING (cause, effect)),
context AS (SELECT string_agg(head || ' (confidence ' || {_two('(round(avg_confidence * 10000)::BIGINT + 50) // 100')} || ', papers ' || paper_count || ': ' || mechanism || ')', chr(10) ORDER BY rank) FILTER (rank <= 12)
  || CASE WHEN count(*) >= 12 THEN chr(10) || '… and ' || (count(*) - 12) || ' more' ELSE '' END AS context, (SELECT count(DISTINCT source_paper) FROM claims) AS papers FROM known)"""


@_query(f"WITH RECURSIVE {graph_sql()}, {_CONTEXT} SELECT papers, context FROM context")
def edge_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return H.edge_context(graph.dag, graph.claims)


_PROMPT = _literal(P.HYPOTHESIS)
for _name, _value in {
    "papers": "papers::VARCHAR",
    "context": "context",
    "variable": "variable",
    "kind": "gap_type",
    "explanation": "gap_explanation",
    "neighbours": "(SELECT string_agg(DISTINCT other, ', ' ORDER BY other) FROM roles WHERE roles.node = variable)",
    "existing": "(SELECT string_agg(head || ': ' || mechanism, chr(10) ORDER BY CASE effect WHEN variable THEN 0 ELSE 1 END, eo) FROM known WHERE variable IN (cause, effect))",
}.items():
    _PROMPT = f"replace({_PROMPT}, '{{{_name}}}', {_value})"


@_query(
    f"""WITH RECURSIVE {gaps_sql()}, {_TOLD}, {_CONTEXT}, best AS (SELECT * FROM told ORDER BY round(gap_score, 12) DESC, phase, node_ord, type_ord LIMIT 10)
SELECT variable, gap_type, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM (SELECT variable, gap_type, {_PROMPT} AS prompt FROM best, context)"""
)
def hypothesis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the ten best gaps, whole texts as digests."""
    graph = _graph(spark, sf_dir)
    best = G.detect_gaps(graph.dag, graph.nodes).orderBy("gap_key").limit(10)
    rows = H.prompts(best, graph.dag, graph.claims)
    return rows.select("gap.variable", "gap.gap_type", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


_RAW_FIRST = "firsts AS (SELECT cause, effect, arg_min(mechanism, claim_seq) AS mechanism FROM (SELECT n_cause AS cause, n_effect AS effect, mechanism, claim_seq FROM claims) WHERE lower(mechanism) NOT LIKE '%not specified%' {more} GROUP BY 1, 2)"


def _clean(claims: DataFrame) -> DataFrame:
    return merge.normalize_claims(claims)


@_query(f"WITH RECURSIVE {graph_sql()}, {_RAW_FIRST.format(more='')} SELECT eo AS rank, fe.cause, fe.effect, avg_confidence, coalesce(mechanism, 'mechanism not specified') AS mechanism FROM fe LEFT JOIN firsts USING (cause, effect) WHERE eo <= 12")
def edge_context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.context_edges(_edges(spark, sf_dir), _clean(_claims(spark, sf_dir)))
    return rows.select(F.col("rank").cast("long").alias("rank"), "cause", "effect", "avg_confidence", "mechanism")


@_query(f"WITH RECURSIVE {gaps_sql()}, {_RAW_FIRST.format(more='')} SELECT DISTINCT variable, dag.cause, dag.effect, dag.avg_confidence, coalesce(mechanism, 'mechanism not specified') AS mechanism FROM gaps JOIN dag ON variable = dag.cause OR variable = dag.effect LEFT JOIN firsts ON firsts.cause = dag.cause AND firsts.effect = dag.effect")
def existing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    gaps = G.detect_gaps(graph.dag, graph.nodes)
    return H.existing_edges(gaps, graph.dag, _clean(graph.claims)).drop("ord")


@_query("SELECT event_id, round(0.4 * (event_id % 11) / 10.0 + 0.4 * (event_id % 7) / 10.0 + 0.2 * (event_id % 5) / 10.0, 6) AS composite, row_number() OVER (ORDER BY 4 * (event_id % 11) + 4 * (event_id % 7) + 2 * (event_id % 5) DESC, event_id) AS rank FROM events QUALIFY rank <= 100")
def hypothesis_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best of hypotheses with scores made of event ids."""
    from pyspark.sql import Window

    e = F.col("event_id")
    score = F.round(composite_score((e % 11) / 10.0, (e % 7) / 10.0, (e % 5) / 10.0), 6)
    best = events(spark, sf_dir).select("event_id", score.alias("composite")).orderBy(F.desc("composite"), "event_id").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "event_id")).cast("long"))


def _ranked(gaps: DataFrame, graph: KnowledgeGraph) -> DataFrame:
    found, _ = H.generate(gaps, graph.dag, _clean(graph.claims), OfflineClient(), deterministic_ids=True)
    return H.rank(found)


_SCORED = f"""{gaps_sql()}, best AS (SELECT * FROM gaps ORDER BY round(gap_score, 12) DESC, phase, node_ord, type_ord LIMIT 10),
asked AS (SELECT variable, gap_type, gap_score, (SELECT min(other) FROM roles WHERE roles.node = variable) AS near FROM best),
answered AS (SELECT *, round(0.5 + length(variable) % 5 / 10, 2) AS t, round(0.4 + length(near) % 5 / 10, 2) AS n FROM asked),
scored AS (SELECT 'H' || upper(substr(sha256(variable || '|' || gap_type), 1, 8)) AS id, variable, near, t, n, CASE gap_type WHEN 'MISSING_CAUSE' THEN near ELSE variable END AS predicted_cause,
  CASE gap_type WHEN 'MISSING_CAUSE' THEN variable ELSE near END AS predicted_effect, round(0.4 * t + 0.4 * n + 0.2 * gap_score, 6) AS composite_score FROM answered)"""


@_query(f"WITH RECURSIVE {_SCORED} SELECT (row_number() OVER (ORDER BY composite_score DESC, id))::INTEGER AS rank, id, variable, predicted_cause, predicted_effect, composite_score FROM scored")
def generate_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hypotheses of the offline client, ranked."""
    graph = _graph(spark, sf_dir)
    gaps = G.detect_gaps(graph.dag, graph.nodes)
    return _ranked(gaps, graph).select("rank", "id", F.col("gap_addressed.variable").alias("variable"), "predicted_cause", "predicted_effect", F.round("composite_score", 6).alias("composite_score"))


# sources and sinks


def _write_texts(spark: SparkSession, texts: dict[str, str]) -> None:
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for name, content in texts.items():
        where = path(name)
        out = where.getFileSystem(conf).create(where, True)
        out.write(bytearray(content.encode()))
        out.close()


@_query("SELECT row_number() OVER (ORDER BY f) - 1 AS paper_ord, f AS source_paper, length(t) AS n_chars FROM (SELECT 'nation ' || lpad(n_nationkey::VARCHAR, 3, '0') || '.txt' AS f, n_name || ' is in region ' || n_regionkey AS t FROM nation)")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as text files, one each (there are as many as the table has, at any scale), and read back as a corpus."""
    folder = f"{Stages(spark, 'corpus').root}/papers"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    _write_texts(spark, {f"{folder}/nation {row.n_nationkey:03d}.txt": f"  {row.n_name} is in region {row.n_regionkey}\n" for row in rows})
    return load_directory(spark, folder).select("paper_ord", "source_paper", F.length("content").cast("long").alias("n_chars"))


@_query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS paper_ord, 'region_' || r_regionkey || '.md' AS source_paper, 'Region ' || r_name AS content FROM region")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions as files named one by one."""
    folder = f"{Stages(spark, 'files').root}/papers"
    files = {f"{folder}/region_{row.r_regionkey}.md": f"\n Region {row.r_name} \r\n" for row in spark.read.parquet(f"{sf_dir}/region.parquet").collect()}
    _write_texts(spark, files)
    return load_files(spark, sorted(files, reverse=True))


@_query("SELECT r_regionkey::BIGINT AS paper_ord, 'paper_' || (r_regionkey + 1) AS source_paper, r_name AS content FROM region UNION ALL SELECT r_regionkey::BIGINT, 'region ' || r_name, r_name FROM region")
def texts_as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions as texts in memory, without names and with them."""
    names = [row.r_name for row in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    return from_texts(spark, names).unionByName(from_texts(spark, names, [f"region {n}" for n in names]))


def _told_papers(claims: DataFrame, cue: Column) -> DataFrame:
    """Papers with one paragraph a claim."""
    sentence = F.concat(F.lit("It was shown in this study that, in most of the cases, "), F.col("cause"), cue, F.col("effect"), F.lit(" through "), F.lower("evidence"), F.lit("."))
    return claims.groupBy("paper_ord", "source_paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", sentence.alias("s")))), lambda x: x["s"]), "\n\n").alias("content"))


@_query(f"WITH {claims_sql()} SELECT source_paper, n_cause AS cause, n_effect AS effect, 0.85::DOUBLE AS confidence, arg_min(trim(lower(evidence)), claim_ord) AS mechanism FROM claims GROUP BY 1, 2, 3")
def extract_from_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the offline client finds in sentences made of the mapped claims."""
    papers = _told_papers(merge.normalize_claims(_claims(spark, sf_dir)), F.lit(" leads to "))
    claims, _ = extract_claims(papers, OfflineClient())
    return claims.select("source_paper", "cause", "effect", "confidence", "mechanism")


@_query(f"WITH {claims_sql()} SELECT source_paper, n_cause AS cause, n_effect AS effect, 0.85::DOUBLE AS confidence FROM claims WHERE claim_ord % 2 = 0 GROUP BY 1, 2, 3")
def extract_confident_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of 0.6 and above that the offline client finds where every other sentence is a guess of 0.5."""
    cue = F.when(F.col("claim_ord") % 2 == 0, " leads to ").otherwise(" may cause ")
    papers = _told_papers(merge.normalize_claims(_claims(spark, sf_dir)), cue)
    claims, _ = extract_claims(papers, OfflineClient(), claim_min_confidence=0.6)
    return claims.select("source_paper", "cause", "effect", "confidence")


@_query(
    f"""WITH RECURSIVE {gaps_sql()}, parts AS (SELECT 'claims' AS part, count(*) AS n FROM claims UNION ALL SELECT 'edges', count(*) FROM fe UNION ALL SELECT 'gaps', count(*) FROM gaps UNION ALL SELECT 'nodes', count(*) FROM nord)
SELECT part, n FROM parts WHERE n > 0"""
)
def document_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped graph with its gaps as a JSON document in parts, written, read and taken apart."""
    graph, gaps = _full_graph(spark, sf_dir)
    path = f"{Stages(spark, 'document').root}/graph"
    graph.write_parts(path, gaps)
    parts = read_parts(spark, path)
    rows = [df.select(F.lit(name).alias("part"), F.col("ord").cast("long").alias("ord")) for name, df in sorted(parts.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# reports


def _full_graph(spark: SparkSession, sf_dir: str) -> tuple[KnowledgeGraph, DataFrame]:
    graph = build_graph(_claims(spark, sf_dir), 0.0, MIN_PAPERS)
    return graph, G.detect_gaps(graph.dag, graph.nodes)


@_query(f"WITH RECURSIVE {gaps_sql()} SELECT (SELECT count(DISTINCT source_paper) FROM claims) AS papers, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM nord) AS nodes, (SELECT count(*) FROM fe) AS edges, (SELECT count(*) FROM gaps) AS gaps, 0::BIGINT AS hypotheses")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, gaps = _full_graph(spark, sf_dir)
    rows = report.summary(graph.to_document(gaps))
    return rows.select(*(F.col(c).cast("long").alias(c) for c in rows.columns))


@_query(f"WITH RECURSIVE {gaps_sql()}, {_TOLD} SELECT row_number() OVER (ORDER BY round(gap_score, 12) DESC, phase, node_ord, type_ord) AS rank, variable, gap_type, printf('%.2f', gap_score) AS score, substr(gap_explanation, 1, 80) AS explanation FROM told QUALIFY rank <= 5")
def gaps_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best gaps as a report shows them."""
    graph, gaps = _full_graph(spark, sf_dir)
    rows = report.gaps_report(graph.to_document(gaps), 5)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@_query(
    f"""WITH RECURSIVE {_SCORED} SELECT id, variable, substr(near || ' and ' || variable || ' are linked by a factor that no paper has studied.', 1, 100) AS hypothesis,
printf('%.2f', t) AS testability, printf('%.2f', n) AS novelty, substr('Measure ' || near || ' while ' || variable || ' is varied.', 1, 100) AS experiment FROM scored ORDER BY composite_score DESC, id LIMIT 5"""
)
def hypotheses_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hypotheses of a document, in the order stored."""
    graph, gaps = _full_graph(spark, sf_dir)
    document = to_document(spark, gaps=gaps, hypotheses=_ranked(gaps, graph))
    return report.hypotheses_report(document, 5)
