"""Claims from the events table: consecutive events of a user are read as cause and effect.

The driver's tables hold no causal prose. ``k`` in an event's props, modulo 40, names a
variable; a user is a paper. Names carry case, space and punctuation noise that normalises
away, and mechanisms and evidence carry the cases that merging tells apart. The SQL below says the
same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

VARIABLES = 40
#: Papers that an edge of the mapped graph needs, at any scale.
MIN_PAPERS = 3


def _noisy(k: Column) -> Column:
    name = F.concat(F.lit("k"), k.cast("string"))
    return F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).when(F.col("event_id") % 3 == 2, F.concat(F.lit('"'), name, F.lit('".'))).otherwise(name)


def claims_from_events(events: DataFrame, base: int = 0) -> DataFrame:
    """Claims with paper_ord, chunk_ord, claim_ord and claim_seq; confidence in whole hundredths from ``base``."""
    keyed = events.select("event_id", "user_id", "ts", "event_type", (F.get_json_object("props", "$.k").cast("int") % VARIABLES).alias("k"))
    lagged = keyed.withColumn("pk", F.lag("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = lagged.filter("pk is not null and pk <> k")
    way = F.concat(F.lit("via "), F.col("event_type"))
    return rows.select(
        F.col("user_id").alias("paper_ord"),
        F.lit(0).alias("chunk_ord"),
        F.col("event_id").alias("claim_ord"),
        F.col("event_id").alias("claim_seq"),
        _noisy(F.col("pk")).alias("cause"),
        _noisy(F.col("k")).alias("effect"),
        ((F.lit(base) + (F.col("pk") * 7 + F.col("k") * 7) % 50 + F.col("event_id") % 21) / 100.0).alias("confidence"),
        F.when(F.col("event_type") == "error", "mechanism not specified").when(F.col("event_type") == "view", "Unknown").when(F.col("event_id") % 2 == 1, F.concat(F.upper(way), F.lit(" "))).otherwise(way).alias("mechanism"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source_paper"),
        F.concat(F.lit("event "), (F.col("event_id") % 50).cast("string"), F.when(F.col("event_id") % 4 == 0, " ").otherwise("")).alias("evidence"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def claims_sql(base: int = 0) -> str:
    """CTEs ev, lagged and claims (clean names n_cause, n_effect and cents beside the raw columns)."""

    def noisy(k: str) -> str:
        return f"CASE WHEN event_id % 3 = 1 THEN '  ' || upper('k' || {k}) || ' ' WHEN event_id % 3 = 2 THEN '\"k' || {k} || '\".' ELSE 'k' || {k} END"

    return f"""
ev AS (SELECT event_id, user_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % {VARIABLES} AS k FROM events),
lagged AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pk FROM ev),
claims AS (
  SELECT user_id AS paper_ord, event_id AS claim_ord, event_id AS claim_seq, {noisy('pk')} AS cause, {noisy('k')} AS effect,
    'k' || pk AS n_cause, 'k' || k AS n_effect, {base} + (pk * 7 + k * 7) % 50 + event_id % 21 AS cents,
    CASE WHEN event_type = 'error' THEN 'mechanism not specified' WHEN event_type = 'view' THEN 'Unknown'
         WHEN event_id % 2 = 1 THEN upper('via ' || event_type) || ' ' ELSE 'via ' || event_type END AS mechanism,
    'user_' || user_id AS source_paper, 'event ' || (event_id % 50) || CASE WHEN event_id % 4 = 0 THEN ' ' ELSE '' END AS evidence
  FROM lagged WHERE pk IS NOT NULL AND pk <> k)"""


def edges_sql(base: int = 0) -> str:
    return (
        claims_sql(base)
        + """,
merged AS (SELECT n_cause AS cause, n_effect AS effect, count(*) AS n, sum(cents) * 10000 AS s, count(DISTINCT source_paper) AS paper_count, min(claim_seq) AS q FROM claims GROUP BY 1, 2),
edges AS (SELECT cause, effect, CAST((2 * s + 100 * n) // (200 * n) AS DOUBLE) / 10000.0 AS avg_confidence, paper_count, q FROM merged)"""
    )


def graph_sql(base: int = 0, min_confidence: float = 0.0) -> str:
    """CTEs up to fe (filtered edges with eo, their order), k (their rank for cycles) and dag."""
    return (
        edges_sql(base)
        + f""",
fe AS (SELECT *, row_number() OVER (ORDER BY avg_confidence DESC, q) AS eo FROM edges WHERE avg_confidence >= {min_confidence} AND paper_count >= {MIN_PAPERS}),
k AS (SELECT cause AS u, effect AS v, row_number() OVER (ORDER BY avg_confidence, cause, effect) AS rk FROM fe),
r(rk, tgt, node) AS (SELECT rk, u, v FROM k UNION SELECT r.rk, r.tgt, k.v FROM r JOIN k ON k.u = r.node AND k.rk > r.rk),
gone AS (SELECT DISTINCT k.u, k.v FROM r JOIN k ON k.rk = r.rk WHERE r.node = r.tgt),
dag AS (SELECT fe.* FROM fe ANTI JOIN gone ON fe.cause = gone.u AND fe.effect = gone.v)"""
    )


def gaps_sql(base: int = 0, min_confidence: float = 0.0) -> str:
    """CTEs up to gaps(variable, gap_type, gap_score, phase, node_ord, type_ord)."""
    return (
        graph_sql(base, min_confidence)
        + """,
roles AS (SELECT effect AS node, cause AS other, 0 AS role, avg_confidence, paper_count, eo FROM dag UNION ALL SELECT cause, effect, 1, avg_confidence, paper_count, eo FROM dag),
own AS (SELECT node, count(*) FILTER (role = 0) AS i, count(*) FILTER (role = 1) AS o, sum(paper_count) AS papers, max(avg_confidence) AS strongest FROM roles GROUP BY node),
near AS (SELECT p.node, sum(own.i + own.o) AS d FROM (SELECT DISTINCT node, other FROM roles) p JOIN own ON own.node = p.other GROUP BY p.node),
nord AS (SELECT node, min(o) AS node_ord FROM (SELECT cause AS node, 2 * eo AS o FROM fe UNION ALL SELECT effect, 2 * eo + 1 FROM fe) GROUP BY node),
kinds AS (
  SELECT node, 'MISSING_CAUSE' AS gap_type, 0.75 AS w, 0 AS phase, 0 AS type_ord FROM own WHERE i = 0 AND o >= 2
  UNION ALL SELECT node, 'MISSING_EFFECT', 0.65, 0, 1 FROM own WHERE i >= 1 AND o = 0
  UNION ALL SELECT node, 'ISOLATED_NODE', 0.45, 0, 2 FROM own WHERE i + o = 1
  UNION ALL SELECT node, 'LOW_CONFIDENCE_CHAIN', 0.60, 1, 3 FROM own WHERE i >= 1 AND o >= 1 AND strongest < 0.6),
gaps AS (
  SELECT kinds.node AS variable, gap_type, least(1.0, 0.40 * ln(1.0 + near.d) / ln(21.0) + 0.30 * ln(1.0 + own.papers) / ln(11.0) + 0.30 * w) AS gap_score, phase, node_ord, type_ord
  FROM kinds JOIN own USING (node) JOIN near USING (node) JOIN nord USING (node))"""
    )
