"""The engine as functions of requests, and a small optional HTTP server around them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapgraph.config import Settings
from gapgraph.errors import CompletionError, GapGraphError, NoGapsError
from gapgraph.operators import gaps as G, hypotheses as H
from gapgraph.operators.claims import extract_claims
from gapgraph.operators.completion import CompletionClient, raise_lost
from gapgraph.operators.graph import build_graph
from gapgraph.schemas import DOCUMENT
from gapgraph.sources.corpus import from_texts
from gapgraph.sources.document import tables, to_document
from gapgraph.stages import Stages


def analyze(papers: DataFrame, client: CompletionClient, settings: Settings) -> DataFrame:
    """Papers to a graph document with claims, edges and gaps; CompletionError if a call failed on every attempt."""
    stages = Stages(papers.sparkSession, "analyze")
    claims, completions = extract_claims(papers, client, settings.max_retries)
    raise_lost(completions, client, settings.max_retries)
    graph = build_graph(stages.write(claims, "claims"), settings.min_confidence, settings.min_papers_for_edge)
    return stages.write(graph.to_document(G.detect_gaps(graph.dag, graph.nodes), model_used=client.model), "document")


def hypothesize(document: DataFrame, client: CompletionClient, settings: Settings, max_hypotheses: int | None = None) -> DataFrame:
    """The document with ranked hypotheses for its best gaps; NoGapsError if it has none."""
    spark, parts = document.sparkSession, tables(document)
    if parts["gaps"].isEmpty():
        raise NoGapsError("the graph has no gaps")
    keyed = parts["gaps"].withColumn("gap_key", F.struct((-F.col("gap_score")).alias("s"), "ord"))
    edges = parts["edges"].withColumn("edge_key", F.struct((-F.col("avg_confidence")).alias("c"), F.col("ord").alias("q")))
    claims = parts["claims"].withColumn("claim_seq", F.col("ord"))
    found, lost = H.generate(keyed, edges, claims, client, max_hypotheses or settings.max_hypotheses, settings.max_retries)
    raise_lost(lost, client, settings.max_retries, "error")
    head = document.select("papers_analyzed", "created_at").first()
    ranked = H.rank(found).withColumn("ord", F.col("rank"))
    return to_document(spark, parts["nodes"], parts["edges"], parts["claims"], parts["gaps"], ranked, head.papers_analyzed, head.created_at, client.model)


def _json(document: DataFrame) -> dict:
    return json.loads(document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def handle(spark: SparkSession, client: CompletionClient, settings: Settings, method: str, path: str, body: dict | None) -> tuple[int, dict]:
    """(status, answer) of POST /analyze, POST /hypothesize and GET /health."""
    try:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok", "provider": settings.provider, "model": client.model}
        if (method, path) == ("POST", "/analyze"):
            texts, names = body["texts"], body.get("paper_names")
            return 200, _json(analyze(from_texts(spark, texts, names), client, settings))
        if (method, path) == ("POST", "/hypothesize"):
            document = spark.createDataFrame([(json.dumps(body["graph"]),)], "raw string").select(F.from_json("raw", DOCUMENT).alias("d")).select("d.*")
            return 200, _json(hypothesize(document, client, settings, body.get("max_hypotheses")))
        return 404, {"detail": "no such route"}
    except CompletionError as error:
        return 502, {"detail": str(error)}
    except (GapGraphError, ValueError, KeyError, TypeError) as error:
        return 422, {"detail": str(error)}


def serve(spark: SparkSession, client: CompletionClient, settings: Settings) -> None:
    """Answers requests one after another until interrupted."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, answer = handle(spark, client, settings, method, self.path, body)
            except json.JSONDecodeError as error:
                status, answer = 422, {"detail": str(error)}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self._answer("GET")

        def do_POST(self):  # noqa: N802
            self._answer("POST")

    HTTPServer((settings.api_host, settings.api_port), Handler).serve_forever()
