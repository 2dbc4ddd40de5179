import json

import pytest
from pyspark.sql import functions as F

from gapgraph.config import Settings
from gapgraph.errors import CompletionError, CorpusError, NoGapsError
from gapgraph.operators import gaps as G, hypotheses as H
from gapgraph.operators.claims import extract_claims
from gapgraph.operators.completion import OfflineClient, attempt, messages
from gapgraph.operators.graph import build_graph
from gapgraph.schemas import validate
from gapgraph.sources.corpus import from_texts, load_any, load_directory, load_files
from gapgraph.sources.document import read_document, read_head, read_parts, tables, write_document, write_parts

PAD = " This sentence is here to make the paragraph long enough to be kept by the splitter."
TEXTS = [f"Smoke causes lung inflammation through oxidative stress.{PAD}\n\nSmoke triggers cough.{PAD}", f"Lung inflammation leads to fibrosis.{PAD}"]


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" second \r\n")
    (tmp_path / "a.txt").write_text("first")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "c.md").write_text("other")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("below")
    rows = load_directory(spark, str(tmp_path)).orderBy("paper_ord").collect()
    assert [(r.paper_ord, r.source_paper, r.content) for r in rows] == [(0, "a.txt", "first"), (1, "b.txt", "second")]
    assert load_files(spark, [str(tmp_path / "a.txt")]).count() == 1
    assert load_any(spark, [str(tmp_path)]).count() == 2
    for bad in (str(tmp_path / "none"), str(tmp_path / "a.txt"), str(tmp_path / "sub" / "e")):
        with pytest.raises(CorpusError):
            load_directory(spark, bad)
    with pytest.raises(CorpusError):
        load_files(spark, [str(tmp_path / "blank.txt")])
    assert [r.source_paper for r in from_texts(spark, ["x", "y"]).collect()] == ["paper_1", "paper_2"]
    with pytest.raises(ValueError):
        from_texts(spark, ["x"], [])


def test_corpus_to_hypotheses_and_back(spark, tmp_path):
    claims, completions = extract_claims(from_texts(spark, TEXTS), OfflineClient())
    assert completions.filter("attempt = 1").count() == 3
    assert {(r.cause, r.effect) for r in claims.collect()} == {("smoke", "lung inflammation"), ("smoke", "cough"), ("lung inflammation", "fibrosis")}
    graph = build_graph(claims)
    gaps = G.detect_gaps(graph.dag, graph.nodes)
    assert {(r.variable, r.gap_type) for r in gaps.collect()} >= {("smoke", "MISSING_CAUSE"), ("fibrosis", "MISSING_EFFECT")}
    found, lost = H.generate(gaps, graph.dag, claims, OfflineClient(), 2, deterministic_ids=True)
    ranked = H.rank(found)
    assert ranked.count() == 2 and lost.isEmpty()
    write_document(graph.to_document(gaps, ranked, OfflineClient.model), str(tmp_path / "doc"))
    document = read_document(spark, str(tmp_path / "doc"))
    parts = tables(document)
    assert {k: v.count() for k, v in parts.items()} == {"nodes": 4, "edges": 3, "claims": 3, "gaps": gaps.count(), "hypotheses": 2}
    scores = [r.gap_score for r in parts["gaps"].orderBy("ord").collect()]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    assert document.first().papers_analyzed == 2
    with pytest.raises(NoGapsError):
        H.generate(gaps.limit(0), graph.dag, claims, OfflineClient())


class Junk(OfflineClient):
    """Fails to give JSON at first."""

    def complete(self, prompt, system, temperature, max_tokens):
        return super().complete(prompt, system, temperature, max_tokens) if temperature == 0.0 else "sorry"


class Down:
    model = "down"

    def complete(self, prompt, system, temperature, max_tokens):
        raise OSError("no route")


def test_one_strict_retry(spark):
    claims, completions = extract_claims(from_texts(spark, TEXTS), Junk())
    assert claims.count() == 3
    assert completions.groupBy("attempt").count().orderBy("attempt").collect() == [(1, 3), (2, 3)]


def test_failures_are_rows(spark):
    claims, completions = extract_claims(from_texts(spark, TEXTS[1:]), Down(), max_retries=1)
    assert claims.isEmpty()
    assert [r.status for r in completions.collect()] == ["no route"]


def test_attempts():
    with pytest.raises(CompletionError, match="after 2 attempts"):
        attempt(Down(), "p", "s", 0.1, 10, 2, pause=0)
    assert messages("p", "s")[0]["role"] == "system" and len(messages("p", "")) == 1


def test_composite(spark):
    gap = "struct<variable:string,gap_score:double>"
    df = spark.createDataFrame([("h1", ("a", 0.8), 0.9, 0.7), ("h2", ("b", 0.9), 0.9, 0.9), ("h3", ("c", 0.1), 0.2, 0.2)], f"id string, gap_addressed {gap}, testability_score double, novelty_score double")
    got = [(r.id, round(r.composite_score, 6)) for r in H.rank(df).orderBy("rank").collect()]
    assert got == [("h2", 0.9), ("h1", 0.8), ("h3", 0.18)]


def test_context_tail(spark):
    edge = "cause string, effect string, avg_confidence double, paper_count int, edge_key struct<c:double,q:long>"
    rows = [(f"a{i}", f"b{i}", 0.5, 1, (-0.5, i)) for i in range(14)]
    claims = spark.createDataFrame([(0, "a0", "b0", "how", "p")], "claim_seq long, cause string, effect string, mechanism string, source_paper string")
    text = H.edge_context(spark.createDataFrame(rows, edge), claims).first()
    assert text.papers == 1 and text.context.endswith("… and 2 more") and "how" in text.context
    assert H.edge_context(spark.createDataFrame(rows[:12], edge), claims).first().context.endswith("… and 0 more")
    assert "more" not in H.edge_context(spark.createDataFrame(rows[:11], edge), claims).first().context


def test_settings():
    s = Settings.from_env({"GAPGRAPH_MIN_CONFIDENCE": "0.7", "GAPGRAPH_LOG_LEVEL": "debug", "GAPGRAPH_NOPE": "1"})
    assert (s.min_confidence, s.log_level, s.model_id) == (0.7, "DEBUG", "ollama/llama3.1")
    assert Settings(model="ollama/x").model_id == "ollama/x"
    for bad in ({"max_retries": 0}, {"temperature": 3.0}, {"log_level": "x"}, {"provider": "x"}, {"max_hypotheses": 101}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_validation(spark):
    df = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 1.5), ("a", "b", float("nan")), (None, "b", 0.5), ("", "", 0.0)], "cause string, effect string, confidence double")
    good, bad = validate(df, "claims")
    assert (good.count(), bad.count()) == (2, 3)


def test_document_is_json(spark, tmp_path):
    graph = build_graph(extract_claims(from_texts(spark, TEXTS), OfflineClient())[0])
    write_document(graph.to_document(), str(tmp_path / "d"))
    raw = "".join(p.read_text() for p in (tmp_path / "d").glob("part-*"))
    data = json.loads(raw)
    assert data["gaps"] == [] and len(data["edges"]) == 3 and data["model_used"] == "unknown"
    assert spark.read.json(str(tmp_path / "d"), multiLine=True).select(F.size("nodes")).first()[0] == 4


def joined(path):
    files = [p for p in path.rglob("*") if p.is_file() and p.name[0] not in "._"]
    return "".join(p.read_text() for p in sorted(files, key=str))


def test_document_in_parts(spark, tmp_path):
    """No file or task has to hold an array: files are parts of one JSON object, read back in order."""
    n = 20_000
    text = F.concat(F.lit(', "x"\n[{é'), F.col("id").cast("string"))
    claims = spark.range(n).repartition(3).select((n - F.col("id")).alias("claim_seq"), text.alias("cause"), F.lit("b").alias("effect"), (F.col("id") / n).alias("confidence"), F.lit(None).cast("string").alias("mechanism"), F.lit("").alias("source_paper"), text.alias("evidence"))
    nodes = spark.createDataFrame([(",z", 0), ("y", 1), (None, 2)], "node string, ord int")
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "128k"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        write_parts(spark, str(tmp_path / "d"), 2, "now", nodes=nodes, claims=claims, gaps=claims.limit(0).select(F.lit("").alias("variable"), F.lit("").alias("gap_type"), F.lit(0.0).alias("gap_score"), F.array().cast("array<string>").alias("neighboring_nodes"), F.array().cast("array<string>").alias("existing_edges"), F.lit("").alias("gap_explanation"), F.col("claim_seq").alias("gap_key")))
        parts = {k: v.orderBy("ord").collect() for k, v in read_parts(spark, str(tmp_path / "d")).items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "d/3-claims-1").glob("part-*"))) > 1
    data = json.loads(joined(tmp_path / "d"))
    assert (data["papers_analyzed"], data["created_at"], data["model_used"]) == tuple(read_head(spark, str(tmp_path / "d")).first()) == (2, "now", "unknown")
    assert data["nodes"] == [r.node for r in parts["nodes"]] == [",z", "y", None]
    assert data["edges"] == data["gaps"] == data["hypotheses"] == [] and not (parts["edges"] or parts["gaps"] or parts["hypotheses"])
    assert [r.ord for r in parts["claims"]] == list(range(n))
    assert [{k: v for k, v in r.asDict().items() if k != "ord"} for r in parts["claims"]] == data["claims"]
    assert [c["cause"] for c in data["claims"]] == [f', "x"\n[{{é{n - 1 - i}' for i in range(n)]
    with pytest.raises(ValueError):
        write_parts(spark, str(tmp_path / "e"), claim=claims)
    broken = next((tmp_path / "d/1-nodes-1").glob("part-*"))
    (broken.parent / f".{broken.name}.crc").unlink()
    broken.write_text(broken.read_text() + ',"cut')
    with pytest.raises(Exception, match="MALFORMED"):
        read_parts(spark, str(tmp_path / "d"))


def test_document_of_a_graph_in_parts(spark, tmp_path):
    graph = build_graph(extract_claims(from_texts(spark, TEXTS), OfflineClient())[0])
    gaps = G.detect_gaps(graph.dag, graph.nodes)
    graph.write_parts(str(tmp_path / "d"), gaps)
    data, row = json.loads(joined(tmp_path / "d")), graph.to_document(gaps).first().asDict(recursive=True)
    assert {k: v for k, v in data.items() if k != "created_at"} == {k: v for k, v in row.items() if k != "created_at"}
