"""The pipeline against the plain versions of its stages, on a small corpus with planted cases."""

import brute
import pytest

import corpus_pipeline
from gapgraph.llm import queries
from gapgraph.llm.decontaminate import normal


def corpus():
    rows = []
    for k in range(40):
        rows.append((k, "\n".join(" ".join(f"d{k}l{j}w{m}" for m in range(12)) for j in range(4)), "en", f"s{k % 2}"))
    rows[5] = (5, rows[4][1], "en", "s1")  # an exact copy
    rows[7] = (7, rows[6][1].replace("d6l1w3", "d6l1xx"), "en", "s1")  # a near copy, line by line
    rows[9] = (9, rows[8][1].replace("\n", " ").replace("d8l3w11", "other"), "en", "s1")  # a near copy in one line
    rows[11] = (11, rows[11][1] + "\n" + ITEM.upper(), "en", "s1")
    rows[12] = (12, "too short", "en", "s0")
    rows[13] = (13, "again and again we say the same words here " * 8, "en", "s1")
    return rows


ITEM = "which of the four rivers in the east of the country is the longest and where does it rise"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in corpus()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [(i, t) for i, t, _, _ in corpus()]
    host = {i: s for i, _, _, s in corpus()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        if name == "quality rules":
            plain = [(i, t) for i, kept, t in brute.quality([(i, t, host[i]) for i, t in plain]) if kept]
        elif name == "line dedup":
            plain = brute.drop_lines(plain)
        elif name == "n-gram join":
            keep = {c for _, c, _ in brute.near(plain)}
            plain = [(i, t) for i, t in plain if i in keep]
        else:
            plain = [(i, t[: len(t) - len(ITEM)] if normal(t).endswith(ITEM) else t) for i, t in plain]
        rows = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect())
        assert rows == sorted((i, t, len(t)) for i, t in plain), name
    gone = {i for i, *_ in corpus()} - {i for i, _ in plain}
    assert {5, 9, 12, 13} <= gone and not gone & set(range(14, 40))
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in plain}


def test_odd_rows(spark, folder, odd):
    for rows in (odd, odd.limit(0)):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() >= 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
