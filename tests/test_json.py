import pytest

from gapgraph.functions.jsonparse import parse_claims, parse_hypotheses

CASES = [
    ('{"claims":[]}', 0, False),
    ("[]", 0, False),
    ("{}", 0, False),
    ('{"claims":null}', 0, False),
    ('```json\n{"claims":[{"cause":"A","effect":"b"}]}\n```', 1, False),
    ('Sure: {"claims":[{"cause":"a","effect":"b"}]} done', 1, False),
    ('Sure: [{"cause":"a","effect":"b"}]', 0, False),
    ("not json", 0, True),
    ('"text"', 0, True),
    ("5", 0, True),
    ('[5, {"confidence":1.5}, {"confidence":null}, {"confidence":"x"}, {"confidence":"0.8"}, {"confidence":true}]', 2, False),
    ('Well: {"claims":[{"cause":"a}","effect":"b"}]} yes', 0, True),
    ("", 0, True),
]


@pytest.mark.parametrize(("raw", "rows", "fails"), CASES)
def test_claims(spark, raw, rows, fails):
    answers = spark.createDataFrame([("p", raw)], "source_paper string, raw string")
    claims, failed = parse_claims(answers)
    assert (claims.count(), failed.count()) == (rows, int(fails))


def test_defaults_and_nulls(spark):
    raw = '[{"cause":null,"effect":" B "}, {"cause":"x","source_paper":"other","confidence":1}]'
    claims, _ = parse_claims(spark.createDataFrame([("p", raw)], "source_paper string, raw string"))
    rows = [tuple(r) for r in claims.orderBy("claim_ord").select("cause", "effect", "confidence", "mechanism", "source_paper", "evidence").collect()]
    assert rows == [("none", "b", 0.5, "mechanism not specified", "p", ""), ("x", "", 1.0, "mechanism not specified", "p", "")]


def test_hypotheses(spark):
    gap = "struct<variable:string,gap_type:string,gap_score:double,neighboring_nodes:array<string>,existing_edges:array<string>,gap_explanation:string>"
    g = ("x", "ISOLATED_NODE", 0.5, [], [], "")
    raws = ['{"hypothesis_text":"h","predicted_cause":"A","novelty_score":0.7}', '[{"hypothesis_text":"h"}]', '{"testability_score":2}', "no"]
    df = spark.createDataFrame([(g, r) for r in raws], f"gap {gap}, raw string")
    good, bad = parse_hypotheses(df, deterministic_ids=True)
    assert [(r.predicted_cause, r.testability_score, r.novelty_score) for r in good.collect()] == [("a", 0.5, 0.7)]
    assert bad.count() == 3
    assert parse_hypotheses(df, accept_array=True)[0].count() == 2
    assert good.first().id.startswith("H") and len(good.first().id) == 9
