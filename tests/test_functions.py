"""Truth tables of the column expressions."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.predicates import (
    bucket_predicate,
    card_bucket,
    coverage_bucket,
    fill_state,
    has_any_code,
    richness_stratum,
    score_boost,
    score_bucket,
)
from corpusloom.functions.text import strip, within_size
from corpusloom.functions.uris import normalise_uri, payload_text, redact_uri, split_s3, strip_query
from corpusloom.operators.ledger import artifact_key


def column(spark, values, type_, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_fill_state(spark):
    got = column(spark, [None, "", "  ", "\n", "\t ", "a"], "string", fill_state("v"))
    assert got == ["null", "empty", "whitespace", "filled", "filled", "filled"]


def test_scores(spark):
    values = [None, float("nan"), 0.0, 0.25, 0.4999, 0.5, 0.7499, 0.75, 1.0]
    assert column(spark, values, "double", score_boost("v")) == [1.0, 1.0, 2.0, 2.0, 2.0, 1.5, 1.5, 1.0, 1.0]
    assert column(spark, values, "double", score_bucket("v")) == [
        "null", ">= 0.75", "< 0.25", "0.25 - 0.50", "0.25 - 0.50", "0.50 - 0.75", "0.50 - 0.75", ">= 0.75", ">= 0.75"]


def test_arrays(spark):
    values = [None, [], ["a"], ["a", None], ["x", "y", "z"]]
    assert column(spark, values, "array<string>", card_bucket("v")) == [
        "empty / null", "empty / null", "1 value", "2 values", "3+ values"]
    assert column(spark, values, "array<string>", coverage_bucket("v")) == ["empty", "empty", "partial", "dense", "dense"]
    assert column(spark, values, "array<string>", has_any_code("v", ["a"])) == [False, False, True, True, False]
    assert column(spark, [["b", None]], "array<string>", has_any_code("v", ["a"])) == [False]


def test_strata(spark):
    rows = [(" ", None, [], None), ("\n", None, None, None), (None, "x", None, None), ("", "", ["p"], "y" * 200),
            (None, None, None, "y" * 199), (None, None, [], "y" * 200)]
    df = spark.createDataFrame(rows, "a string, b string, p array<string>, d string")
    plain = [r[0] for r in df.select(richness_stratum(["a", "b"], "p")).collect()]
    long = [r[0] for r in df.select(richness_stratum(["a", "b"], "p", "d")).collect()]
    assert plain == ["sparse", "rich", "rich", "norm_only", "sparse", "sparse"]
    assert long == ["sparse", "rich", "rich", "rich", "sparse", "rich"]


@pytest.mark.parametrize("codes, patterns, row, want", [
    (["e2c"], [], ("x", None, ["e2c", None]), True),
    ([], [r"[ée]cole\s+de\s+la\s+(?:deuxi|2)[èe]me\s+chance"], ("ÉCOLE de la Deuxième Chance", None, None), True),
    ([], [r"\bretrait[ée]\b"], ("un Retraité", None, None), True),
    ([], [r"18\s*ans"], (None, "18 ans", None), True),
    ([], [r"apprentis\W{1,3}auteuil"], ("Apprentis d'Auteuil", None, None), False),
    ([], [r"(?<!sage-)\bfemmes?\b"], ("sage-femme", None, None), False),
    ([], [r"\bmairie\b"], (None, None, None), False),
    ([], [], ("anything", "x", ["e2c"]), False),
])
def test_bucket_predicate(spark, codes, patterns, row, want):
    df = spark.createDataFrame([row], "nom string, description string, codes array<string>")
    assert df.select(bucket_predicate(codes, patterns, "codes", ["nom", "description"])).first()[0] is want


def test_strip_takes_all_whitespace(spark):
    assert column(spark, ["  a b\t\n", "\n", None], "string", strip(F.col("v"))) == ["a b", "", None]


def test_within_size_counts_bytes(spark):
    assert column(spark, ["a" * 11, "a" * 10, "é" * 5, "é" * 6, None], "string", within_size(F.col("v"), 10)) == [
        False, True, True, False, True]


def test_normalise_uri(spark):
    long = "https://h.test/" + "a" * 2000 + "?sig=1"
    got = column(spark, [long, "s3://b/k", "  HTTPS://h.test/x\n", "", None, "http://h/x", "ftp://h/x", "just-a-key"],
                 "string", normalise_uri("v"))
    assert [(r.uri, r.valid) for r in got] == [
        (long, True), ("s3://b/k", True), ("HTTPS://h.test/x", True), (None, True), (None, True),
        ("http://h/x", False), ("ftp://h/x", False), ("just-a-key", False)]


def test_redact_uri(spark):
    got = column(spark, ["https://u:p@h.test:8443/a/b?x=1#frag", "just-a-key?sig=1", "HTTPS://H.Test/A?x", "https://h:port/x",
                         "https://h:99999/x", "https://[::1/x", "s3://b/k", None], "string", redact_uri("v"))
    assert got == ["https://h.test:8443/a/b", "<uri without scheme>", "https://h.test/A", "<unparseable uri>",
                   "<unparseable uri>", "<unparseable uri>", "s3://b/k", None]


def test_strip_query_and_split(spark):
    assert column(spark, ["https://h/x?a=1?b", "s3://b/k", None], "string", strip_query("v")) == ["https://h/x", "s3://b/k", None]
    got = column(spark, ["s3://b/k/l", "s3://b/", "s3:///k", "https://b/k", None], "string", split_s3("v"))
    assert [(r.bucket, r.key, r.valid) for r in got] == [
        ("b", "k/l", True), (None, None, False), (None, None, False), (None, None, False), (None, None, False)]


def test_payload_text(spark):
    bodies = ['{"prompt": "go", "x": 1}', "plain", '\ufeff{"prompt":"bom"}', '{"a":1}\n{"a":2}', '["prompt"]', '{"x":1}', None]
    got = column(spark, bodies, "string", payload_text("v"))
    assert [r.text for r in got] == ["go", "plain", "bom", '{"a":1}\n{"a":2}', '["prompt"]', '{"x":1}', None]
    assert all(r.error is None for r in got)
    bad = column(spark, [f'{{"prompt": {v}}}' for v in ("null", "42", "[1]", '{"a":1}', '""', '"  \\n"')], "string", payload_text("v"))
    assert all(r.text is None and r.error for r in bad)


def test_artifact_key(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-05-04 23:59:59' ts, 'p' p, 'r' r, explode(array('CSV', 'pdf', null)) f")
    assert [r[0] for r in df.select(artifact_key("ts", "p", "r", "f")).collect()] == [
        "runs/2026/05/04/p/r/output.csv", "runs/2026/05/04/p/r/output.md", "runs/2026/05/04/p/r/output.md"]
