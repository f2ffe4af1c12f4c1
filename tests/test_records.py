"""Extraction records: values, contract, evidence, comparison, readers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.fixed_values import CONTRACT
from corpusloom.operators import compare, records
from corpusloom.operators.rules import contract_from_schema, field_rules
from corpusloom.plans import QUERIES
from corpusloom.sources.records import LINE_ORDER, merge_runs, read_lines, read_records, resolve_outputs
from corpusloom.sources.tables import export_jsonl, write_subset

FIELDS = field_rules(CONTRACT)


def parse(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    return records.parse_lines(df)


def record(sid="a", pub=None, pre=None, **extra):
    return json.dumps({"service_id": sid, "publics_extended": pub, "prerequis_extended": pre, **extra})


def fields_of(spark, pub):
    rec = records.good_records(parse(spark, [record(pub=pub)]))
    rows = rec.select(F.inline(records.record_fields(FIELDS))).where("field in ('pub.age_min', 'pub.qualificateurs')").collect()
    return {r.field: (r.filled, r.value) for r in rows}


@pytest.mark.parametrize("value, filled", [
    (None, False), ([], False), ({}, False), (False, True), (0, True), ("", True), ([None], True), ({"value": None}, True), ("x", True)])
def test_filled(spark, value, filled):
    assert fields_of(spark, {"age_min": value})["pub.age_min"][0] is filled


@pytest.mark.parametrize("a, b, equal", [
    (1, 1.0, True), (1, "1", False), (True, 1, False), ({"value": 3, "source_field": "d"}, 3, True),
    (["b", "a"], ["a", {"value": "b"}], True), (["a", "a"], ["a"], False), ([1, "1"], ["1", 1], True), ({"x": 1}, {"x": 1}, True),
    ("a", ["a"], False), ("null", None, False)])
def test_comparable_values(spark, a, b, equal):
    got = [fields_of(spark, {"age_min": v})["pub.age_min"][1] for v in (a, b)]
    assert (got[0] == got[1]) is equal


def test_parse_keeps_every_line_accounted_for(spark):
    lines = ["", "   ", "{bad", "[1]", "42", '{"x":1}', '{"service_id":""}', '{"service_id":null}', record("ok"), '  {"service_id":"sp"}  ']
    parsed = parse(spark, lines)
    assert {r.line_no: r.problem for r in parsed.collect()} == {
        2: "bad_json", 3: "not_object", 4: "not_object", 5: "no_id", 6: "no_id", 7: "no_id", 8: None, 9: None}
    assert [r.id for r in records.good_records(parsed).orderBy("line_no").collect()] == ["ok", "sp"]


def test_non_object_group_has_no_fields(spark):
    rec = records.good_records(parse(spark, [json.dumps({"service_id": "a", "publics_extended": 3})]))
    assert records.record_coverage(rec, FIELDS).first().pub_filled_n == 0


def test_contract(spark):
    pub = {"age_min": 130, "age_max": "x", "statut_principal": {"value": "king"}, "qualificateurs": ["femme", "z"],
           "minima_sociaux": None, "type_contrat": "cdi", "tags": 1, "statut_jeune": ["etudiant_boursier"]}
    pre = {"plafond_ressources": False, "revenu_fiscal_max_eur_par_part": -1, "mode_accueil_urgence": None}
    rows = records.validate_contract(records.good_records(parse(spark, [record(pub=pub, pre=pre)])), FIELDS).collect()
    assert {(r.field, r.rule, r.value) for r in rows} == {
        ("pub.age_min", "range", "130"), ("pub.age_max", "type", "x"), ("pub.statut_principal", "enum", "king"),
        ("pub.qualificateurs", "enum", "z"), ("pub.minima_sociaux", "null_list", None), ("pub.type_contrat", "type", "cdi"),
        ("pub.tags", "unknown_field", None), ("pre.revenu_fiscal_max_eur_par_part", "range", "-1")}


def test_contract_from_schema():
    schema = {"definitions": {"g": {"properties": {
        "n": {"type": ["integer", "null"], "minimum": 0}, "b": {"type": "boolean"},
        "l": {"type": "array", "items": {"enum": ["x"]}}, "e": {"type": ["string", "null"], "enum": ["y", None]}}}}}
    assert [(r.field, r.kind, r.allowed, r.minimum) for r in contract_from_schema(schema)] == [
        ("n", "int", None, 0), ("b", "bool", None, None), ("l", "list", ["x"], None), ("e", "enum", ["y"], None)]


def test_evidence(spark):
    good = {"value": 25, "source_field": "conditions", "evidence_substring": "26 ans"}
    pub = {"age_max": good, "age_min": 3, "statut_principal": {**good, "evidence_substring": "27 ans"},
           "qualificateurs": [{**good, "source_field": "nom"}, "bare"]}
    recs = records.good_records(parse(spark, [record("a", pub), record("gone", {"age_max": good})]))
    corpus = spark.createDataFrame([("a", "moins de 26 ans")], "id string, cond string")
    rows = records.validate_evidence(records.evidence_items(recs, FIELDS), corpus, "id", {"conditions": "cond"}).collect()
    assert sorted((r.id, r.field, r.verdict) for r in rows) == [
        ("a", "pub.age_max", "ok"), ("a", "pub.age_min", "bare_value"), ("a", "pub.qualificateurs", "bare_value"),
        ("a", "pub.qualificateurs", "unknown_source"), ("a", "pub.statut_principal", "not_found"), ("gone", "pub.age_max", "no_row")]


def test_top_values(spark):
    lines = [record(str(i), {"qualificateurs": ["femme", 2.5, {"value": None}, {"x": 1}], "age_min": i % 2, "age_max": 1.5}) for i in range(3)]
    rows = records.field_top_values(records.good_records(parse(spark, lines)), FIELDS).collect()
    assert sorted((r.field, r.value, r.n, r["rank"]) for r in rows) == [
        ("pub.age_min", "0", 2, 1), ("pub.age_min", "1", 1, 2),
        ("pub.qualificateurs", "femme", 3, 1), ("pub.qualificateurs", "null", 3, 2)]


def test_long_strings_repeated_keys_and_nan(spark):
    rows = parse(spark, ['{"service_id":"a","service_id":"b"}', '{"service_id":"n","x":NaN}']).select("id", "problem").collect()
    assert {(r.id, r.problem) for r in rows} == {("b", None), ("n", None)}
    from pyspark.sql import functions as F
    big = spark.range(1).select(F.concat(F.lit('{"service_id":"'), F.repeat(F.lit("x"), 20_000_001), F.lit('"}')).alias("line"))
    assert records.parse_lines(big).select(F.length("id").alias("n"), "problem").first() == (20_000_001, None)


def test_comparison_invariants(spark):
    a = records.good_records(parse(spark, [record("x", {"age_min": 1}), record("y", {"age_min": 2}), record("z", {"age_min": None})]))
    b = records.good_records(parse(spark, [record("y", {"age_min": 2.0}), record("z", {"age_min": 5, "age_max": 6}), record("w")]))
    assert {r.side: r.n for r in compare.align_runs(a, b).collect()} == {"common": 2, "only_a": 1, "only_b": 1}
    pairs = compare.paired(a, b, FIELDS)
    row = {r.field: r for r in compare.compare_fields(pairs).collect()}["pub.age_min"]
    assert (row.filled_a_n, row.filled_b_n, row.both_n, row.agree_n, row.agree_pct) == (1, 2, 1, 1, 100.0)
    assert {r.field: r for r in compare.compare_fields(pairs).collect()}["pub.qualificateurs"].agree_pct is None
    top = compare.top_disagreements(pairs).collect()
    assert [(r.id, r.diffs_n, [d.field for d in r.details]) for r in top] == [("z", 2, ["pub.age_min", "pub.age_max"]), ("y", 0, [])]


def test_files_in_line_order(spark, tmp_path):
    (tmp_path / "r1.jsonl").write_text("\n".join([record("a", {"age_min": 1}), "", "{bad", record("a", {"age_min": 2}), record("b")]) + "\n")
    good, bad = read_records(spark, str(tmp_path))
    assert bad.count() == 1
    last = records.dedupe_last(good, "id", list(LINE_ORDER))
    got = {r.id: r.v for r in last.select("id", F.try_variant_get("record", "$.publics_extended.age_min", "int").alias("v")).collect()}
    assert got == {"a": 2, "b": None}


def test_merge_counts_files(spark, tmp_path):
    (tmp_path / "r1.jsonl").write_text("x\n\n  \ny\n")
    lines = read_lines(spark, str(tmp_path)).withColumn("run_id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    manifest = spark.createDataFrame([(1, "r1"), (2, "r2")], "chunk_id int, run_id string")
    assert sorted(tuple(r) for r in merge_runs(manifest, lines).collect()) == [
        ("TOTAL", "", "", 2), ("chunk 1", "r1", "ok", 2), ("chunk 2", "r2", "MISSING", 0)]


def test_first_existing_path(spark):
    candidates = spark.createDataFrame([("r1", 1, "a"), ("r1", 2, "b"), ("r2", 1, "c")], "run_id string, priority int, path string")
    listing = spark.createDataFrame([("b",), ("z",)], "path string")
    assert {r.run_id: r.path for r in resolve_outputs(candidates, listing).collect()} == {"r1": "b", "r2": None}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None, ["x"]), (2, None, 0.5, None)], "id int, t string, s double, a array<string>")
    export_jsonl(df.withColumn("chunk_id", F.col("id")), ["id", "t", "s", "a"], str(tmp_path / "j"), ["chunk_id"])
    text = "".join(p.read_text() for p in (tmp_path / "j" / "chunk_id=1").glob("part-*"))
    assert text == '{"id":1,"t":"é","s":null,"a":["x"]}\n'
    write_subset(df, spark.createDataFrame([(2,), (9,)], "id int"), str(tmp_path / "p"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [2]


@pytest.mark.parametrize("depth, problem", [(900, None), (998, None), (1_001, "too_deep"), (100_000, "too_deep")])
def test_deep_lines_are_quarantined_and_leave_the_others_alone(spark, depth, problem):
    deep = '{"service_id":"deep","k":' + "[" * depth + "1" + "]" * depth + "}"
    text = '{"service_id":"text","k":"' + "[{" * 5_000 + '\\"' * 20_000 + '"}'
    parsed = parse(spark, [record("ok"), deep, text, "[" * 200_000, "{bad"])
    assert {r.line_no: r.problem for r in parsed.select("line_no", "problem").collect()} == {0: None, 1: problem, 2: None, 3: "too_deep", 4: "bad_json"}


def test_repeated_keys_do_not_depend_on_what_ran_before(spark):
    from corpusloom.functions.uris import payload_text
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    df = spark.createDataFrame([('{"prompt":"a","prompt":"b"}',)], "body string")
    assert df.select(payload_text("body").alias("p")).select("p.*").first() == ("b", None)


def test_runs_are_joined_before_fields_are_unfolded(spark):
    runs = [spark.range(3).selectExpr("cast(id as string) AS id", "parse_json('{}') AS record") for _ in "ab"]
    plan = compare.paired(*runs, field_rules(CONTRACT))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "transform(" in above and "transform(" not in below


@pytest.mark.parametrize("name", ["top_disagreements", "compare_fields"])
def test_queries_on_two_runs_join_records_and_no_unfolded_fields(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert below.count("Window [") == 2  # the last record per id of both runs
    assert "transform(" not in below and "transform(" in above
