"""Concept rules on French text, session-log lines, segments on planted rows."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.fixed_values import BUCKETS
from corpusloom.operators import concepts, segments, sessions
from corpusloom.operators.rules import Concept, ConflictRule, buckets, concept_dictionary


@pytest.mark.parametrize("text, low, high", [
    ("moins de 26 ans", None, 25), ("jusqu'à 30 ans", None, 30), ("25 ans inclus", None, 25), ("60 ans et plus", 60, None),
    ("à partir de 18 ans", 18, None), ("+50 ans", 50, None), ("plus de 18 ans", 18, None), ("16-25 ans", 16, 25), ("de 16 à 25 ans", 16, 25),
    ("Âge minimum : 0 Âge maximum : 120", None, None), ("de 0 à 120 ans", None, None), ("rien", None, None), (None, None, None),
    ("18 ans et plus, moins de 65 ans", 18, 64)])
def test_age_bounds(spark, text, low, high):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(concepts.age_bounds(F.col("t")).alias("a")).select("a.*").first()
    assert (row.age_min, row.age_max) == (low, high)


def test_direction_and_role(spark):
    df = spark.createDataFrame([("sans condition de ressources",), ("sous conditions de ressources",), ("autre",)], "t string")
    got = [r[0] for r in df.select(concepts.tri_state(F.col("t"), [r"\bconditions?\s+de\s+ressources?"], [r"\bsans\s+conditions?\s+de\s+ressources?"])).collect()]
    assert got == [False, True, None]
    df = spark.createDataFrame([("obtenir un CDI",), ("salarié en CDI",), ("néant",)], "t string")
    got = [r[0] for r in df.select(concepts.concept_role(F.col("t"), [r"\bCDI\b"], [r"\b(?:trouver|obtenir)\s+(?:un\s+)?CDI\b"])).collect()]
    assert got == ["goal", "status", None]


DICTIONARY = concept_dictionary({"pub": {"etudiant": [r"\b[ée]tudiant[\.s]?"], "femme": [r"(?<!sage-)(?<!sage\s)\bfemme[\.s]?\b"]},
                                 "age": {"age": [r"\b18\s*ans", r"\d+\s*ans"]}})


def test_scan_counts_overlaps_and_sources(spark):
    rows = [(1, "s1", "Étudiants de 18 ans, étudiant", None), (2, None, "sage-femme", "FEMME"), (3, None, "18 ans", "x"), (4, "s2", None, None)]
    df = spark.createDataFrame(rows, "id int, source string, a string, b string")
    got = {r.concept: r for r in concepts.concept_scan(df, ["a", "b"], "source", DICTIONARY).collect()}
    assert (got["etudiant"].rows_n, got["etudiant"].hits_n, got["etudiant"].share, got["etudiant"].top_source) == (1, 2, 0.25, "s1")
    assert (got["femme"].rows_n, got["femme"].hits_n, got["femme"].sources_n) == (1, 1, 1)
    assert (got["age"].rows_n, got["age"].hits_n, got["age"].sources_n, got["age"].top_source) == (2, 4, 2, "null")


def test_examples_show_the_first_match_in_context(spark):
    text = "x" * 30 + " étudiant " + "\n" + "y" * 30 + " étudiant"
    df = spark.createDataFrame([(i, text) for i in range(5)], "id int, t string")
    rows = concepts.concept_examples(df, "id", ["t"], DICTIONARY, 2).where("concept = 'etudiant'").collect()
    assert sorted(r.id for r in rows) == [0, 1]
    assert rows[0].context == "x" * 19 + " étudiant  / " + "y" * 18


def test_context_of_a_pattern_with_a_dot(spark):
    df = spark.createDataFrame([("revenu fiscal\nune part " + "z" * 30 + " revenu par part",)], "t string")
    got = df.select(concepts.match_context(F.col("t"), ["revenu.{0,40}part"], around=2)).first()[0]
    assert got == "z revenu par part"


def test_age_wordings(spark):
    cases = {"18–25 ans": (18, 25), "dans la limite de 25 ans": (None, 25), "maximum 25 ans": (None, 25), "25 ans max.": (None, 25),
             "jusqu’à 30 ans": (None, 30), "jusqu'à 30 ans": (None, 30), "limite de 25 ans": (None, 25), "limite 25 ans": (None, 25), "maximum de 25 ans": (None, 25),
             "Limite de 30 ans, 18 ans minimum": (18, 30), "illimité 25 ans": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.a.age_min, r.a.age_max) for r in df.select("t", concepts.age_bounds(F.col("t")).alias("a")).collect()}
    assert got == cases


def test_stem_gate_changes_nothing(spark):
    df = spark.createDataFrame([(1, "s", "A LICENSE b"), (2, "s", "none")], "id int, source string, t string")
    gated, plain = ([Concept("c", "lic", ["license"], stem)] for stem in ("licen", None))
    assert concepts.concept_scan(df, ["t"], "source", gated).collect() == concepts.concept_scan(df, ["t"], "source", plain).collect()


def test_conflicts(spark):
    df = spark.createDataFrame([(1, ["rqth", "femme"], ["handicap"]), (2, ["rqth"], ["handicap", "rqth"]), (3, None, ["handicap"]), (4, ["rqth"], None)],
                               "id int, tags array<string>, publics array<string>")
    rules = [ConflictRule("under_specification", "publics", "handicap", "rqth", unless=["rqth"]), ConflictRule("contradiction", "publics", "handicap", "femme")]
    got = concepts.detect_conflicts(df, "id", "tags", "publics", rules).collect()
    assert sorted((r.id, r.type, r.concept) for r in got) == [(1, "contradiction", "femme"), (1, "under_specification", "rqth")]


def test_session_lines(spark):
    def say(*blocks):
        return json.dumps({"type": "assistant", "message": {"content": list(blocks)}})

    text = {"type": "text", "text": "  hi \n"}
    tool = {"type": "tool_use", "name": "grep", "id": "t1", "input": {"q": 1}}
    lines = ["", "  \t", "not json " + "z" * 600, "[1]", say(text, {"type": "text", "text": " "}, tool, {"type": "text", "text": "yo"}), say({"type": "text", "text": " "}),
             say(), json.dumps({"type": "assistant"}), json.dumps({"type": "user", "message": {"content": [
                 {"type": "tool_result", "tool_use_id": "t1", "content": "c" * 3000}, {"type": "text"}, {"type": "tool_result", "tool_use_id": "t2", "content": [1]}]}}),
             json.dumps({"type": "result", "subtype": "success", "duration_ms": 5, "other": 1}), json.dumps({"type": "system", "subtype": "init", "message": "m"}),
             json.dumps({"type": "error", "code": 7}), json.dumps({"type": "odd"}), json.dumps({"x": 1})]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    got = sessions.normalise_session(df).orderBy("line_no", "block_no").collect()
    assert [(r.line_no, r.block_no, r.event_type) for r in got] == [
        (2, 0, "raw_line"), (3, 0, "raw_line"), (4, 0, "assistant_message"), (8, 0, "tool_result"), (8, 1, "tool_result"), (9, 0, "result"),
        (10, 0, "system"), (11, 0, "claude_error"), (12, 0, "message"), (13, 0, "message")]
    by_line = {(r.line_no, r.block_no): r for r in got}
    assert len(by_line[2, 0].text) == 500 and by_line[4, 0].text == "hi\n\nyo"
    assert [(b.type, b.text, b.name, b.input) for b in by_line[4, 0].blocks] == [
        ("text", "hi", None, None), ("tool_use", None, "grep", '{"q":1}'), ("text", "yo", None, None)]
    assert len(by_line[8, 0].text) == 2000 and by_line[8, 1].text == "[1]" and by_line[8, 1].tool_use_id == "t2"
    assert json.loads(by_line[9, 0].payload) == {"duration_ms": 5, "duration_api_ms": None, "num_turns": None, "total_cost_usd": None,
                                                 "usage": None, "subtype": "success"}
    assert json.loads(by_line[11, 0].payload) == {"type": "error", "code": 7} and by_line[12, 0].text == "odd" and by_line[13, 0].text is None


def test_segments_on_planted_rows(spark):
    rules = buckets(BUCKETS)
    parents = spark.createDataFrame([
        ("p1", "Mission Locale de X", None, None), ("p2", "x", None, ["esat", None]), ("p3", "Mairie", None, ["aci"]), ("p4", "x", "une association", []),
        ("p5", None, None, ["maison-departementale-de-lautonomie"]), ("p6", "autre", None, None)], "id string, nom string, description string, codes array<string>")
    children = spark.createDataFrame([(1, "s", "p1"), (2, "s", "p2"), (3, "s", "p3"), (4, "t", "p4"), (5, "t", "p5"), (6, "t", "p6"), (7, "u", None), (8, "u", "gone"), (1, "s", "p4")],
                                     "cid int, source string, sid string")
    tagged = segments.tag_buckets(parents, rules, "codes", ["nom", "description"])
    counts = {r.bucket: (r.parents_n, r.children_n) for r in segments.segment_counts(children, tagged, rules, "cid", "sid").collect()}
    assert len(counts) == 37 and counts["Mission Locale"] == (1, 1) and counts["MDPH (autonomie)"] == (1, 1) and counts["CAF"] == (0, 0)
    assert {r.id: r.tier for r in segments.min_tier(children, tagged, "cid", "sid").collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: None, 7: None, 8: None}
    cover = [r.children_n for r in segments.tier_coverage(children, tagged, [1, 2, 3], "cid", "sid").orderBy("max_tier").collect()]
    assert cover == [3, 4, 5]
    assert segments.out_of_scope(children, tagged, "cid", "sid").first().children_n == 3
    assert segments.children_of(children, tagged, "sid", tier=1).count() == 3
