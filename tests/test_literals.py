"""Literal factors: no match without one, and the same counts with and without the index."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import literals
from corpusloom.functions.literals import FactorIndex, factors, fold
from corpusloom.operators import concepts
from corpusloom.operators.rules import Concept


@pytest.mark.parametrize("pattern, expected", [
    ("license", {"license"}), ("licen[sc]e", {"licen"}), (r"\bfoo\b bar", {"foo bar"}), ("(?:abc|de)x", {"abc", "de"}), ("(abc)?d", {"d"}), ("(abc)+", {"abc"}),
    ("a|b*", set()), ("[0-9]+", set()), (r"\d{2}\s*ans", {"ans"}), ("(?<!sage-)FEMME", {"femme"}), ("étudiant", {"tudiant"}), ("x{2,3}y", {"y"}),
    (r"\p{L}abc", set()), ("[[a]]b", set()), ("[a&&b]c", set()), ("(?x) a b", set()), ("", set()), ("lim(?:ite)?", {"lim"}), ("(?:a(?:bc|cd)|xyz)", {"bc", "cd", "xyz"})])
def test_factors(pattern, expected):
    assert factors(pattern) == expected


PIECES = st.sampled_from(["a", "b", "ab", "ba", "c", "[ab]", "(?:ab|c)", "(?:a|bc)+", "(b)?", "c*", "a{2}", r"\b", "(?=a)", "."])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=6), st.text("abcABC ", max_size=30))
def test_a_match_holds_a_factor(pieces, text):
    pattern = "".join(pieces)
    needed = factors(pattern)
    for m in re.finditer(pattern, text, re.I):
        assert not needed or any(f in m[0].lower() for f in needed) or "(?=" in pattern and any(f in text.lower() for f in needed)


def test_letters_that_match_another_case(spark):
    df = spark.createDataFrame([("ma\u017fk",), ("MAS\u212a",), ("L\u0130MIT",), ("l\u0131mit",), ("other",)], "t string")
    dictionary = [Concept("c", "mask", ["mask"]), Concept("c", "limit", ["limit"])]
    got = [{t.concept for t in r.tags} for r in concepts.with_tags(df, ["t"], dictionary, ["t"]).collect()]
    plain = [{c.name for c, hit in zip(dictionary, r) if hit} for r in df.select(*[concepts.hit_count(F.col("t"), c) for c in dictionary]).collect()]
    assert got == plain and got[0] == {"mask"} and got[2] == got[3] == {"limit"}


def test_many_concepts_count_as_without_the_index(spark, sf):
    syllables = "th er en on ti re an in de le st".split()
    dictionary = [Concept("s", a + b, [f"{a}{b}", f"{a}[a-z]{b}e", f"(?:{b}{a}|{a}n)\\b"]) for a in syllables for b in syllables]
    assert len(FactorIndex([p for c in dictionary for p in c.patterns]).words) > 100
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    got = {(r.doc_id, t.concept): t.hits for r in concepts.with_tags(docs, ["text"], dictionary, ["doc_id"]).collect() for t in r.tags}
    plain = {}
    for r in docs.collect():
        for c in dictionary:
            if n := sum(len(re.findall(p, r.text or "", re.I)) for p in c.patterns):
                plain[r.doc_id, c.name] = n
    assert got == plain and got


def test_few_patterns_run_on_a_text(spark):
    index = FactorIndex([f"word{i}x[0-9]" for i in range(200)])
    df = spark.createDataFrame([("here is WORD7x1 and word19x", )], "t string")
    assert set(df.select(index.present(fold(F.col("t")))).first()[0]) == {"word7x", "word19x"}


@pytest.mark.parametrize("pattern, plain", [
    ("ther[a-z]th", True), ("(?:un|deux) mots", True), ("a{2,3}b+?", True), ("[0-9]{3}-[0-9]{4}", True), ("", True),
    ("There", False), ("[A-z]x", False), ("[^a]b", False), (r"\bword", False), (r"a\s", False), ("a.c", False), ("é", False), ("(?i:a)b", False),
    ("(a)\\1", False), ("a(?=b)", False), ("^a", False), ("a&&b", False), ("[a", False)])
def test_patterns_of_given_characters_run_on_the_folded_text(pattern, plain):
    assert literals.folds(pattern) is plain


def test_folded_counts_are_the_counts_of_case_insensitive_matching(spark):
    patterns = ["st[a-z]", "k[i-k]", "[s-t]i+", "(?:is|sk)", "i[a-z]s", "x{2}", "ther[a-z]th", "[0-9]k"]
    texts = ["ſTa ſtſ", "KKkK Kİ ki", "Sİı tII ſı", "ıs İS ſK", "iſs İİS", "XxXX xXx", "THERATHERATH therath", "7K 8K", "éSTÉsté ΣIS ẞIS ŉIS", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", literals.fold(F.col("t")).alias("f"))
    for p in patterns:
        concept = Concept("c", "c", [p])
        assert literals.folds(p)
        rows = df.select("t", concepts.hit_count(F.col("t"), concept, F.col("f")).alias("a"), concepts.hit_count(F.col("t"), concept).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], p


def test_plain_patterns_take_no_case_insensitive_search(spark):
    df = spark.createDataFrame([("Theren",)], "t string")
    plan = concepts.with_tags(df, ["t"], [Concept("c", "c", ["theren", "ther[a-z]n"])], [])._jdf.queryExecution().optimizedPlan().toString()
    assert "ther[a-z]n" in plan and "(?iU)" not in plan
