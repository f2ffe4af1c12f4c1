import pytest
from edge import clashing, edge, empty

from corpusloom.llm import licenses


def plain(rows, templates=licenses.TEMPLATES):
    """Every window of every text against every template, by counting shingles."""
    found = {}
    for i, text in rows:
        words = licenses.template_words(text or "")
        for name, template in templates.items():
            own = set(licenses.grams(licenses.template_words(template)))
            size = len(licenses.template_words(template))
            for k in range(0, len(words), size):
                share = len(set(licenses.grams(words[k:k + 2 * size])) & own) / len(own)
                if share * 100 >= licenses.CONTAINED:
                    best, n, first = found.get((i, name), (0, 0, k))
                    found[i, name] = (max(best, share), n + 1, first)
    return found


@pytest.mark.parametrize("segment", [4096, 64])
def test_planted_licenses(spark, segment, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", segment)
    filler = " ".join(f"w{k}" for k in range(97))
    rows = [(i, f"{filler[:i * 7]} {text.upper() if i % 2 else text}. {filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    rows += [(100, "Permission is hereby granted free of charge to any man obtaining a copy of this software and associated documentation files"),
             (101, "license license permission"), (102, filler), (103, "All\nrights -- reserved")]
    got = {(r.doc_id, r.license): (r.containment, r.windows, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows) and all((i, name) in got for i, name in enumerate(licenses.TEMPLATES)) and (103, "All rights reserved") in got


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.license): (r.containment, r.windows, r.first_word) for r in licenses.op9_license_scans(spark, sf).collect()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()]) and got


def test_a_whole_license_text_as_template(spark):
    import random
    rnd = random.Random(5)
    whole = " ".join(rnd.choice("licence grant copy work software notice permit terms party patent claim any the of to".split()) + str(rnd.randrange(40)) for _ in range(1500))
    words = whole.split(" ")
    templates = {"long": whole, "MIT": licenses.TEMPLATES["MIT"]}
    filler = [f"w{k}" for k in range(900)]
    rows = [(1, " ".join(filler[:333] + words + filler)), (2, " ".join(words[:1300])), (3, " ".join(words[:1100] + filler)),
            (4, " ".join(filler)), (5, " ".join(words[:700] + ["changed"] + words[701:]) + " Released under the MIT License")]
    got = {(r.doc_id, r.license): (r.containment, r.windows, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == plain(rows, templates) and {k for k in got if k[1] == "long"} == {(1, "long"), (2, "long"), (5, "long")} and (5, "MIT") in got


def test_texts_made_of_license_lines(spark):
    rows = [(1, "All rights reserved. " * 3_000), (2, " ".join(licenses.TEMPLATES.values()) * 20)]
    got = {(r.doc_id, r.license): (r.containment, r.windows, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows) and got[1, "All rights reserved"] == (1.0, 3_000, 0)


def test_no_python_on_the_main_path(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_edges(spark):
    assert licenses.scan(edge(spark)).count() == 0 and licenses.scan(clashing(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0
    rows = [(None, "Released under the MIT License."), (1, None), (2, "")]
    assert [r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == ["MIT"]
