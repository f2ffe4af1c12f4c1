import importlib
import sys

import corpus_pipeline
import pytest
from edge import edge, empty
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import language, quality
from test_neardup import plain


def test_stages_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "mixing", "bpe"]
    names = set(entry.queries())
    assert "pipeline" in names and {n for n in range(1, 14)} == {int(k[2:].split("_")[0]) for k in names if k.startswith("op")}


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, sf)
    model = quality.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    judged = {r.doc_id: (len((r.text or "").split()), r["_q"]) for r in quality.quality(docs, model).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, (_, q) in judged.items() if q.kept}
    spoken = stages["language_id"](spark, kept, sf)
    assert spoken.columns == columns
    trees = language.train_on(kept)
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in language.identify(kept, trees).collect() if r["_l"].accepted}
    single = stages["near_dedup"](spark, spoken, sf)
    assert single.columns == columns
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in plain(rows, 5, 80).items() if i == c)
    mixed = stages["mixing"](spark, single, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    coded = stages["bpe"](spark, mixed, sf)
    assert coded.count() == mixed.count()
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, coded.collect()))


@pytest.mark.parametrize("docs", [edge, empty])
def test_stages_take_edge_rows(spark, sf, docs):
    rows = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf)
        assert name == "bpe" or out.columns == rows.columns
        out.count()


OWN = ("_q", "_l", "_key", "_s", "_fine", "_copies", "_block", "_slot", "_copy", "_weight", "_tokens", "row", "own_id", "t", "u", "group", "n_shingles",
       "component_id", "first", "_rank", "_rows", "turn", "y", "found", "ids", "decoded", "id", "fine", "tokens", "kept")


def test_stages_keep_columns_named_like_their_own(spark, sf):
    docs = edge(spark).withColumns({name: F.concat(F.lit(f"{name} "), F.coalesce("source", F.lit(""))) for name in OWN}).cache()
    for stage, function in corpus_pipeline.STAGES[:4]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[name] == f"{name} {r.source or ''}" for name in OWN), stage


def test_near_dedup_keeps_each_text_once_whatever_the_ids(spark, sf):
    from edge import BASE
    other = "an entirely different passage about seven ships that sail to the far north before the long winter begins again"
    rows = [(1, BASE, "en", "x", 1), (1, BASE, "en", "x", 1), (1, BASE, "en", "x", 1), (5, BASE, "en", "x", 1), (5, other, "en", "x", 1),
            (None, BASE, "en", "x", 1), (None, BASE, "en", "x", 1), (None, BASE + " extra", "en", "x", 1), (None, "third text of " + other[::-1], "en", "x", 1),
            (7, "", "en", "x", 1), (7, None, "en", "x", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, edge(spark).schema).repartition(4)
    out = sorted(map(repr, dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).select("doc_id", "text").collect()))
    kept = [(1, BASE), (5, other), (None, "third text of " + other[::-1]), (7, ""), (7, None), (None, None)]
    assert out == sorted(map(repr, spark.createDataFrame(kept, "doc_id long, text string").collect()))


def test_entry_works_without_the_subpackage(monkeypatch):
    for missing in ("corpusloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, missing, None)
    import corpusloom.llm
    monkeypatch.delattr(corpusloom.llm, "queries", raising=False)
    with pytest.warns(UserWarning):
        bare = importlib.reload(entry)
    assert not any(k.startswith("op") or k == "pipeline" for k in bare.queries()) and bare.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_entry_works_without_a_library_of_the_subpackage(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("corpusloom.llm.") or m == "corpus_pipeline"]
    import corpusloom.llm
    held = {m: sys.modules.pop(m) for m in gone}
    attributes = {k: getattr(corpusloom.llm, k) for k in list(vars(corpusloom.llm)) if f"corpusloom.llm.{k}" in held}
    for k in attributes:
        delattr(corpusloom.llm, k)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    try:
        with pytest.warns(UserWarning):
            bare = importlib.reload(entry)
        assert "sample_manifest" in bare.queries() and "op4_bpe" not in bare.queries()
    finally:
        monkeypatch.undo()
        for m in [m for m in sys.modules if m.startswith("corpusloom.llm.") or m == "corpus_pipeline"]:
            del sys.modules[m]
        sys.modules.update(held)
        for k, v in attributes.items():
            setattr(corpusloom.llm, k, v)
        importlib.reload(entry)
