from collections import Counter

import pytest
from edge import clashing, edge, empty, rows_of, words

from corpusloom.llm import quality


def counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(inside)


@pytest.fixture(scope="module")
def model(spark, sf):
    return quality.fit_on(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet"))


def test_counts_equal_a_plain_count(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(edge(spark).select("doc_id", "text"))
    for r in quality.quality(docs, model).collect():
        q = r["_q"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == counts(r.text)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert 0 <= q.score <= 1 and q.kept == (not q.base_failed and q.score >= quality.KEEP_AT)


def test_labelled_rows_are_judged_as_labelled(spark, sf, model):
    # fitted on another table of the same kind: every row here is held out
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.quality(docs, quality.fit_on(docs.where("doc_id % 2 = 0"), labels)).join(labels, "doc_id").where("doc_id % 2 = 1 and not _q.base_failed")
    good = judged.where("quality = 1")
    assert good.where("_q.kept").count() >= 0.97 * good.count()
    bad = judged.where("quality = 0")
    assert bad.where("not _q.kept").count() >= 0.9 * bad.count()


def test_rows_and_columns_pass_through(spark, model):
    docs = clashing(spark)
    out = quality.quality(docs, model)
    assert out.columns[:5] == docs.columns[:5] and out.count() == docs.count()
    assert quality.quality(empty(spark), model).count() == 0
    assert rows_of(quality.quality(edge(spark), model).select("doc_id", "_q.*")) == rows_of(quality.quality(edge(spark).repartition(5), model).select("doc_id", "_q.*"))


def test_without_labels_the_base_rule_decides(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_on(edge(spark), none)
    assert {r["_q"].score for r in quality.quality(edge(spark), model).collect()} == {1.0}


def test_long_texts_and_repeated_ids_teach_within_the_bound(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, y, share: seen.append((len(texts), int(y.sum()), min(map(len, texts.to_pylist())), share)))
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 30)
    hot = spark.range(60_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    long = spark.range(10, 500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a long text "), 5_000).alias("text"))
    docs = hot.union(long).repartition(211)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.fit_on(docs, labels)
    assert seen[0][:2] == (60, 30) and 0.4 < seen[0][3] < 0.6
    quality.fit_on(long, labels.union(labels))
    assert seen[1][:2] == (60, 30) and seen[1][2] == 8_192


def test_the_sample_is_cut_before_it_is_shuffled(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.tables import threshold_sample
    rows = spark.range(200_000).select("id", (F.col("id") % 2).alias("y")).repartition(20)
    picked = threshold_sample(rows, "y", 300, F.xxhash64("id"))
    assert {r.y: r["count"] for r in picked.groupBy("y").count().collect()} == {0: 300, 1: 300}
    plan = picked._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window"):]
    assert window.index("BroadcastHashJoin") > window.index("hashpartitioning(y")  # the join with the counts is below the shuffle
    assert "SortMergeJoin" not in plan
