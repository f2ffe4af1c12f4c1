import zlib

import numpy as np
import pyarrow as pa
import pytest
from edge import clashing, edge, empty, rows_of, words
from pyspark.sql import functions as F

from corpusloom.llm import passages


@pytest.fixture(scope="module")
def model(spark, sf):
    return passages.fit_on(spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.1/labels.parquet"))


def test_held_out_labels(spark, sf):
    judged = passages.op12_passage_quality(spark, f"{sf}/../sf0.1").join(spark.read.parquet(f"{sf}/../sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (judged.predicted == (judged.score >= 0.7)).all() and judged.score.between(0, 1).all()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert len(good) > 500 and len(bad) > 100
    assert (good.predicted == 1).mean() >= 0.98 and (bad.predicted == 0).mean() >= 0.93
    for low, high in ((0.0, 0.2), (0.8, 1.01)):  # probabilities mean what they say
        own = judged[(judged.score >= low) & (judged.score < high)]
        assert abs(own.quality.mean() - own.score.mean()) < 0.08


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = passages.fit_on(docs, labels), passages.fit_on(docs, turned)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    row = passages.op12_passage_quality(spark, sf).first()
    assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)


def plain_passages(text):
    w = words(text)
    return [w[i:i + passages.PASSAGE] for i in range(0, len(w), passages.PASSAGE)]


def test_scores_by_the_definition(spark, sf, model):
    """One document at a time, each passage encoded by itself: the same vectors, weights and scores."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(30).collect()] + [r.text for r in edge(spark).select("text").collect()]
    found = passages.scan(pa.array(texts, pa.string()), model)
    for k, text in enumerate(texts):
        parts = plain_passages(text)
        assert found["n_passages"][k] == len(parts)
        if not parts:
            assert found["score"][k] == model["empty"] and found["top_passage"][k] == -1
            continue
        if len(text) > 100_000 or len(parts) > 60:
            continue
        h = []
        for where, families, shares in [s for p in passages_text(text) for s in slices_of(p)]:
            for bucket, at in families:
                assert len(at) == 2 and at[-1] == len(bucket)
            means = [model["scores"][b].mean() if len(b) else 0.0 for b, _ in families]
            h.append(np.clip((np.array([*means, *shares[0]]) - model["mean"]) / model["scale"], -6, 6))
        h = np.array(h)
        gate = (np.tanh(h @ model["v"].T) / (1 + np.exp(-h @ model["u"].T))) @ model["w"]
        weight = np.exp(gate) / np.exp(gate).sum()
        z = (weight[:, None] * h).sum(0) @ model["c"] + model["b"]
        assert abs(found["score"][k] - 1 / (1 + np.exp(-model["slope"] * z - model["shift"]))) < 1e-6
        assert abs(found["top_weight"][k] - weight.max()) < 1e-6 and abs(weight[found["top_passage"][k]] - weight.max()) < 1e-9


def passages_text(text):
    """The texts of the passages, as they stand."""
    import re
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [text[spans[i][0]:spans[min(i + passages.PASSAGE, len(spans)) - 1][1]] for i in range(0, len(spans), passages.PASSAGE)]


def slices_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return list(passages.Encoder().slices(data, np.array([0, len(data)])))


def test_a_bad_passage_counts_wherever_it_stands(spark, sf, model):
    """Attention reads every passage: junk behind, between and before good passages lowers the score."""
    docs = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet").join(spark.read.parquet(f"{sf}/../sf0.1/labels.parquet"), "doc_id")
    good = [r.text for r in docs.where("quality = 1 and n_chars between 400 and 2500").orderBy("doc_id").limit(40).collect()]
    bad = [r.text for r in docs.where("quality = 0 and n_chars > 400").orderBy("doc_id").limit(40).collect()]
    alone = passages.scan(pa.array(good), model)["score"].mean()
    for mixed in ([f"{g}\n{b}\n{b}" for g, b in zip(good, bad)], [f"{b}\n{b}\n{g}" for g, b in zip(good, bad)]):
        assert passages.scan(pa.array(mixed), model)["score"].mean() < alone - 0.1


def test_edges(spark, model):
    def run(df):
        return df.select("doc_id", passages.scored(F.col("text"), model).alias("found")).select("doc_id", "found.*")
    rows = run(edge(spark))
    assert rows_of(rows) == rows_of(run(edge(spark).repartition(5))) == rows_of(run(clashing(spark)))
    assert run(empty(spark)).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.0), (spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], none.schema), 1.0)):
        flat = passages.fit_on(edge(spark), labels)
        assert flat["scores"] is None
        assert {r.score for r in edge(spark).select(passages.scored(F.col("text"), flat).alias("f")).select("f.score").collect()} == {score}


def test_the_sample_keeps_its_bound(spark, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLE_PER_LABEL", 20)
    seen = []
    monkeypatch.setattr(passages, "fit", lambda texts, labels, share: seen.append((len(texts), max(map(len, texts.to_pylist())), share)))
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    rest = spark.range(100, 2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words "), 9_000).alias("text"))
    docs = hot.union(rest).repartition(97)
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    passages.fit_on(docs, labels)
    passages.fit_on(docs, labels.union(labels))
    from corpusloom.llm.tables import PIECE_CHARS
    assert seen[0] == seen[1] and seen[0][0] == 40 and seen[0][1] == PIECE_CHARS and 0.4 < seen[0][2] < 0.6
