import math
from collections import defaultdict

import pyarrow as pa
import pytest
from edge import clashing, edge, empty

from corpusloom.llm import language


def plain_length(texts, text):
    """Code length of a text in one language's trees, byte by byte, by the definition."""
    followers = defaultdict(lambda: defaultdict(int))
    for t in texts:
        b = t.encode().lower()
        for i, x in enumerate(b):
            for k in (0, 1, 2, 3):
                followers[tuple(b[j] if j >= 0 else 0 for j in range(i - k, i))][x] += 1

    def p(context, x):
        if context is None:
            return 1 / 256
        f, shorter = followers.get(context), context[1:] if context else None
        if not f:
            return p(shorter, x)
        n, d = sum(f.values()), len(f)
        return f[x] / (n + d) if x in f else d / (n + d) * p(shorter, x)

    b = text.encode().lower()
    return sum(-math.log2(p(tuple(b[j] if j >= 0 else 0 for j in range(i - 3, i)), x)) for i, x in enumerate(b))


def test_compiled_trees_give_the_plain_code_length(monkeypatch):
    monkeypatch.setattr(language, "MIN_CONTEXT", 1)
    en, de = ["the cat sat on the mat", "a dog ran to the cat"], ["der hund und die katze", "die maus und der hund"]
    model = language.train(pa.array(en + de), ["en"] * 2 + ["de"] * 2)
    probe = ["the dog sat", "die katze", "", "Cat"]
    got, _ = language.code_lengths(pa.array(probe), model)
    for i, text in enumerate(probe):
        for k, texts in enumerate((de, en)):  # names in order
            assert got[i, k] / language.SCALE == pytest.approx(plain_length(texts, text), abs=0.001 * max(1, len(text)))


def test_pieces_of_a_long_text_add_up():
    model = language.train(pa.array(["ab ba abba baab " * 40, "cd dc cddc " * 40]), ["x", "y"])
    text = "abba cd " * 200_000
    whole, n = language.code_lengths(pa.array([text, "ab"]), model)
    one, _ = language.code_lengths(pa.array(["abba cd " * 2]), model)
    assert n[0] == len(text) and whole[1].tolist() == language.code_lengths(pa.array(["ab"]), model)[0][0].tolist()
    two, _ = language.code_lengths(pa.array(["abba cd " * 3]), model)
    assert whole[0].tolist() == (one[0] + (two[0] - one[0]) * (200_000 - 2)).tolist()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    out = language.op8_language_id(spark, f"{sf}/../sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_edges(spark):
    docs = clashing(spark)
    out = language.identify(docs, language.train_on(edge(spark)))
    assert out.count() == docs.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["_l"].lang_pred == "und") != letters and 0 <= r["_l"].score <= 1
        assert r["_l"].lang_pred in ("und", "en", "de")
    assert language.identify(empty(spark), language.train_on(edge(spark))).count() == 0
    untrained = language.identify(edge(spark), language.train_on(empty(spark))).collect()
    assert {(r["_l"].lang_pred, r["_l"].score, r["_l"].accepted) for r in untrained} == {("und", 0.0, False)}
