import math
from collections import Counter, defaultdict

import pytest
from edge import clashing, edge, empty, rows_of, words
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def bisected(shares, value, limit):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if value(shares, mid) <= limit else (mid, hi)
    return hi


def entropy(shares, t):
    w = [p ** t for p in shares]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(shares))


def repeats(shares, t):
    return max((p / max(shares)) ** (t - 1) for p in shares)


@pytest.mark.parametrize("sizes", [[1000, 10, 10, 500], [5, 5], [7]])
def test_exponent_meets_its_target(spark, sizes):
    sized = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "source string, tokens long")
    sources = mixing.totals(sized)
    shares = [n / sum(sizes) for n in sizes]
    for how, value, limit in (("entropy", entropy, 0.9), ("repeat_limit", repeats, 1.5)):
        expected = bisected(shares, value, limit) if len(sizes) > 1 else 1.0
        assert mixing.exponent(sources, **{how: limit}) == pytest.approx(expected, abs=1e-6)


def check(docs, **target):
    """Copies of every row by a plain version of the plan."""
    rows = docs.select("doc_id", "source", "text", mixing.fine_block(F.col("doc_id")).alias("fine")).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source] += len(words(r.text))
    total = sum(tokens.values())
    shares = {s: n / total if total else 0.0 for s, n in tokens.items()}
    some = [p for p in shares.values() if p > 0]
    t = mixing.exponent(mixing.totals(docs.select("source", mixing.tokens(F.col("text")).alias("tokens"))), **target)
    z = sum(p ** t for p in some)
    blocks = defaultdict(Counter)
    n_blocks = {s: min(mixing.MAX_BLOCKS, max(mixing.MIN_BLOCKS, -(-n // mixing.BLOCK_TOKENS))) for s, n in tokens.items()}
    for r in rows:
        blocks[r.source][r.fine % n_blocks[r.source]] += len(words(r.text))
    expected = Counter()
    for s, own in blocks.items():
        p = shares[s]
        budget = 0.0 if p == 0 else total * p ** t / z if "entropy" in target else tokens[s] * (p / max(some)) ** (t - 1)
        epochs = math.floor(budget / tokens[s] + 1e-9) if tokens[s] else 1
        rest = max(0.0, budget - epochs * tokens[s])
        turns = spark_hashes(docs.sparkSession, s, own, epochs)
        before = 0
        for b in sorted(own, key=lambda b: (turns[b], b)):
            expected[s, b] = epochs + (before + own[b] / 2 < rest)
            before += own[b]
    got = {(r.source, r["_block"]): r["_copies"] for r in mixing.mixed(docs, **target).select("source", "_block", "_copies").collect()}
    assert got == dict(expected)


def spark_hashes(spark, source, blocks, epochs):
    rows = spark.createDataFrame([(source, b, epochs) for b in blocks], "source string, block long, epochs long")
    return {r.block: r.h for r in rows.select("block", F.xxhash64("source", "block", "epochs", F.lit(mixing.SEED)).alias("h")).collect()}


def test_copies_equal_a_plain_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, entropy=0.97)
    check(docs, repeat_limit=1.5)


def test_no_row_is_left_out_under_a_repetition_limit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "big").otherwise(F.col("source")))
    times = Counter(r.doc_id for r in mixing.realised(docs, repeat_limit=1.5).collect())
    assert set(times) == {r.doc_id for r in docs.collect()} and max(times.values()) == 2 and min(times.values()) == 1


def test_edges(spark):
    for target in ({"entropy": 0.9}, {"repeat_limit": 2.0}):
        docs = clashing(spark)
        out = mixing.mixed(docs, **target)
        assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
        assert mixing.realised(edge(spark), **target).columns == edge(spark).columns
        assert mixing.mixed(empty(spark), **target).count() == 0
        assert rows_of(mixing.mixed(edge(spark), **target)) == rows_of(mixing.mixed(edge(spark).repartition(4), **target))
    blank = spark.createDataFrame([(1, "", "en", None, 0), (2, None, "en", "s", 0)], edge(spark).schema)
    assert mixing.realised(blank, repeat_limit=1.5).count() == 2
