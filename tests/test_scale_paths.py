"""Operators that split hot groups give the rows of one plain window or aggregate."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import chunking, ordering, profile, sampling
from corpusloom.operators.concepts import value_tally
from corpusloom.operators.ledger import number_events
from corpusloom.operators.sessions import assemble_transcript, transcript_summary


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one group holds two thirds, one key is null."""
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 else (None if i % 9 == 0 else f"g{i % 30}"), rnd.choice([None, rnd.random(), 0.5])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, grp string, v double").repartition(6).cache()


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_top_k_per_group(skewed):
    rank = F.row_number().over(W.partitionBy("grp").orderBy("v", "id"))
    for k in (7, 1500):
        want = skewed.withColumn("rank", rank).where(F.col("rank") <= k)
        assert rows_of(ordering.top_k_per_group(skewed, ["grp"], ["v", "id"], k)) == rows_of(want)


def test_top_k_beyond_one_task(skewed, monkeypatch):
    monkeypatch.setattr(ordering, "RANKED_K", 100)
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy("v", "id"))).where("rank <= 700")
    assert rows_of(ordering.top_k_per_group(skewed, ["grp"], ["v", "id"], 700)) == rows_of(want)


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_positions(skewed, by):
    want = rows_of(skewed.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("v", "id")).cast("bigint")))
    for hot_rows in (0, 100, 10_000):  # every group hot, one hot, none hot
        got = ordering.positions(skewed, ["v", "id"], by=by, hot_rows=hot_rows)
        assert rows_of(got) == want
    if not by:
        assert sorted(r.position for r in got.collect()) == list(range(1, 3001))


def test_number_events(skewed):
    want = number_events(skewed, "grp", ["id"])
    assert rows_of(want) == rows_of(number_events(skewed, "grp", ["id"], hot_rows=500))


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_running_totals(skewed, by):
    before = F.sum("id").over(W.partitionBy(*by).orderBy("v", "id").rowsBetween(W.unboundedPreceding, -1))
    want = skewed.withColumn("before", F.coalesce(before, F.lit(0)))
    assert rows_of(ordering.running_totals(skewed, ["v", "id"], by=by, weight=F.col("id"))) == rows_of(want)


@pytest.mark.parametrize("by", [None, "grp"])
def test_quantiles(skewed, by):
    keys = [by] if by else []
    got = profile.numeric_profile(skewed, "v", by=by, probs=(0.25, 0.5))
    marks = F.percentile("v", [0.25, 0.5])
    want = skewed.groupBy(*keys).agg(F.round(marks[0], 9).alias("p25"), F.round(marks[1], 9).alias("p50"), F.count("*").alias("n"))
    assert rows_of(got.select(*keys, F.round("p25", 9).alias("p25"), F.round("p50", 9).alias("p50"), "n")) == rows_of(want)


def test_quantiles_of_empty_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "grp string, v double")
    got = {r.grp: (r.n, r.null_n, r.p50) for r in profile.numeric_profile(df, "v", by="grp").collect()}
    assert got == {"a": (1, 1, None), "b": (1, 0, 1.0)}
    none = profile.numeric_profile(df.where("v > 5"), "v").first()
    assert (none.n, none.p50) == (0, None)


@pytest.mark.parametrize("k", [1, 4, 7, 2999, 4000])
def test_chunks(skewed, k):
    got = chunking.chunk(skewed, k, ["id"])
    assert all(r.chunk_id == r.id // -(-3000 // k) + 1 for r in got.collect())
    sizes = [r["count"] for r in got.groupBy("chunk_id").count().orderBy("chunk_id").collect()]
    assert sum(sizes) == 3000 and set(sizes[:-1]) <= {-(-3000 // k)} and min(sizes) > 0


def test_chunks_with_null_and_repeated_keys(skewed):
    for k in (9, 700):
        sizes = [r["count"] for r in chunking.chunk(skewed, k, ["grp"]).groupBy("chunk_id").count().orderBy("chunk_id").collect()]
        assert sum(sizes) == 3000 and set(sizes[:-1]) <= {-(-3000 // k)}
    assert chunking.chunk(skewed.where("id < 0"), 3, ["id"]).count() == 0


@pytest.mark.parametrize("keep_null", [False, True])
def test_group_count_without_broadcast(skewed, keep_null):
    a = sampling.with_group_count(skewed, "grp", keep_null=keep_null)
    for hot_rows in (100, 10_000):
        b = sampling.with_group_count(skewed, "grp", keep_null=keep_null, max_broadcast_rows=0, hot_rows=hot_rows)
        assert rows_of(a) == rows_of(b)
    assert (a.where("grp is null").count() > 0) is keep_null


def test_samples_nest_and_fill_quotas(skewed):
    weighted = (skewed.withColumn("stratum", F.when(F.col("id") % 50 == 0, "sparse").when(F.col("id") % 2 == 0, "rich").otherwise("norm_only"))
                .withColumn("weight", F.lit(1.0) + F.col("id") % 3))
    sizes = {"big": 400, "small": 100}
    b = sampling.nested_sample(weighted, "id", "stratum", "weight", sizes)
    n = {(r["sample"], r.stratum): r["count"] for r in b.groupBy("sample", "stratum").count().collect()}
    assert n == {("big", "rich"): 260, ("big", "norm_only"): 80, ("big", "sparse"): 60, ("small", "rich"): 65,
                 ("small", "norm_only"): 20, ("small", "sparse"): 15}
    picks = b.cache()
    assert sampling.subset_violations(picks.where("sample = 'small'"), picks.where("sample = 'big'"), "id").count() == 0


def test_weights_shift_the_sample(spark):
    df = spark.range(20000).withColumn("stratum", F.lit("rich")).withColumn("weight", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    picks = sampling.weighted_stratified_sample(df, "id", "stratum", "weight", 2000, {"rich": 1.0}, seed=1)
    even = picks.where("id % 2 = 0").count()
    assert 1400 < even < 1580  # three to one, less a little for draws without replacement


def test_short_strata_are_taken_whole(spark):
    df = spark.createDataFrame([(1, "rich", 1.0), (2, "rich", 1.0), (3, "other", 1.0)], "id long, stratum string, weight double")
    assert {r.id for r in sampling.weighted_stratified_sample(df, "id", "stratum", "weight", 100).collect()} == {1, 2}


def test_quota_rounds_halves_to_even():
    assert sampling.quota_sizes(10, {"a": 0.25, "b": 0.35}) == {"a": 2, "b": 4}
    assert sampling.quota_sizes(1500, {"rich": 0.65, "norm_only": 0.2, "sparse": 0.15}) == {"rich": 975, "norm_only": 300, "sparse": 225}


def test_transcript_is_whole_whatever_the_numbers(spark):
    rows = [("long", i * 50, f" t{i} " if i % 4 else "  ") for i in range(500)] + [("mute", 0, None), ("mute", 9000, "\n"), ("one", 5, "x"),
            ("far", 2500, "a"), ("far", 5000, "b")]
    df = spark.createDataFrame(rows, "run string, seq long, text string")
    whole = {r.run_id: r.transcript for r in assemble_transcript(df, "run", "seq", "text").collect()}
    assert whole == {r.run_id: r.transcript for r in assemble_transcript(df, "run", "seq", "text", piece=60).collect()}
    assert whole["mute"] == "(empty)" and whole["one"] == "x" and whole["far"] == "a\n\nb"
    assert whole["long"] == "\n\n".join(f"t{i}" for i in range(500) if i % 4)
    summary = {r.run_id: r.summary for r in transcript_summary(df, "run", "seq", "text").collect()}
    assert summary == {k: v[:280] for k, v in whole.items()}


def test_summary_of_one_character_fragments(spark):
    df = spark.createDataFrame([("r", i, "x") for i in range(300)], "run string, seq long, text string")
    whole = assemble_transcript(df, "run", "seq", "text").first().transcript
    assert transcript_summary(df, "run", "seq", "text").first().summary == whole[:280]


def test_transcript_of_a_long_text(spark):
    df = spark.range(1).select(F.lit("r").alias("run"), F.lit(0).alias("seq"), F.repeat(F.lit("p"), 300000).alias("text"))
    assert len(assemble_transcript(df, "run", "seq", "text").first().transcript) == 300000


def test_value_tally(skewed):
    got = {r.value: (r.n, len(r.examples)) for r in value_tally(skewed, "grp", "v", "id", 3).collect()}
    assert got["hot"] == (2000, 3) and sum(n for n, _ in got.values()) == 3000


def test_array_and_scalar_frequency(spark):
    df = spark.createDataFrame([(["a", "b"], "x"), (["a"], None), (None, "x")], "arr array<string>, s string")
    assert [tuple(r) for r in profile.frequency(df, "arr").collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in profile.frequency(df, "s").collect()] == [("x", 2)]
