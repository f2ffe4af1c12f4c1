"""Mergeable states: what a new file costs, and errors within their bounds."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import states


def test_a_new_file_costs_its_own_scan(spark, tmp_path):
    data, kept = str(tmp_path / "data"), str(tmp_path / "states")
    for part in range(3):
        spark.range(20_000).select((F.col("id") * 3 + part).alias("v")).repartition(2).write.mode("append").parquet(data)
        assert states.update_file_states(spark, data, kept, {"v": "v", "odd": "CASE WHEN v % 2 = 1 THEN v END"}) == 2
        assert states.update_file_states(spark, data, kept, {"v": "v"}) == 0
    got = {r.field: r for r in states.profile_from_states(spark, data, kept).collect()}
    assert (got["v"].n, got["v"].null_n, got["v"].min, got["v"].max) == (60_000, 0, 0, 59_999)
    assert (got["odd"].n, got["odd"].null_n, got["odd"].min, got["odd"].max) == (60_000, 30_000, 1, 59_999)
    for field in ("v", "odd"):
        for p in (0.25, 0.5, 0.75, 0.95):
            assert abs(got[field][f"p{round(p * 100):02d}"] / 60_000 - p) <= states.KLL_RANK_ERROR
    # a file that goes leaves the report
    import os
    gone = next(f for f in sorted(os.listdir(data)) if f.endswith(".parquet"))
    os.rename(f"{data}/{gone}", str(tmp_path / "gone.parquet"))
    assert {r.n for r in states.profile_from_states(spark, data, kept).collect()} == {50_000}


def test_unions_count_shared_ids_once(spark):
    rows = spark.range(60_000).select(F.col("id"), F.explode(F.array(F.lit(1), F.when(F.col("id") % 2 == 0, 2), F.when(F.col("id") % 3 == 0, 3))).alias("tier")).where("tier is not null")
    kept = states.id_states(rows.where("tier > 1 or id < 30000"), ["tier"], "id").cache()
    error = states.distinct_error()
    got = {r.max_tier: r.n for r in states.cumulative_tiers(kept, [1, 2, 3]).collect()}
    for tier, exact in ((1, 30_000), (2, 45_000), (3, 50_000)):
        assert abs(got[tier] - exact) <= error * exact
    a, b = (kept.where(F.col("tier") == t).select(F.col("ids").alias(f"s{t}")) for t in (2, 3))
    both = a.join(F.broadcast(b)).select(states.overlap_size(F.col("s2"), F.col("s3")).alias("n")).first().n
    assert abs(both - 10_000) <= 3 * error * 50_000 / 2
    small = states.id_states(rows.where("id < 1000"), ["tier"], "id")
    assert {r.tier: r.n for r in states.union_size(small, ["tier"]).collect()} == {1: 1000, 2: 500, 3: 334}


def test_heavy_values_are_found_among_many(spark):
    rnd = random.Random(4)
    rows = [(k % 5, f"hot{k % 4}") for k in range(4_000)] + [(rnd.randrange(5), f"cold{k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "part int, value string").repartition(6)
    items = 512
    got = states.frequent_values(states.frequent_states(df, ["part"], "value", items), 4, items=items).collect()
    bound = states.lost_count(len(rows), items)
    assert {r.value for r in got} == {f"hot{i}" for i in range(4)} and all(0 <= r.n - 1_000 <= bound for r in got)
    exact = states.frequent_values(states.frequent_states(df.where("value like 'hot%'").withColumn("g", F.lit("g")), ["g", "part"], "value"), 9, by=["g"]).collect()
    assert sorted((r.value, r.n) for r in exact) == [(f"hot{i}", 1_000) for i in range(4)]
