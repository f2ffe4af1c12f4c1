"""Reports from mergeable states, held against the exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments, states
from ..session import cut, scratch_path
from .catalog import oracle, query, table, view
from .segments import _PER_CHILD, _VIEWS, RULES, _tag_sql, _tagged

PROBS = (0.25, 0.5, 0.75, 0.95)


@query("profile_states", f"""SELECT field, p, n, low, high, true AS within FROM (SELECT 'quantity' AS field, count(*) AS n, CAST(min(l_quantity) AS BIGINT) AS low, CAST(max(l_quantity) AS BIGINT) AS high FROM lineitem
  UNION ALL SELECT 'cents', count(*), min(CAST(round(l_extendedprice * 100) AS BIGINT)), max(CAST(round(l_extendedprice * 100) AS BIGINT)) FROM lineitem),
  (VALUES {', '.join(f"(CAST({p} AS DOUBLE))" for p in PROBS)}) v(p)""")
def profile_states(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    data, kept = scratch_path(spark, "data"), scratch_path(spark, "states")
    values = {"quantity": "quantity", "cents": "cents"}
    for part in range(2):  # more files come; only they are read
        lines.where(F.col("l_orderkey") % 2 == part).repartition(3).write.mode("append").parquet(data)
        states.update_file_states(spark, data, kept, values)
    found = states.profile_from_states(spark, data, kept, PROBS)
    marks = found.select("field", "n", F.col("min").alias("low"), F.col("max").alias("high"),
                         F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{round(p * 100):02d}").alias("mark")) for p in PROBS])))
    rows = lines.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in values]))).groupBy("field", "v").agg(F.count("*").alias("c"))
    share = rows.join(F.broadcast(cut(marks)), "field").groupBy("field", "p", "n", "low", "high").agg(  # eight rows
        (F.sum(F.when(F.col("v") < F.col("mark"), F.col("c")).otherwise(0)) / F.col("n")).alias("below"),
        (F.sum(F.when(F.col("v") <= F.col("mark"), F.col("c")).otherwise(0)) / F.col("n")).alias("upto"))
    error = states.KLL_RANK_ERROR
    return share.select("field", "p", "n", "low", "high", ((F.col("below") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)).alias("within"))


@query("tier_states", oracle(f"""SELECT t AS max_tier, count(*) FILTER (tier <= t) AS children_n, true AS within FROM ({_PER_CHILD}), (VALUES (1), (2), (3)) v(t) GROUP BY t""",
                             *_VIEWS, extra=_tag_sql(RULES)))
def tier_states(spark, sf):
    children, tagged = view(spark, sf, "children_v"), _tagged(spark, sf)
    exact = segments.tier_coverage(children, tagged, [1, 2, 3], "id", "structure_id").select("max_tier", "children_n")
    inside = segments.min_tier(children, tagged, "id", "structure_id").where(F.col("tier").isNotNull())
    found = states.cumulative_tiers(cut(states.id_states(inside, ["tier"], "id")), [1, 2, 3])
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("children_n")) <= states.distinct_error() * F.col("children_n")
    return exact.join(found, "max_tier", "left").select("max_tier", "children_n", near.alias("within"))


@query("frequent_values", oracle("SELECT value, count(*) AS n FROM (SELECT unnest(codes) AS value FROM structures_v) GROUP BY value ORDER BY n DESC, value LIMIT 20", "structures_v"))
def frequent_values(spark, sf):
    codes = view(spark, sf, "structures_v").select((F.col("id") % 16).alias("part"), F.explode("codes").alias("value"))
    return states.frequent_values(cut(states.frequent_states(codes, ["part"], "value")), 20)
