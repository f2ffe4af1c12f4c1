"""Backlog items with dependencies: readiness, active groups, capacity, checklists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import ACTIVE_STATUSES
from .ordering import top_k


def unmet_items(edges: DataFrame, done: DataFrame, item: str = "id", dep: str = "dep") -> DataFrame:
    """Items with a dependency that is not done; unknown dependencies are not done.

    Edges are made distinct first, so the join sees each pair once however often it is listed.
    """
    pairs = edges.where(F.col(dep).isNotNull()).select(item, dep).distinct()
    finished = done.select(F.col("id").alias(dep))
    return pairs.join(finished, dep, "left_anti").select(item).distinct()


def ready_items(items: DataFrame, edges: DataFrame | None = None, done: DataFrame | None = None,
                done_status: str = "done", exclude: Sequence[object] = ()) -> DataFrame:
    """Items not done whose every dependency is; no dependencies means ready. Dependencies come from the
    `depends_on` array or as `edges` (id, dep); `done` defaults to the items in `done_status`."""
    finished = items.where(F.col("status") == done_status).select("id") if done is None else done
    if edges is None:
        edges = items.select("id", F.explode("depends_on").alias("dep"))
    open_items = items.where(~F.coalesce(F.col("status") == done_status, F.lit(False)))
    if exclude:
        open_items = open_items.where(~F.col("id").isin(*exclude))
    return open_items.join(unmet_items(edges, finished), "id", "left_anti")


def not_active(candidates: DataFrame, active: DataFrame, group: str) -> DataFrame:
    """Candidates whose group has no active item."""
    return candidates.join(active.select(group), group, "left_anti")


def active_counts(runs: DataFrame, pipelines: DataFrame, statuses: Sequence[str] = ACTIVE_STATUSES) -> DataFrame:
    """Active runs of every known pipeline, 0 where there are none."""
    counts = (runs.where(F.col("status").isin(*statuses)).groupBy("pipeline_id")
                  .agg(F.count(F.lit(1)).alias("active_n")))
    known = pipelines.select(F.col("id").alias("pipeline_id"))
    return known.join(counts, "pipeline_id", "left").fillna(0, ["active_n"])


def clamp_pick(candidates: DataFrame, active: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """The first `cap` - active candidates; never more than `cap` rows are ranked."""
    used = active.agg(F.count(F.lit(1))).scalar()
    slot = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # of at most `cap` rows
    first = top_k(candidates, order, cap).withColumn("slot", slot)
    return first.where(F.col("slot") <= F.greatest(F.lit(cap) - used, F.lit(0)))


def checklist_state(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Ticked and open boxes per document; complete when none is open and one is ticked."""
    done = F.regexp_count(text, F.lit(r"(?m)^\s*- \[[xX]\]"))
    todo = F.regexp_count(text, F.lit(r"(?m)^\s*- \[ \]"))
    counts = docs.select(id_col, F.coalesce(done, F.lit(0)).alias("checked_n"), F.coalesce(todo, F.lit(0)).alias("open_n"))
    return counts.withColumn("complete", (F.col("open_n") == 0) & (F.col("checked_n") > 0))


def all_done(groups: DataFrame, items: DataFrame, by: str, flag: str) -> DataFrame:
    """Every item of the group is flagged; a group without items is not done."""
    state = items.groupBy(by).agg(F.bool_and(F.coalesce(F.col(flag), F.lit(False))).alias("all_done"))
    return groups.select(by).join(state, by, "left").fillna(False, ["all_done"])
