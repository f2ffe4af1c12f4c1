"""Segmentation queries: provider rules over parts, services over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import segments
from ..operators.rules import Bucket
from .catalog import oracle, query, view

RULES = [
    Bucket(1, "economy", ["economy"]),
    Bucket(1, "brand one", ["brand#1", "brand#11"]),
    Bucket(1, "widget by name", [], [r"\bWIDGET\b"]),
    Bucket(2, "promo or ring", ["promo"], [r"\bring\b"]),
    Bucket(2, "no rule"),
    Bucket(3, "size by text", [], [r"\bsmall\s", r"^large\s+(?:rod|gear)"]),
]
KEYWORDS = [Bucket(0, label, [], [pattern]) for label, pattern in [
    ("gizmo", r"\bgizmo\b"), ("hot or cold", r"\bhot\b|\bcold\b"), ("bolt", r"bolt"), ("standard", r"\bSTANDARD\b"),
    ("apostrophe", r"d['e]?\s*auteuil"), ("colour", r"(?:red|blue)\s+\w")]]


def _predicate(b: Bucket, prefix: str = "") -> str:
    parts = []
    if b.codes:
        parts.append(f"coalesce(list_has_any(codes, [{', '.join(repr(c) for c in b.codes)}]), false)")
    for p in b.patterns:
        quoted = p.replace("'", "''")
        parts.append(f"regexp_matches(concat(coalesce(nom, ''), ' ', coalesce(description, '')), '(?i){quoted}')")
    return f"({' OR '.join(parts)})" if parts else "false"


def _tag_sql(rules: list[Bucket]) -> str:
    union = " UNION ALL ".join(f"SELECT id AS pid, {b.tier} AS tier, '{b.label}' AS bucket FROM structures_v WHERE {_predicate(b)}" for b in rules)
    names = ", ".join(f"({b.tier}, '{b.label}')" for b in rules)
    return f"tags AS ({union}), names(tier, bucket) AS (VALUES {names})"


_COUNTS = """SELECT n.tier, n.bucket, coalesce(p.parents_n, 0) AS parents_n, coalesce(c.children_n, 0) AS children_n,
  coalesce(c.children_n, 0) / (SELECT count(*) FROM children_v) AS share FROM names n
  LEFT JOIN (SELECT tier, bucket, count(DISTINCT pid) AS parents_n FROM tags GROUP BY ALL) p USING (tier, bucket)
  LEFT JOIN (SELECT tier, bucket, count(DISTINCT c.id) AS children_n FROM tags JOIN children_v c ON c.structure_id = pid GROUP BY ALL) c USING (tier, bucket)"""
_VIEWS = ("structures_v", "children_v")
_OUT = "children_v c WHERE structure_id IS NULL OR structure_id NOT IN (SELECT pid FROM tags)"


def _tagged(spark: SparkSession, sf: str, rules: list[Bucket] = RULES) -> DataFrame:
    return segments.tag_buckets(view(spark, sf, "structures_v"), rules, "codes", ["nom", "description"])


@query("segment_counts", oracle(_COUNTS, *_VIEWS, extra=_tag_sql(RULES)))
def segment_counts(spark, sf):
    return segments.segment_counts(view(spark, sf, "children_v"), _tagged(spark, sf), RULES, "id", "structure_id")


@query("keyword_counts", oracle(_COUNTS, *_VIEWS, extra=_tag_sql(KEYWORDS)))
def keyword_counts(spark, sf):
    return segments.segment_counts(view(spark, sf, "children_v"), _tagged(spark, sf, KEYWORDS), KEYWORDS, "id", "structure_id")


@query("segment_services", oracle("SELECT id, source, structure_id FROM children_v WHERE structure_id IN (SELECT pid FROM tags WHERE tier = 1)",
                                  *_VIEWS, extra=_tag_sql(RULES)))
def segment_services(spark, sf):
    return segments.children_of(view(spark, sf, "children_v"), _tagged(spark, sf), "structure_id", tier=1)


@query("parent_coverage", oracle("""SELECT count(*) AS children_n, count(*) FILTER (structure_id IN (SELECT id FROM structures_v)) AS with_parent_n,
  count(*) FILTER (structure_id IN (SELECT id FROM structures_v)) / count(*) AS share FROM children_v""", *_VIEWS))
def parent_coverage(spark, sf):
    return segments.parent_coverage(view(spark, sf, "children_v"), view(spark, sf, "structures_v"), "structure_id")


_PER_CHILD = "SELECT c.id, min(tier) AS tier FROM children_v c LEFT JOIN tags ON structure_id = pid GROUP BY c.id"


@query("tier_assign", oracle(_PER_CHILD, *_VIEWS, extra=_tag_sql(RULES)))
def tier_assign(spark, sf):
    return segments.min_tier(view(spark, sf, "children_v"), _tagged(spark, sf), "id", "structure_id")


@query("tier_coverage", oracle(f"""SELECT t AS max_tier, count(*) FILTER (tier <= t) AS children_n,
  count(*) FILTER (tier <= t) / (SELECT count(*) FROM children_v) AS share FROM ({_PER_CHILD}), (VALUES (1), (2), (3)) v(t) GROUP BY t""",
                               *_VIEWS, extra=_tag_sql(RULES)))
def tier_coverage(spark, sf):
    return segments.tier_coverage(view(spark, sf, "children_v"), _tagged(spark, sf), [1, 2, 3], "id", "structure_id")


@query("segment_out_of_scope", oracle(f"SELECT count(DISTINCT id) AS children_n, count(DISTINCT id) / (SELECT count(*) FROM children_v) AS share FROM {_OUT}",
                                      *_VIEWS, extra=_tag_sql(RULES)))
def segment_out_of_scope(spark, sf):
    return segments.out_of_scope(view(spark, sf, "children_v"), _tagged(spark, sf), "id", "structure_id")


@query("out_of_scope_sources", oracle(f"SELECT source, count(DISTINCT id) AS children_n FROM {_OUT} GROUP BY source",
                                      *_VIEWS, extra=_tag_sql(RULES)))
def out_of_scope_sources(spark, sf):
    return segments.out_of_scope_by(view(spark, sf, "children_v"), _tagged(spark, sf), "source", "id", "structure_id")
