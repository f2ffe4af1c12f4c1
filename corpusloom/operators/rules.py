"""Rule tables as data: buckets, concepts, field contract, conflict rules."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Bucket(NamedTuple):
    tier: int
    label: str
    codes: Sequence[str] = ()
    patterns: Sequence[str] = ()


class Concept(NamedTuple):
    """`stem`: optional lower-case text every hit must contain; rows lacking it skip the patterns."""
    category: str
    name: str
    patterns: Sequence[str]
    stem: str | None = None


class FieldRule(NamedTuple):
    group: str
    field: str
    kind: str  # int, bool, enum, list
    allowed: Sequence[str] | None = None
    minimum: int | None = None
    maximum: int | None = None


class ConflictRule(NamedTuple):
    """A tagged concept next to a normalised value is a conflict of `kind` on `field`, unless one of the
    `unless` values is present as well."""
    kind: str  # under_specification, contradiction
    field: str
    normalized_value: str
    concept: str
    unless: Sequence[str] = ()


def buckets(rows: Iterable[tuple]) -> list[Bucket]:
    return [Bucket(*r) for r in rows]


def field_rules(rows: Iterable[tuple]) -> list[FieldRule]:
    return [FieldRule(*r) for r in rows]


def concept_dictionary(doc: dict[str, dict[str, Sequence[str]]] | str) -> list[Concept]:
    """Concepts from {category: {concept: [patterns]}} or the same as JSON text, order kept."""
    parsed = json.loads(doc) if isinstance(doc, str) else doc
    return [Concept(category, name, list(patterns))
            for category, items in parsed.items() for name, patterns in items.items()]


def contract_from_schema(doc: dict | str) -> list[FieldRule]:
    """Field rules from a JSON schema whose `definitions` are the record's groups."""
    schema = json.loads(doc) if isinstance(doc, str) else doc
    rules = []
    for group, body in schema["definitions"].items():
        for field, spec in body["properties"].items():
            types = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
            if "array" in types:
                rules.append(FieldRule(group, field, "list", list(spec["items"]["enum"])))
            elif "boolean" in types:
                rules.append(FieldRule(group, field, "bool"))
            elif "integer" in types:
                rules.append(FieldRule(group, field, "int", None, spec.get("minimum"), spec.get("maximum")))
            else:
                rules.append(FieldRule(group, field, "enum", [v for v in spec["enum"] if v is not None]))
    return rules


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """A rule list as a one-partition DataFrame of constants; its size is that of the code."""
    def lit(v: object) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)

    structs = [F.struct(*[lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
