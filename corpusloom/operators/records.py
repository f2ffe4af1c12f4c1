"""Extraction records: tolerant parse, fields, tallies, conflicts, contract and evidence checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nested_too_deep, parse_json, strip
from ..functions.values import (
    bare_text,
    describe,
    field_value,
    is_filled,
    kind_of,
    list_items,
    normalise_value,
    tally_items,
    unwrap,
)
from .compute import once
from .ordering import first_per_key, top_k, top_k_per_group
from .profile import row_total
from .rules import FieldRule

# Short names of the two groups in reports.
GROUP_PREFIX = {"publics_extended": "pub", "prerequis_extended": "pre"}


def parse_lines(lines: DataFrame, line: str = "line", id_field: str = "service_id") -> DataFrame:
    """Add `record` (VARIANT), `id` and `problem` to non-blank lines. `problem` is null for a usable record,
    else bad_json, too_deep (nested beyond `MAX_DEPTH`), not_object or no_id."""
    text = once(lines, _text=strip(F.col(line))).where(F.col("_text") != "")
    parsed = once(text, record=parse_json("_text"))
    key = F.try_variant_get("record", f"$.{id_field}", "string")
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT<"), F.lit(False))
    problem = (F.when(F.col("record").isNull(), F.when(nested_too_deep(F.col("_text")), "too_deep").otherwise("bad_json"))
               .when(F.coalesce(key, F.lit("")) != "", None)  # only objects have a key
               .when(~is_object, "not_object").otherwise("no_id"))
    return once(parsed, id=key, problem=problem).drop("_text")


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull()).drop("problem")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNotNull()).drop("record", "id")


def dedupe_last(records: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key by run priority and line position."""
    return first_per_key(records, [key], [F.desc(o) for o in order])


def _name(r: FieldRule) -> str:
    return f"{GROUP_PREFIX.get(r.group, r.group)}.{r.field}"


def _each_field(fields: Sequence[FieldRule], body: str, record: str = "record") -> Column:
    """ARRAY of `body` over the contract's fields of `record`, which it sees as x.field and the described value x.d.
    One lambda keeps plans small where an expression per field would repeat its logic 22 times."""
    raw = ", ".join(f"named_struct('field', '{_name(r)}', 'v', {field_value(r.group, r.field, record)})" for r in fields)
    return F.expr(f"transform(transform(array({raw}), x -> named_struct('field', x.field, 'd', {describe('x.v')})), x -> {body})")


def record_fields(fields: Sequence[FieldRule], record: str = "record") -> Column:
    """ARRAY<STRUCT<field, filled, value>> in contract order; `value` is the comparable form."""
    return _each_field(fields, f"named_struct('field', x.field, 'filled', {is_filled('x.d')}, 'value', {normalise_value('x.d')})", record)


def conflict_items(record: Column) -> Column:
    return F.coalesce(F.try_variant_get(record, "$.conflicts", "array<variant>"), F.array().cast("array<variant>"))


def _any_filled(fields: Sequence[FieldRule], group: str) -> Column:
    return F.exists(_each_field([r for r in fields if r.group == group], is_filled("x.d")), lambda x: x)


def record_coverage(records: DataFrame, fields: Sequence[FieldRule]) -> DataFrame:
    """Records, records with a filled field per group, records with conflicts, conflicts."""
    rec = F.col("record")
    groups = list(dict.fromkeys(r.group for r in fields))
    flags = records.select(
        *[_any_filled(fields, g).alias(g) for g in groups], F.size(conflict_items(rec)).alias("_c"))
    return flags.agg(
        F.count(F.lit(1)).alias("records_n"),
        *[F.count_if(F.col(g)).alias(f"{GROUP_PREFIX.get(g, g)}_filled_n") for g in groups],
        F.count_if(F.col("_c") > 0).alias("with_conflicts_n"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("conflicts_n"))


def field_fill(records: DataFrame, fields: Sequence[FieldRule]) -> DataFrame:
    """Filled records per field, zero counts included, in one pass."""
    counts = once(records.select("record"), _f=_each_field(fields, is_filled("x.d"))).agg(
        *[F.count_if(F.get("_f", F.lit(i))).alias(_name(r)) for i, r in enumerate(fields)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(_name(r)).alias("field"), F.col(f"`{_name(r)}`").alias("n")) for r in fields])))


def field_top_values(records: DataFrame, fields: Sequence[FieldRule], k: int = 5) -> DataFrame:
    """Most frequent values of each field, ties by value."""
    tallies = _each_field(fields, f"named_struct('field', x.field, 'values', {tally_items('x.d')})")
    lists = once(records.select("record"), _t=tallies).select(F.inline("_t"))
    counts = lists.select("field", F.explode("values").alias("value")).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, ["field"], [F.desc("n"), F.asc("value")], k)


def conflict_counts(records: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Conflicts per `field` or `type`; a missing key counts under `?`."""
    items = once(records.select("record"), _c=conflict_items(F.col("record"))).select(F.explode("_c").alias("c"))
    key = F.coalesce(F.try_variant_get("c", f"$.{by}", "string"), F.lit("?")).alias("value")
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else top_k(counts, [F.desc("n"), F.asc("value")], k)


def _rule_rows(contract: Sequence[FieldRule]) -> str:
    """ARRAY of the rules, each with its value `v` in the record."""
    def row(r: FieldRule) -> str:
        allowed = f"array({', '.join(repr(a) for a in r.allowed)})" if r.allowed else "CAST(array() AS ARRAY<STRING>)"
        low, high = ("NULL" if x is None else str(x) for x in (r.minimum, r.maximum))
        return (f"named_struct('field', '{_name(r)}', 'kind', '{r.kind}', 'allowed', {allowed}, 'lo', CAST({low} AS BIGINT), "
                f"'hi', CAST({high} AS BIGINT), 'v', {field_value(r.group, r.field)})")

    return f"array({', '.join(row(r) for r in contract)})"


def _breaches() -> str:
    """ARRAY<STRUCT<field, rule, value>> of one rule row r: r.d is the described value, r.b the same without
    its {value, source_field, evidence_substring} wrapper, r.outside the tallied items not allowed."""
    kind, bare_kind = kind_of("r.d"), kind_of("r.b")
    text, number = bare_text("r.b.v"), "try_variant_get(r.b.v, '$', 'bigint')"
    wanted = "CASE r.kind WHEN 'enum' THEN 'string' ELSE r.kind END"
    checks = [
        ("null_list", f"r.kind = 'list' AND {kind} = 'null'", bare_text("r.d.v")),
        ("type", f"r.kind = 'list' AND {kind} NOT IN ('null', 'list')", bare_text("r.d.v")),
        ("enum", f"r.kind = 'list' AND {kind} = 'list' AND size(r.outside) > 0", "array_join(array_sort(r.outside), ',')"),
        ("type", f"r.kind <> 'list' AND {bare_kind} <> 'null' AND {bare_kind} <> {wanted}", bare_text("r.d.v")),
        ("enum", f"r.kind = 'enum' AND {bare_kind} = 'string' AND NOT array_contains(r.allowed, {text})", text),
        ("range", f"r.kind = 'int' AND {bare_kind} = 'int' AND (coalesce({number} < r.lo, false) OR coalesce({number} > r.hi, false))", text),
    ]
    rows = ", ".join(f"CASE WHEN {bad} THEN named_struct('field', r.field, 'rule', '{rule}', 'value', {shown}) END"
                     for rule, bad, shown in checks)
    return f"array_compact(array({rows}))"


def _unknown_fields(contract: Sequence[FieldRule], group: str) -> str:
    names = ", ".join(f"'{r.field}'" for r in contract if r.group == group)
    keys = f"coalesce(map_keys(try_variant_get(record, '$.{group}', 'map<string,variant>')), CAST(array() AS ARRAY<STRING>))"
    prefix = GROUP_PREFIX.get(group, group)
    return (f"transform(array_except({keys}, array({names})), k -> named_struct('field', concat('{prefix}.', k), "
            "'rule', 'unknown_field', 'value', CAST(NULL AS STRING)))")


def validate_contract(records: DataFrame, contract: Sequence[FieldRule]) -> DataFrame:
    """Long rows (id, field, rule, value) of every breach: type, enum, range, null_list, unknown_field."""
    present = f"filter({_rule_rows(contract)}, r -> r.v IS NOT NULL)"
    described = (f"transform({present}, r -> named_struct('field', r.field, 'kind', r.kind, 'allowed', r.allowed, 'lo', r.lo, 'hi', r.hi, "
                 f"'d', {describe('r.v')}, 'b', {describe(unwrap('r.v'))}))")
    judged = (f"transform({described}, r -> named_struct('field', r.field, 'kind', r.kind, 'allowed', r.allowed, 'lo', r.lo, 'hi', r.hi, "
              f"'d', r.d, 'b', r.b, 'outside', CASE r.kind WHEN 'list' THEN array_except({tally_items('r.d')}, r.allowed) END))")
    known = f"flatten(transform({judged}, r -> {_breaches()}))"
    unknown = [_unknown_fields(contract, g) for g in dict.fromkeys(r.group for r in contract)]
    found = once(records.select("id", "record"), _b=F.expr(f"concat({', '.join([known, *unknown])})"))
    return found.select("id", F.inline("_b"))


def evidence_items(records: DataFrame, fields: Sequence[FieldRule]) -> DataFrame:
    """Long rows (id, field, source_field, evidence) of every extracted value, list items included.
    Bare scalars show up with null evidence."""
    def item(v: str) -> str:
        return (f"named_struct('field', x.field, 'source_field', try_variant_get({v}, '$.source_field', 'string'), "
                f"'evidence', try_variant_get({v}, '$.evidence_substring', 'string'))")

    body = (f"CASE WHEN {kind_of('x.d')} = 'list' THEN transform({list_items('x.d.v')}, y -> {item('y')}) "
            f"WHEN {is_filled('x.d')} THEN array({item('x.d.v')}) "
            "ELSE CAST(array() AS ARRAY<STRUCT<field: STRING, source_field: STRING, evidence: STRING>>) END")
    found = once(records.select("id", "record"), _e=F.flatten(_each_field(fields, body)))
    return found.select("id", F.inline("_e"))


def validate_evidence(items: DataFrame, corpus: DataFrame, id_col: str, sources: Mapping[str, str]) -> DataFrame:
    """Add `verdict`: ok, bare_value, unknown_source, no_row or not_found. The evidence must occur literally
    in the corpus column `sources[source_field]` of the same id."""
    texts = corpus.select(F.col(id_col).cast("string").alias("_cid"), *[F.col(c) for c in dict.fromkeys(sources.values())])
    joined = items.join(texts, items["id"] == texts["_cid"], "left")
    text = F.coalesce(*[F.when(F.col("source_field") == s, F.coalesce(F.col(c), F.lit(""))) for s, c in sources.items()])
    verdict = (F.when(F.coalesce(F.col("evidence"), F.lit("")) == "", "bare_value")
               .when(~F.coalesce(F.col("source_field").isin(*sources), F.lit(False)), "unknown_source")
               .when(F.col("_cid").isNull(), "no_row")
               .when(F.coalesce(F.contains(text, F.col("evidence")), F.lit(False)), "ok")
               .otherwise("not_found"))
    return joined.select(*items.columns, verdict.alias("verdict"))


def coverage_states(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids matched, missing from `actual`, or extra in it, with the share of the expected set."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    found = {"matched": F.col("_e") & F.col("_a"), "missing": F.col("_a").isNull(), "extra": F.col("_e").isNull()}
    totals = e.join(a, key, "full_outer").agg(*[F.count_if(test).alias(s) for s, test in found.items()])
    share = [F.try_divide(F.col(s), F.col("matched") + F.col("missing")).alias("share") for s in found]
    rows = [F.struct(F.lit(s).alias("state"), F.col(s).alias("n"), part) for s, part in zip(found, share)]
    return totals.select(F.inline(F.array(*rows))).where(F.col("n") > 0)


def missing_ids(expected: DataFrame, actual: DataFrame, key: str = "id", k: int | None = None) -> DataFrame:
    """Expected ids without a row in `actual`, lowest first."""
    lost = expected.select(key).distinct().join(actual.select(key), key, "left_anti")
    return lost if k is None else top_k(lost, [key], k)
