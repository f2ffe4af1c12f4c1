"""Dynamic record values held as VARIANT: fill test, comparable form, tally items.

The functions build SQL text. Tests on a value's type take a described value, `describe(v)`: a struct of
the value and its schema text, so the schema is derived once when it is bound by a lambda.
"""

from __future__ import annotations

_NO_ITEMS = "CAST(array() AS ARRAY<STRING>)"


def field_value(group: str, field: str, record: str = "record") -> str:
    """Value at group.field; null when the group is absent or not an object."""
    return f"try_variant_get({record}, '$.{group}.{field}', 'variant')"


def describe(v: str) -> str:
    return f"named_struct('v', {v}, 'schema', coalesce(schema_of_variant({v}), 'VOID'))"


def kind_of(d: str) -> str:
    """null / bool / int / float / string / list / object of a described value."""
    s = f"{d}.schema"
    return (f"CASE WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'STRING' THEN 'string' WHEN startswith({s}, 'ARRAY<') THEN 'list' "
            f"WHEN startswith({s}, 'OBJECT<') THEN 'object' WHEN {s} = 'BOOLEAN' THEN 'bool' "
            f"WHEN {s} = 'BIGINT' OR (startswith({s}, 'DECIMAL(') AND endswith({s}, ',0)')) THEN 'int' ELSE 'float' END")


def is_filled(d: str) -> str:
    """Not null, not `[]`, not `{}`; false, 0 and "" are filled. `[null]` shares the schema text of `[]`."""
    return (f"({d}.schema NOT IN ('VOID', 'ARRAY<VOID>', 'OBJECT<>') OR "
            f"({d}.schema = 'ARRAY<VOID>' AND try_variant_get({d}.v, '$[0]', 'variant') IS NOT NULL))")


def unwrap(v: str) -> str:
    """`{value: x}` becomes x; anything else stays."""
    return f"coalesce(try_variant_get({v}, '$.value', 'variant'), {v})"


def has_value_key(v: str) -> str:
    return f"(try_variant_get({v}, '$.value', 'variant') IS NOT NULL)"


def bare_text(v: str) -> str:
    """Text of a scalar, JSON of a list or object; null for a JSON null."""
    return f"try_variant_get({v}, '$', 'string')"


def as_text(v: str) -> str:
    return f"coalesce({bare_text(v)}, 'null')"


def signature(d: str) -> str:
    """Comparable scalar: kind tag plus text, numbers on one scale, so 1 = 1.0 but 1 <> '1'."""
    number = f"coalesce(CAST(try_variant_get({d}.v, '$', 'double') AS STRING), {as_text(f'{d}.v')})"
    kind = kind_of(d)
    return (f"CASE WHEN {kind} = 'null' THEN 'null' WHEN {kind} IN ('int', 'float') THEN concat('number:', {number}) "
            f"ELSE concat({kind}, ':', {as_text(f'{d}.v')}) END")


def list_items(v: str) -> str:
    """Items of a list value as ARRAY<VARIANT>; null for other kinds."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def normalise_value(d: str) -> str:
    """One string per value for equality: lists as sorted multisets, `{value}` wrappers removed."""
    is_list = f"startswith({d}.schema, 'ARRAY<')"
    items = f"CASE WHEN {is_list} THEN transform({list_items(f'{d}.v')}, i -> {unwrap('i')}) ELSE array({unwrap(f'{d}.v')}) END"
    signed = f"transform(transform({items}, i -> {describe('i')}), e -> {signature('e')})"
    return (f"CASE WHEN {d}.schema = 'VOID' THEN NULL WHEN {is_list} THEN concat('[', array_join(array_sort({signed}), chr(31)), ']') "
            f"ELSE get({signed}, 0) END")


def tally_items(d: str) -> str:
    """Texts counted for a value: list items that are strings or `{value}`, the wrapped value, or a bare
    string, integer or boolean. Floats and objects without `value` are not counted."""
    v, kind = f"{d}.v", kind_of(d)
    counted = f"filter({list_items(v)}, i -> schema_of_variant(i) = 'STRING' OR {has_value_key('i')})"
    return (f"CASE {kind} WHEN 'null' THEN {_NO_ITEMS} WHEN 'float' THEN {_NO_ITEMS} "
            f"WHEN 'list' THEN transform({counted}, i -> {as_text(unwrap('i'))}) "
            f"WHEN 'object' THEN CASE WHEN {has_value_key(v)} THEN array({as_text(unwrap(v))}) ELSE {_NO_ITEMS} END "
            f"ELSE array({as_text(v)}) END")
