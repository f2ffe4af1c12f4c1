"""Extraction-record queries: parse, merge, tallies, contract, evidence, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CONTRACT
from ..operators import compare, records
from ..operators.rules import field_rules
from ..sources.records import merge_runs, records_per_run, resolve_outputs
from .catalog import oracle, query, table, view

FIELDS = field_rules(CONTRACT)
EVIDENCE_SOURCES = {"description": "text"}


def parsed(spark: SparkSession, sf: str, run: str) -> DataFrame:
    return records.parse_lines(view(spark, sf, f"records_{run}_v"))


def final(spark: SparkSession, sf: str, run: str = "a") -> DataFrame:
    """Usable records of a run, the last one per id."""
    good = records.good_records(parsed(spark, sf, run)).select("id", "line_no", "record")
    return records.dedupe_last(good, "id", ["line_no"])


def _final_sql(run: str) -> str:
    return f"""parsed_{run} AS (SELECT line_no, line, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j
   FROM records_{run}_v WHERE trim(line) <> ''),
good_{run} AS (SELECT line_no, j, j->>'$.service_id' AS id FROM parsed_{run} WHERE json_type(j) = 'OBJECT' AND coalesce(j->>'$.service_id', '') <> ''),
final_{run} AS (SELECT id, j FROM good_{run} QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"""


_FIELD_ROWS = ", ".join(f"({i}, '{r.group}', '{r.field}', '{records.GROUP_PREFIX[r.group]}.{r.field}')" for i, r in enumerate(FIELDS))
_FILLED = """(v IS NOT NULL AND json_type(v) <> 'NULL' AND NOT (json_type(v) = 'ARRAY' AND json_array_length(v) = 0)
  AND NOT (json_type(v) = 'OBJECT' AND len(json_keys(v)) = 0))"""


def _text(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'NULL' THEN 'null' ELSE {v}->>'$' END"


def _unwrap(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'OBJECT' AND json_exists({v}, '$.value') THEN {v}->'$.value' ELSE {v} END"


def _signature(v: str) -> str:
    return f"""CASE WHEN json_type({v}) = 'NULL' THEN 'null'
      WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number:' || CAST(CAST({v}->>'$' AS DOUBLE) AS VARCHAR)
      WHEN json_type({v}) = 'BOOLEAN' THEN 'bool:' || ({v}->>'$') WHEN json_type({v}) = 'VARCHAR' THEN 'string:' || ({v}->>'$')
      ELSE 'object:' || CAST({v} AS VARCHAR) END"""


def _long_sql(run: str) -> str:
    """Long rows (id, field, filled, sig) of a run; items are unnested once and put back per value."""
    return f"""fields(no, grp, fld, field) AS (VALUES {_FIELD_ROWS}),
raw_{run} AS (SELECT id, no, field, json_extract(j, '$.' || grp || '.' || fld) AS v FROM final_{run}, fields),
long_{run} AS (SELECT id, no, field, v, {_FILLED} AS filled, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN NULL
   WHEN json_type(v) = 'ARRAY' THEN '[' || array_to_string(list_sort(list_transform(json_extract(v, '$[*]'), lambda x: {_signature(f"({_unwrap('x')})")})), chr(31)) || ']'
   ELSE {_signature(f"({_unwrap('v')})")} END AS sig FROM raw_{run})"""


def _oracle(body: str, *runs: str, long: bool = True, extra: str = "") -> str:
    ctes = [_final_sql(r) for r in runs]
    if long:
        ctes += [_long_sql(r) if i == 0 else _long_sql(r).split("\n", 1)[1] for i, r in enumerate(runs)]
    return oracle(body, *[f"records_{r}_v" for r in runs], extra=", ".join(ctes + ([extra] if extra else [])))


@query("records_parse", _oracle("SELECT line_no, id, j->>'$.schema_version' AS version FROM good_a", "a", long=False))
def records_parse(spark, sf):
    return records.good_records(parsed(spark, sf, "a")).select(
        "line_no", "id", F.try_variant_get("record", "$.schema_version", "string").alias("version"))


@query("records_quarantine", _oracle("""SELECT line_no, line, CASE WHEN j IS NULL THEN 'bad_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object'
  ELSE 'no_id' END AS problem FROM parsed_a WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR coalesce(j->>'$.service_id', '') = ''""", "a", long=False))
def records_quarantine(spark, sf):
    return records.quarantine(parsed(spark, sf, "a")).select("line_no", "line", "problem")


_MANIFEST = "SELECT DISTINCT source AS run_id, CAST(substr(source, 4) AS INTEGER) AS chunk_id FROM documents UNION ALL SELECT 'absent', 99"


@query("merge_counts", oracle(f"""SELECT concat('chunk ', chunk_id) AS chunk, run_id AS run, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'ok' END AS status,
   coalesce(n, 0) AS records FROM manifest LEFT JOIN counts USING (run_id)
  UNION ALL SELECT 'TOTAL', '', '', CAST(sum(coalesce(n, 0)) AS BIGINT) FROM manifest LEFT JOIN counts USING (run_id)""", "records_a_v",
  extra=f"manifest AS ({_MANIFEST}), counts AS (SELECT run_id, count(*) FILTER (trim(line) <> '') AS n FROM records_a_v GROUP BY run_id)"))
def merge_counts(spark, sf):
    found = table(spark, sf, "documents").select(
        F.col("source").alias("run_id"), F.substring("source", 4, 10).cast("int").alias("chunk_id")).distinct()
    absent = spark.range(1).select(F.lit("absent").alias("run_id"), F.lit(99).alias("chunk_id"))
    return merge_runs(found.unionByName(absent), view(spark, sf, "records_a_v").select("run_id", "line"))


@query("records_per_run", oracle("""SELECT run_id AS run, CAST(count(*) AS BIGINT) AS loaded, count(DISTINCT id) AS distinct_n
   FROM good_a JOIN (SELECT line_no, run_id FROM records_a_v) USING (line_no) GROUP BY run_id
  UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT id) FROM good_a""", "records_a_v", extra=_final_sql("a")))
def per_run(spark, sf):
    return records_per_run(records.good_records(parsed(spark, sf, "a")))


_CANDIDATES = """candidates AS (SELECT o_orderkey AS run_id, p AS priority, concat('runs/', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '/', d, '/', o_orderkey) AS path
  FROM orders, (VALUES (1, 'main'), (2, 'other'), (3, 'strict')) v(p, d)),
listing AS (SELECT path FROM candidates JOIN orders ON o_orderkey = run_id
  WHERE (o_orderstatus = 'F' AND priority >= 2) OR (o_orderstatus = 'P' AND priority = 3))"""


@query("first_candidate", oracle("""SELECT run_id, arg_min(c.path, priority) FILTER (l.path IS NOT NULL) AS path FROM candidates c
  LEFT JOIN listing l ON l.path = c.path GROUP BY run_id""", extra=_CANDIDATES))
def first_candidate(spark, sf):
    orders = table(spark, sf, "orders")
    names = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(d).alias("name")) for p, d in [(1, "main"), (2, "other"), (3, "strict")]])
    both = orders.select("o_orderkey", "o_orderdate", "o_orderstatus", F.inline(names)).select(
        F.col("o_orderkey").alias("run_id"), "priority", "o_orderstatus",
        F.concat_ws("/", F.lit("runs"), F.col("o_orderdate").cast("date").cast("string"), "name", F.col("o_orderkey").cast("string")).alias("path"))
    exists = ((F.col("o_orderstatus") == "F") & (F.col("priority") >= 2)) | ((F.col("o_orderstatus") == "P") & (F.col("priority") == 3))
    return resolve_outputs(both.select("run_id", "priority", "path"), both.where(exists))


@query("field_fill", _oracle("SELECT field, count(*) FILTER (filled) AS n FROM long_a GROUP BY field", "a"))
def field_fill(spark, sf):
    return records.field_fill(final(spark, sf), FIELDS)


_ITEMS = f"""items AS (SELECT field, {_text("x->'$.value'")} AS value FROM (SELECT field, unnest(json_extract(v, '$[*]')) AS x FROM long_a WHERE json_type(v) = 'ARRAY')
    WHERE json_type(x) = 'OBJECT' AND json_exists(x, '$.value')
  UNION ALL SELECT field, x->>'$' FROM (SELECT field, unnest(json_extract(v, '$[*]')) AS x FROM long_a WHERE json_type(v) = 'ARRAY') WHERE json_type(x) = 'VARCHAR'
  UNION ALL SELECT field, {_text("v->'$.value'")} FROM long_a WHERE json_type(v) = 'OBJECT' AND json_exists(v, '$.value')
  UNION ALL SELECT field, v->>'$' FROM long_a WHERE json_type(v) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'BOOLEAN'))"""


@query("field_top_values", _oracle("""SELECT field, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS INTEGER) AS rank
  FROM items GROUP BY field, value QUALIFY rank <= 5""", "a", extra=_ITEMS))
def field_top_values(spark, sf):
    return records.field_top_values(final(spark, sf), FIELDS, 5)


@query("record_coverage", _oracle("""SELECT (SELECT count(*) FROM final_a) AS records_n,
  (SELECT count(DISTINCT id) FROM long_a WHERE filled AND field LIKE 'pub.%') AS pub_filled_n,
  (SELECT count(DISTINCT id) FROM long_a WHERE filled AND field LIKE 'pre.%') AS pre_filled_n,
  (SELECT count(*) FROM final_a WHERE json_array_length(j->'$.conflicts') > 0) AS with_conflicts_n,
  (SELECT CAST(sum(json_array_length(j->'$.conflicts')) AS BIGINT) FROM final_a) AS conflicts_n""", "a"))
def record_coverage(spark, sf):
    return records.record_coverage(final(spark, sf), FIELDS)


_CONFLICTS = "SELECT unnest(json_extract(j, '$.conflicts[*]')) AS c FROM final_a"


@query("conflict_counts", _oracle(f"""SELECT * FROM (SELECT 'field' AS kind, coalesce(c->>'$.field', '?') AS value, count(*) AS n FROM ({_CONFLICTS}) GROUP BY 2 ORDER BY n DESC, value LIMIT 20)
  UNION ALL SELECT 'type', coalesce(c->>'$.type', '?'), count(*) FROM ({_CONFLICTS}) GROUP BY 2""", "a", long=False))
def conflict_counts(spark, sf):
    recs = final(spark, sf)
    by_field = records.conflict_counts(recs, "field", 20).withColumn("kind", F.lit("field"))
    return by_field.unionByName(records.conflict_counts(recs, "type").withColumn("kind", F.lit("type"))).select("kind", "value", "n")


_RULES = ", ".join(
    f"""('{records.GROUP_PREFIX[r.group]}.{r.field}', '{r.kind}', {'[' + ', '.join(repr(a) for a in r.allowed) + ']' if r.allowed else '[]::VARCHAR[]'},
  {'NULL' if r.minimum is None else r.minimum}::BIGINT, {'NULL' if r.maximum is None else r.maximum}::BIGINT)""" for r in FIELDS)
_CHECKS = f"""rules(field, kind, allowed, lo, hi) AS (VALUES {_RULES}),
checked AS (SELECT id, field, kind, allowed, lo, hi, v, json_type(v) AS t, {_unwrap('v')} AS b FROM long_a JOIN rules USING (field) WHERE v IS NOT NULL),
tallied AS (SELECT id, field, list_distinct(list_filter(list_transform(list_filter(json_extract(v, '$[*]'),
    lambda x: json_type(x) = 'VARCHAR' OR (json_type(x) = 'OBJECT' AND json_exists(x, '$.value'))), lambda x: ({_unwrap('x')})->>'$'),
    lambda s: NOT list_contains(allowed, s))) AS outside FROM checked WHERE kind = 'list' AND t = 'ARRAY')"""


@query("contract_violations", _oracle("""SELECT id, field, 'null_list' AS rule, NULL AS value FROM checked WHERE kind = 'list' AND t = 'NULL'
  UNION ALL SELECT id, field, 'type', v->>'$' FROM checked WHERE kind = 'list' AND t NOT IN ('NULL', 'ARRAY')
  UNION ALL SELECT id, field, 'enum', array_to_string(list_sort(outside), ',') FROM tallied WHERE len(outside) > 0
  UNION ALL SELECT id, field, 'type', v->>'$' FROM checked WHERE kind <> 'list' AND json_type(b) <> 'NULL' AND NOT (
    (kind = 'int' AND json_type(b) IN ('BIGINT', 'UBIGINT')) OR (kind = 'bool' AND json_type(b) = 'BOOLEAN') OR (kind = 'enum' AND json_type(b) = 'VARCHAR'))
  UNION ALL SELECT id, field, 'enum', b->>'$' FROM checked WHERE kind = 'enum' AND json_type(b) = 'VARCHAR' AND NOT list_contains(allowed, b->>'$')
  UNION ALL SELECT id, field, 'range', b->>'$' FROM checked WHERE kind = 'int' AND json_type(b) IN ('BIGINT', 'UBIGINT')
    AND (CAST(b->>'$' AS BIGINT) < lo OR CAST(b->>'$' AS BIGINT) > hi)
  UNION ALL SELECT id, concat('pub.', k), 'unknown_field', NULL FROM (SELECT id, unnest(json_keys(j, '$.publics_extended')) AS k FROM final_a)
    WHERE concat('pub.', k) NOT IN (SELECT field FROM fields)
  UNION ALL SELECT id, concat('pre.', k), 'unknown_field', NULL FROM (SELECT id, unnest(json_keys(j, '$.prerequis_extended')) AS k FROM final_a)
    WHERE concat('pre.', k) NOT IN (SELECT field FROM fields)""", "a", extra=_CHECKS))
def contract_violations(spark, sf):
    return records.validate_contract(final(spark, sf), FIELDS)


_EVIDENCE = """ev AS (SELECT id, field, x->>'$.source_field' AS source_field, x->>'$.evidence_substring' AS evidence
    FROM (SELECT id, field, unnest(json_extract(v, '$[*]')) AS x FROM long_a WHERE json_type(v) = 'ARRAY')
  UNION ALL SELECT id, field, v->>'$.source_field', v->>'$.evidence_substring' FROM long_a WHERE filled AND json_type(v) <> 'ARRAY')"""


@query("evidence_check", _oracle("""SELECT id, field, source_field, evidence, CASE WHEN coalesce(evidence, '') = '' THEN 'bare_value'
   WHEN coalesce(source_field, '') <> 'description' THEN 'unknown_source' WHEN doc_id IS NULL THEN 'no_row'
   WHEN contains(text, evidence) THEN 'ok' ELSE 'not_found' END AS verdict
  FROM ev LEFT JOIN documents ON id = concat('d', doc_id)""", "a", extra=_EVIDENCE))
def evidence_check(spark, sf):
    corpus = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return records.validate_evidence(records.evidence_items(final(spark, sf), FIELDS), corpus, "id", EVIDENCE_SOURCES)


_DOCS_LABELS = "SELECT {cols} FROM documents FULL JOIN labels ON documents.doc_id = labels.doc_id"


@query("coverage_states", f"""SELECT state, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM (
  {_DOCS_LABELS.format(cols="CASE WHEN documents.doc_id IS NULL THEN 'extra' WHEN labels.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS state")}) GROUP BY state""")
def coverage_states(spark, sf):
    return records.coverage_states(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf):
    return records.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


# -- comparison of two runs ------------------------------------------------------------------------

def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.paired(final(spark, sf, "a"), final(spark, sf, "b"), FIELDS)


_PAIRS = """pairs AS (SELECT a.id, a.no, a.field, a.filled AS fa, b.filled AS fb, a.sig AS a, b.sig AS b FROM long_a a JOIN long_b b USING (id, field))"""


@query("align_runs", _oracle("""SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'common' END AS side, count(*) AS n
  FROM final_a a FULL JOIN final_b b ON a.id = b.id GROUP BY 1""", "a", "b", long=False))
def align_runs(spark, sf):
    return compare.align_runs(final(spark, sf, "a"), final(spark, sf, "b"))


@query("compare_fields", _oracle("""SELECT field, count(*) FILTER (fa) AS filled_a_n, count(*) FILTER (fb) AS filled_b_n, count(*) FILTER (fa AND fb) AS both_n,
  count(*) FILTER (fa AND fb AND a IS NOT DISTINCT FROM b) AS agree_n, round(count(*) FILTER (fa AND fb AND a IS NOT DISTINCT FROM b) * 100 / nullif(count(*) FILTER (fa AND fb), 0), 6) AS agree_pct
  FROM pairs GROUP BY field""", "a", "b", extra=_PAIRS))
def compare_fields(spark, sf):
    return compare.compare_fields(_pairs(spark, sf)).withColumn("agree_pct", F.round("agree_pct", 6))


def _side_sql(run: str) -> str:
    s = run.lower()
    return f"""SELECT '{run}' AS run, (SELECT count(DISTINCT id) FROM pairs) AS common_n, (SELECT count(DISTINCT id) FROM pairs WHERE f{s}) AS covered_n,
  CAST(sum(coalesce(json_array_length(j->'$.conflicts'), 0)) AS BIGINT) AS conflicts_n, count(*) FILTER (json_array_length(j->'$.conflicts') > 0) AS with_conflicts_n
  FROM final_{s} WHERE id IN (SELECT id FROM pairs)"""


@query("compare_coverage", _oracle(f"{_side_sql('A')} UNION ALL {_side_sql('B')}", "a", "b", extra=_PAIRS))
def compare_coverage(spark, sf):
    return compare.compare_coverage(_pairs(spark, sf))


@query("top_disagreements", _oracle("""SELECT id, diffs_n, CAST(pos AS INTEGER) AS pos, field, a, b FROM (
   SELECT id, CAST(count(*) OVER (PARTITION BY id) AS INTEGER) AS diffs_n, row_number() OVER (PARTITION BY id ORDER BY no) AS pos, field, a, b FROM pairs
   WHERE (fa OR fb) AND a IS DISTINCT FROM b)
  WHERE pos <= 8 AND id IN (SELECT id FROM pairs WHERE (fa OR fb) AND a IS DISTINCT FROM b GROUP BY id ORDER BY count(*) DESC, id DESC LIMIT 10)""", "a", "b", extra=_PAIRS))
def top_disagreements(spark, sf):
    top = compare.top_disagreements(_pairs(spark, sf))
    return top.select("id", "diffs_n", F.posexplode("details").alias("_p", "d")).select(
        "id", "diffs_n", (F.col("_p") + 1).alias("pos"), "d.field", "d.a", "d.b")


@query("ids_intersect", _oracle("SELECT id FROM final_a INTERSECT SELECT id FROM final_b", "a", "b", long=False))
def ids_intersect(spark, sf):
    return compare.ids_intersect(final(spark, sf, "a"), final(spark, sf, "b"))


@query("ids_except", _oracle("SELECT id FROM final_a EXCEPT SELECT id FROM final_b", "a", "b", long=False))
def ids_except(spark, sf):
    return compare.ids_except(final(spark, sf, "a"), final(spark, sf, "b"))
