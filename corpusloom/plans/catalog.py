"""Query registry and the views that map the test tables onto the data model."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import stream_events

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; `sql` is its check on the other engine."""
    def register(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them: a stream takes a single file only by a glob."""
    return stream_events(spark, f"{sf.rstrip('/')}/{name}.parque[t]", table(spark, sf, name).schema)


def _json_text(expr: str) -> str:
    """SQL that escapes a text for use inside a JSON string."""
    for char, code in (("chr(92)", "chr(92)"), ("'\"'", "'\"'"), ("chr(10)", "'n'"), ("chr(13)", "'r'"), ("chr(9)", "'t'")):
        expr = f"replace({expr}, {char}, concat(chr(92), {code}))"
    return expr


def _record_lines(shift: int) -> str:
    """Extraction output of one run as JSON lines, with bad, blank, id-less and repeated records."""
    n = f"(doc_id + {shift})"
    # evidence stands at the start, within and towards the end of texts
    word = "regexp_extract(substr(text, CAST(floor(length(text) * (0.3 * (doc_id % 4))) AS INTEGER) + 1), '[A-Za-z]{3,}', 0)"
    proof = f"\"source_field\":\"description\",\"evidence_substring\":\"', {word}, '\""
    return f"""
SELECT doc_id AS line_no, source AS run_id,
       CASE WHEN {n} % 50 = 7 THEN '{{bad' WHEN {n} % 49 = 3 THEN '   ' WHEN {n} % 53 = 5 THEN '[1]'
            WHEN {n} % 37 = 11 THEN NULL
            ELSE concat('{{"service_id":"',
              CASE WHEN {n} % 47 = 2 THEN '' WHEN doc_id % 10 = 9 THEN concat('d', CAST(doc_id - 1 AS VARCHAR(20)))
                   ELSE concat('d', CAST(doc_id AS VARCHAR(20))) END,
              '","schema_version":"v0.2","publics_extended":{{"age_min":',
              CASE {n} % 4 WHEN 0 THEN 'null' WHEN 1 THEN '18' WHEN 2 THEN concat('{{"value":25,{proof}}}') ELSE '130' END,
              ',"statut_principal":',
              CASE lang WHEN 'fr' THEN concat('{{"value":"etudiant",{proof}}}')
                        WHEN 'de' THEN '{{"value":"other","source_field":"description","evidence_substring":"#absent#"}}'
                        WHEN 'es' THEN '"retraite"' ELSE 'null' END,
              ',"qualificateurs":',
              CASE {n} % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["femme"]' WHEN 2 THEN '[{{"value":"senior"}},"femme",2.5]'
                           WHEN 3 THEN 'null' ELSE '["femme","senior"]' END,
              CASE WHEN doc_id % 31 = 0 THEN ',"tags":1' ELSE '' END,
              '}},"prerequis_extended":',
              CASE WHEN {n} % 19 = 0 THEN '3'
                   ELSE concat('{{"plafond_ressources":', CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END,
                               ',"revenu_fiscal_max_eur_par_part":',
                               CASE {n} % 6 WHEN 0 THEN '14000.5' WHEN 1 THEN '-3' WHEN 2 THEN '"14000"' ELSE '14000' END, '}}') END,
              ',"conflicts":',
              CASE {n} % 7 WHEN 0 THEN '[{{"type":"contradiction","field":"age_min"}}]'
                           WHEN 1 THEN '[{{"field":"statut_principal"}},{{"type":"under_specification"}}]'
                           WHEN 2 THEN 'null' ELSE '[]' END, '}}') END AS line
FROM {{documents}}"""


# Engine-neutral SQL. {name} is a table; PLUS_S(ts, seconds) adds seconds.
VIEWS: dict[str, str] = {
    "services_v": """
SELECT d.doc_id AS id, CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE d.source END AS source,
       CAST(l.quality + 1 - l.toxic AS DOUBLE) / 2 AS score,
       split(nullif(concat_ws(',', CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END,
                                   CASE WHEN d.lang <> 'en' THEN d.lang END), ''), ',') AS publics,
       CASE WHEN d.lang = 'fr' THEN d.text WHEN d.doc_id % 11 = 0 THEN '   ' WHEN d.doc_id % 13 = 0 THEN '' END AS precisions,
       CASE WHEN l.toxic = 1 THEN d.text END AS conditions,
       d.text AS description
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "sources_v": """
SELECT doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE source END AS source FROM {documents}""",
    "structures_v": """
SELECT p_partkey AS id, p_name AS nom, p_type AS description, split(lower(concat_ws(',', p_type, p_brand)), ',') AS codes
FROM {part}""",
    "children_v": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS source,
       CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_partkey END AS structure_id
FROM {lineitem}""",
    "runs_v": """
SELECT o_orderkey AS id, o_custkey AS pipeline_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'queued' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS idempotency_key,
       o_orderpriority AS priority, o_orderdate AS created_at
FROM {orders}""",
    "ledger_v": """
SELECT o_orderkey AS id, o_custkey AS pipeline_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'starting' WHEN 2 THEN 'running' WHEN 3 THEN 'completed'
                           WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'timed_out' ELSE 'quota_blocked' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('job', CAST(o_orderkey AS VARCHAR(20))) END AS job_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE PLUS_S(o_orderdate, o_orderkey % 200) END AS last_heartbeat_at,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS started_at,
       CASE WHEN o_orderkey % 8 IN (3, 4, 5, 6) THEN PLUS_S(o_orderdate, o_orderkey % 100) END AS finished_at,
       CASE WHEN o_orderkey % 13 = 0 THEN 'boom' WHEN o_orderkey % 13 = 1 THEN '' END AS error_text,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS secret
FROM {orders}""",
    "job_states_v": """
SELECT concat('job', CAST(o_orderkey AS VARCHAR(20))) AS job_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'succeeded' WHEN '2-HIGH' THEN 'failed' WHEN '3-MEDIUM' THEN 'canceled'
                            WHEN '5-LOW' THEN 'internal_error' ELSE 'running' END AS state
FROM {orders}""",
    "raw_events_v": """
SELECT user_id * 16 + event_id % 16 AS run_id, event_id, ts, value,
       CASE event_type WHEN 'view' THEN 'heartbeat'
            WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'starting' ELSE 'dispatched' END
            WHEN 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'cancel' WHEN 1 THEN 'result' WHEN 2 THEN 'timeout'
                                                   ELSE 'assistant_message' END
            WHEN 'signup' THEN 'quota_hit'
            ELSE CASE WHEN event_id % 17 = 0 THEN 'dispatch_error' ELSE 'error' END END AS event_type
FROM {events}""",
    "outcome_events_v": """
SELECT user_id * 16 + event_id % 16 AS run_id, event_id,
       CASE event_type WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'cancelled'
            WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'message' END ELSE 'message' END AS event_type,
       CASE WHEN event_type = 'error' THEN event_id % 3 END AS exit_code, props AS stderr
FROM {events}""",
    "records_a_v": _record_lines(0),
    "records_b_v": _record_lines(1),
    "uris_v": """
SELECT page_id AS id,
       CASE page_id % 11 WHEN 0 THEN '' WHEN 1 THEN concat('  ', replace(url, 'http', 'HTTP'), chr(10))
            WHEN 2 THEN replace(url, 'http', 'ftp') WHEN 3 THEN concat('s3://bucket/', replace(url, '://', '/'))
            WHEN 4 THEN concat('just-a-key?sig=', CAST(page_id AS VARCHAR(20)))
            WHEN 5 THEN concat(replace(url, '://', '://u:p@'), '#frag') WHEN 6 THEN 's3://bucket/' WHEN 7 THEN 's3:///key'
            WHEN 8 THEN concat('https://Host.Test:8443/a/', CAST(page_id AS VARCHAR(20)), '?x=1#f')
            WHEN 9 THEN 'https://host:port/x' ELSE url END AS uri
FROM {pages}""",
    "bodies_v": """
SELECT event_id AS id,
       CASE event_id % 9 WHEN 0 THEN concat('{"prompt":"do ', event_type, '","k":1}')
            WHEN 1 THEN concat('\ufeff', '{"prompt":"x"}') WHEN 2 THEN '{"prompt":null}' WHEN 3 THEN '{"prompt":42}'
            WHEN 4 THEN '{"prompt":"   "}' WHEN 5 THEN concat('[', props, ']') WHEN 6 THEN concat('\ufeff', event_type)
            WHEN 7 THEN '{"prompt":{"a":1}}' ELSE props END AS body
FROM {events}""",
    "session_lines_v": f"""
SELECT conv_id AS run_id, turn AS line_no,
       CASE WHEN (conv_id + turn) % 23 = 5 THEN concat('{{bad ', {_json_text('text')}) WHEN (conv_id + turn) % 29 = 7 THEN '   '
            WHEN (conv_id + turn) % 31 = 9 THEN '{{"type":"error","code":7}}'
            WHEN turn = 6 THEN '{{"type":"result","subtype":"success","duration_ms":12,"num_turns":3,"usage":{{"n":1}}}}'
            WHEN role = 'assistant' THEN concat('{{"type":"assistant","message":{{"content":[{{"type":"text","text":" ', {_json_text('text')}, ' "}}',
                 CASE WHEN turn % 3 = 1 THEN ',{{"type":"tool_use","name":"grep","id":"t1","input":{{"q":1}}}}' ELSE '' END,
                 CASE WHEN turn % 4 = 3 THEN ',{{"type":"text","text":"  "}}' ELSE '' END, ']}}}}')
            WHEN role = 'user' THEN concat('{{"type":"user","message":{{"content":[{{"type":"tool_result","tool_use_id":"t1","content":"',
                 {_json_text('text')}, '"}},{{"type":"note"}},{{"type":"tool_result","tool_use_id":"t2","content":"ok"}}]}}}}')
            WHEN role = 'system' THEN '{{"type":"system","subtype":"init","message":"m"}}' ELSE '{{"type":"ping"}}' END AS line
FROM {{conversations}}""",
    "phrases_v": """
SELECT doc_id AS id, concat(text, CASE doc_id % 10 WHEN 0 THEN ' moins de 26 ans' WHEN 1 THEN ' 18 ans et plus'
            WHEN 2 THEN ' de 16 a 25 ans' WHEN 3 THEN ' jusqu''a 30 ans' WHEN 4 THEN ' Age minimum : 0 Age maximum : 120'
            WHEN 5 THEN ' a partir de 50 ans, moins de 60 ans' ELSE '' END,
       CASE doc_id % 4 WHEN 0 THEN ' sans condition de ressources' WHEN 1 THEN ' sous conditions de ressources' ELSE '' END,
       CASE doc_id % 3 WHEN 0 THEN ' trouver un CDI' WHEN 1 THEN ' salarie en CDI' ELSE '' END) AS text
FROM {documents}""",
    "checklists_v": """
SELECT o_orderkey AS id, concat_ws(chr(10), '# list', CASE WHEN o_orderstatus = 'F' THEN '- [x] a' WHEN o_orderstatus = 'P' THEN '- [ ] a' END,
       CASE WHEN o_totalprice > 250000 THEN '   - [X] b' ELSE '- [-] b' END, CASE WHEN o_orderpriority = '5-LOW' THEN '  - [ ] c' END, 'end - [x]') AS text
FROM {orders}""",
}

_PLUS = re.compile(r"PLUS_S\(([^,]+), ([^)]+)\)")
_TABLE = re.compile(r"\{([a-z]+)\}")


def mapped(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A mapping view over the given tables, which may be streams."""
    sql = _PLUS.sub(r"(\1 + make_dt_interval(0, 0, 0, \2))", VIEWS[name])
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return spark.sql(sql, **tables)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The mapping view over the tables of `sf`."""
    tables = {t: table(spark, sf, t) for t in set(_TABLE.findall(VIEWS[name]))}
    return mapped(spark, name, **tables)


def oracle(body: str, *views: str, extra: str = "") -> str:
    """SQL text with the named views as CTEs in front; `extra` holds further CTEs."""
    ctes = [f"{v} AS ({_TABLE.sub(r'\1', _PLUS.sub(r'(\1 + to_seconds(\2))', VIEWS[v]))})" for v in views]
    if extra:
        ctes.append(extra)
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
