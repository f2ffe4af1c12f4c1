"""Scan, profile, sampling and chunking queries over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import SAMPLE_ALPHA, SAMPLE_QUOTAS, SAMPLE_SEED, SAMPLE_SIZES, SEED_PICK_QUOTAS
from ..functions.predicates import coverage_bucket, filled, richness_stratum, score_boost
from ..functions.text import within_size
from ..operators import chunking, profile, sampling
from ..session import cut
from ..sources.tables import json_rows, read_corpus, subset_by_ids
from .catalog import oracle, query, table, view

TEXT_FIELDS = ["precisions", "conditions", "description"]
SMALL_BODY = 1000

_STRATUM = """CASE WHEN length(trim(coalesce(precisions, ''))) > 0 OR length(trim(coalesce(conditions, ''))) > 0 THEN 'rich'
     WHEN coalesce(len(publics), 0) > 0 THEN 'norm_only' ELSE 'sparse' END"""
_BOOST = "CASE WHEN score < 0.50 THEN 2.0 WHEN score < 0.75 THEN 1.5 ELSE 1.0 END"
_HASH = f"md5(concat(CAST(id AS VARCHAR), '{SAMPLE_SEED}'))"
_WEIGHTED = f"""weighted AS (SELECT s.id, s.source, s.score, {_STRATUM} AS stratum, c.source_count, CAST({_BOOST} AS DOUBLE) AS score_boost,
       CAST({_BOOST} AS DOUBLE) / pow(c.source_count, {SAMPLE_ALPHA}) AS weight
  FROM services_v s JOIN (SELECT source, count(*) AS source_count FROM services_v GROUP BY source) c ON s.source = c.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum
     ORDER BY -ln((CAST(concat('0x', substr({_HASH}, 1, 13)) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0) / weight, id) AS rn FROM weighted),
quotas(sample, stratum, q) AS (VALUES {", ".join(
    f"('{name}', '{s}', {q})" for name, n in SAMPLE_SIZES.items() for s, q in sampling.quota_sizes(n, SAMPLE_QUOTAS).items())}),
nested AS (SELECT sample, r.* FROM ranked r JOIN quotas USING (stratum) WHERE rn <= q)"""


def services(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "services_v")


def stratified(spark: SparkSession, sf: str) -> DataFrame:
    """id, source, score and stratum; texts are reduced to the stratum in the scan stage."""
    return services(spark, sf).select("id", "source", "score",
                                      richness_stratum(["precisions", "conditions"], "publics").alias("stratum"))


@query("scan_project", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 200")
def scan_project(spark, sf):
    cols = ["doc_id", "lang", "source", "n_chars"]
    return read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", cols).where(F.col("n_chars") >= 200)


def _fill_sql(f: str) -> str:
    return f"""SELECT '{f}' AS field, 'ok' AS status, count(*) FILTER ({f} IS NULL) AS null_n,
  count(*) FILTER (length({f}) = 0) AS empty_n, count(*) FILTER (length({f}) > 0 AND length(trim({f})) = 0) AS whitespace_n,
  count(*) FILTER (length(trim({f})) > 0) AS filled_n, count(*) FILTER (length(trim({f})) > 0) / count(*) AS filled_share FROM services_v"""


@query("fill_rates", oracle(" UNION ALL ".join(map(_fill_sql, TEXT_FIELDS)) +
       " UNION ALL SELECT 'presentation', 'MISSING', NULL, NULL, NULL, NULL, NULL", "services_v"))
def fill_rates(spark, sf):
    return profile.fill_rates(services(spark, sf), [*TEXT_FIELDS, "presentation"])


@query("length_profile", oracle(" UNION ALL ".join(
    f"""SELECT '{f}' AS field, count(*) AS n, CAST(min(length({f})) AS INTEGER) AS min, CAST(max(length({f})) AS INTEGER) AS max,
  round(quantile_cont(length({f}), 0.25), 4) AS p25, round(quantile_cont(length({f}), 0.5), 4) AS p50,
  round(quantile_cont(length({f}), 0.75), 4) AS p75, round(quantile_cont(length({f}), 0.95), 4) AS p95
  FROM services_v WHERE length(trim({f})) > 0""" for f in TEXT_FIELDS), "services_v"))
def length_profile(spark, sf):
    dist = profile.length_profile(services(spark, sf), TEXT_FIELDS)
    return dist.withColumns({p: F.round(p, 4) for p in ("p25", "p50", "p75", "p95")})


_NUMERIC = """count(*) AS n, count(*) FILTER ({c} IS NULL) AS null_n, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,
  round(quantile_cont({c}, 0.05), 4) AS p05, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.95), 4) AS p95"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "p05", "p25", "p50", "p75", "p95")})


@query("numeric_profile", f"SELECT {_NUMERIC.format(c='o_totalprice')} FROM orders")
def numeric_profile(spark, sf):
    return _rounded(profile.numeric_profile(table(spark, sf, "orders"), "o_totalprice"))


@query("numeric_profile_by", oracle(f"SELECT source, {_NUMERIC.format(c='score')} FROM services_v GROUP BY source", "services_v"))
def numeric_profile_by(spark, sf):
    return _rounded(profile.numeric_profile(services(spark, sf), "score", by="source"))


@query("source_share", oracle("SELECT source AS value, count(*) AS n, count(*) / (SELECT count(*) FROM sources_v) AS share"
                              " FROM sources_v GROUP BY source", "sources_v"))
def source_share(spark, sf):
    return profile.value_counts(view(spark, sf, "sources_v"), "source")


@query("array_value_counts", oracle("SELECT value, count(*) AS n FROM (SELECT unnest(publics) AS value FROM services_v)"
                                    " GROUP BY value ORDER BY n DESC, value LIMIT 30", "services_v"))
def array_value_counts(spark, sf):
    return profile.array_value_counts(services(spark, sf), "publics", 30)


_SHARED = "SELECT {b} AS bucket, count(*) AS n, count(*) / (SELECT count(*) FROM services_v) AS share FROM services_v GROUP BY 1"


@query("array_card_buckets", oracle(_SHARED.format(b="""CASE WHEN coalesce(len(publics), 0) = 0 THEN 'empty / null' WHEN len(publics) = 1
  THEN '1 value' WHEN len(publics) = 2 THEN '2 values' ELSE '3+ values' END"""), "services_v"))
def array_card_buckets(spark, sf):
    return profile.card_buckets(services(spark, sf), "publics")


@query("score_buckets", oracle(_SHARED.format(b="""CASE WHEN score IS NULL THEN 'null' WHEN score < 0.25 THEN '< 0.25'
  WHEN score < 0.5 THEN '0.25 - 0.50' WHEN score < 0.75 THEN '0.50 - 0.75' ELSE '>= 0.75' END"""), "services_v"))
def score_buckets(spark, sf):
    return profile.score_buckets(services(spark, sf), "score")


@query("score_boost", oracle(f"SELECT id, CAST({_BOOST} AS DOUBLE) AS score_boost FROM services_v", "services_v"))
def boost(spark, sf):
    return services(spark, sf).select("id", score_boost("score").alias("score_boost"))


@query("crosstab_coverage", oracle("""SELECT CASE WHEN coalesce(len(publics), 0) = 0 THEN 'empty' WHEN len(publics) <= 1 THEN 'partial'
  ELSE 'dense' END AS publics_bucket, CASE WHEN length(trim(coalesce(precisions, ''))) > 0 THEN 'pp_filled' ELSE 'pp_empty' END AS pp_bucket,
  CASE WHEN length(coalesce(description, '')) >= 200 THEN 'desc_long' ELSE 'desc_short' END AS desc_bucket, count(*) AS n,
  count(*) / (SELECT count(*) FROM services_v) AS share FROM services_v GROUP BY 1, 2, 3""", "services_v"))
def crosstab_coverage(spark, sf):
    return profile.crosstab(
        services(spark, sf), publics_bucket=coverage_bucket("publics"),
        pp_bucket=F.when(filled("precisions"), "pp_filled").otherwise("pp_empty"),
        desc_bucket=F.when(F.coalesce(F.length("description") >= 200, F.lit(False)), "desc_long").otherwise("desc_short"))


def _strata_sql(stratum: str) -> str:
    return oracle(f"""SELECT count(*) FILTER (s = 'rich') AS rich_n, count(*) FILTER (s = 'norm_only') AS norm_only_n,
  count(*) FILTER (s = 'sparse') AS sparse_n, count(*) AS total_n FROM (SELECT {stratum} AS s FROM services_v)""", "services_v")


@query("strata_counts", _strata_sql(_STRATUM))
def strata_counts(spark, sf):
    return profile.strata_counts(services(spark, sf), ["precisions", "conditions"], "publics")


@query("strata_counts_long", _strata_sql(_STRATUM.replace("CASE WHEN", "CASE WHEN length(description) >= 200 OR", 1)))
def strata_counts_long(spark, sf):
    return profile.strata_counts(services(spark, sf), ["precisions", "conditions"], "publics", "description")


@query("size_quarantine", f"SELECT doc_id, strlen(text) <= {SMALL_BODY} AS accepted FROM documents")
def size_quarantine(spark, sf):
    return table(spark, sf, "documents").select("doc_id", within_size(F.col("text"), SMALL_BODY).alias("accepted"))


# -- sampling --------------------------------------------------------------------------------------

def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_weights(stratified(spark, sf), "source", "score")


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.nested_sample(_weights(spark, sf), "id", "stratum", "weight", SAMPLE_SIZES)


@query("sample_weights", oracle("SELECT id, source, stratum, source_count, score_boost, round(weight, 9) AS weight FROM weighted",
                                "services_v", extra=_WEIGHTED))
def sample_weights(spark, sf):
    return _weights(spark, sf).select("id", "source", "stratum", "source_count", "score_boost", F.round("weight", 9).alias("weight"))


_SEEDED = f"""picked AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH}, id) AS rank
  FROM (SELECT id, {_STRATUM} AS stratum FROM services_v)),
seeded AS (SELECT id, stratum, CAST(rank AS INTEGER) AS rank FROM picked WHERE rank <= CASE stratum {" ".join(
    f"WHEN '{s}' THEN {q}" for s, q in SEED_PICK_QUOTAS.items())} ELSE 0 END)"""


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seeded_pick(stratified(spark, sf), "id", "stratum", SEED_PICK_QUOTAS)


@query("seeded_pick", oracle("SELECT id, stratum, rank FROM seeded", "services_v", extra=_SEEDED))
def seeded_pick(spark, sf):
    return _seeded(spark, sf).select("id", "stratum", "rank")


@query("subset_by_ids", oracle("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT id FROM seeded)",
                               "services_v", extra=_SEEDED))
def subset(spark, sf):
    picks = _seeded(spark, sf).select(F.col("id").alias("doc_id"))
    return subset_by_ids(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), picks, "doc_id")


@query("weighted_sample", oracle("SELECT id, stratum FROM nested WHERE sample = 'validation'", "services_v", extra=_WEIGHTED))
def weighted_sample(spark, sf):
    return sampling.weighted_stratified_sample(_weights(spark, sf), "id", "stratum", "weight",
                                               SAMPLE_SIZES["validation"]).select("id", "stratum")


@query("nested_sample", oracle("SELECT sample, id, stratum FROM nested", "services_v", extra=_WEIGHTED))
def nested_sample(spark, sf):
    return _nested(spark, sf).select("sample", "id", "stratum")


@query("nested_sample_check", oracle("""SELECT count(*) FILTER (sample = 'discovery') AS inner_n, count(*) FILTER (sample = 'validation') AS outer_n,
  count(*) FILTER (sample = 'discovery' AND id NOT IN (SELECT id FROM nested WHERE sample = 'validation')) AS outside_n FROM nested""",
                                     "services_v", extra=_WEIGHTED))
def nested_sample_check(spark, sf):
    picks = cut(_nested(spark, sf).select("sample", "id"))
    inner, outer = picks.where("sample = 'discovery'"), picks.where("sample = 'validation'")
    outside = sampling.subset_violations(inner, outer, "id").agg(F.count(F.lit(1))).scalar()
    return picks.agg(F.count_if(F.col("sample") == "discovery").alias("inner_n"),
                     F.count_if(F.col("sample") == "validation").alias("outer_n")).withColumn("outside_n", outside)


@query("sample_manifest", oracle("""SELECT sample, stratum, source, count(*) AS source_n,
  CAST(sum(count(*)) OVER (PARTITION BY sample, stratum) AS BIGINT) AS n, any_value(p50) AS score_p50, round(any_value(mean), 6) AS score_mean
  FROM nested JOIN (SELECT sample, stratum, quantile_cont(score, 0.5) AS p50, avg(score) AS mean FROM nested GROUP BY sample, stratum)
  USING (sample, stratum) GROUP BY sample, stratum, source""", "services_v", extra=_WEIGHTED))
def sample_manifest(spark, sf):
    manifest = sampling.sampling_manifest(_nested(spark, sf), "stratum", "source", "score")
    return manifest.select("sample", "stratum", "n", "score_p50", F.round("score_mean", 6).alias("score_mean"),
                           F.explode("by_source").alias("source", "source_n"))


# -- chunks and exports ----------------------------------------------------------------------------

CHUNKS = 7
_CHUNKED = f"""chunked AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1)
  / ceil((SELECT count(*) FROM sources_v) / {CHUNKS})) + 1 AS INTEGER) AS chunk_id FROM sources_v)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(view(spark, sf, "sources_v").select("id"), CHUNKS, ["id"])


@query("chunk_assign", oracle("SELECT id, chunk_id FROM chunked", "sources_v", extra=_CHUNKED))
def chunk_assign(spark, sf):
    return _chunks(spark, sf)


@query("chunk_manifest", oracle("""SELECT 'batch-1' AS batch_id, chunk_id, count(*) AS n, (SELECT count(*) FROM chunked) AS total,
  min(id) AS first_id, max(id) AS last_id, format('inputs/batch-1/chunk_{:02d}/services.jsonl', chunk_id) AS services_uri,
  format('inputs/batch-1/chunk_{:02d}/run.json', chunk_id) AS run_uri FROM chunked GROUP BY chunk_id""", "sources_v", extra=_CHUNKED))
def chunk_manifest(spark, sf):
    return chunking.chunk_manifest(_chunks(spark, sf), "id", "batch-1")


@query("export_json_lines", oracle("""SELECT CAST(to_json({'id': id, 'source': source, 'score': score, 'publics': publics,
  'conditions': conditions}) AS VARCHAR) AS value FROM services_v""", "services_v"))
def export_json_lines(spark, sf):
    return json_rows(services(spark, sf), ["id", "source", "score", "publics", "conditions"])
