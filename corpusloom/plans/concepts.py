"""Concept queries over the documents, with a dictionary whose patterns occur in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts
from ..operators.rules import Concept, ConflictRule
from .catalog import oracle, query, table, view

DICTIONARY = [
    Concept("contact", "email", [r"[a-z0-9._]+@[a-z0-9.]+"], stem="@"),
    Concept("contact", "phone", [r"[0-9]{3}-[0-9]{4}"]),
    Concept("legal", "licence", [r"licen[sc]e", r"license"], stem="licen"),
    Concept("legal", "never", [r"not in any text 0x"]),
    Concept("language", "german", [r"nicht", r" und "]),
    Concept("language", "french", [r" les "], stem=" les "),
    Concept("noise", "thing", [r"thing"], stem="thing"),
    Concept("noise", "shouting", [r"[#*]{3}"]),
]
# A dictionary of 121 concepts by a rule: words that hold three syllables in a row, or with a letter between.
_SYLLABLES = "th er en on ti re an in de le st".split()
MANY = [Concept("syllables", f"{a}-{b}", [f"{a}{b}{c}[a-z]", f"{b}{c}[a-z]{a}"]) for a in _SYLLABLES
        for b, c in zip(_SYLLABLES, _SYLLABLES[1:] + _SYLLABLES[:1])]
CONFLICTS = [
    ConflictRule("under_specification", "publics", "quality", "german", unless=["de"]),
    ConflictRule("contradiction", "publics", "toxic", "licence"),
    ConflictRule("under_specification", "publics", "fr", "french"),
    ConflictRule("contradiction", "publics", "es", "thing"),
]
# Wordings of the direction and role rules.
LIMIT_PRESENT = [r"\bconditions?\s+de\s+ressources?"]
LIMIT_ABSENT = [r"\bsans\s+conditions?\s+de\s+ressources?"]
CDI_STATUS = [r"\bCDI\b"]
CDI_GOAL = [r"\b(?:trouver|obtenir|signer)\s+(?:un\s+)?CDI\b"]


def _q(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


def _hits(c: Concept) -> str:
    return " + ".join(f"len(regexp_extract_all(text, {_q(p)}))" for p in c.patterns)


def _first(c: Concept, form: str) -> str:
    """First pattern that matches, in the given form."""
    return "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {form.format(p=p.replace(chr(39), chr(39) * 2), q=_q(p))}" for p in c.patterns) + " END"


_CONTEXT = ("substr(text, greatest(length(regexp_extract(text, '(?is)^(.*?)(?:{p})', 1)) - 20, 0) + 1, length(regexp_extract(text, '(?is)^(.*?)(?:{p})', 1))"
            " + length(regexp_extract(text, {q}, 0)) + 20 - greatest(length(regexp_extract(text, '(?is)^(.*?)(?:{p})', 1)) - 20, 0))").replace("{3}", "{{3}}")


def _found(extra: str, dictionary: list[Concept] = DICTIONARY) -> str:
    return "found AS (" + " UNION ALL ".join(
        f"""SELECT doc_id, source, '{c.category}' AS category, '{c.name}' AS concept, {i} AS no, {_hits(c)} AS hits{extra and ', ' + _first(c, extra)}
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) WHERE {_hits(c)} > 0""" for i, c in enumerate(dictionary)) + ")"


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "documents").select(*cols)


def _scan_sql(dictionary: list[Concept]) -> str:
    return oracle(f"""SELECT category, concept, coalesce(rows_n, 0) AS rows_n, coalesce(rows_n, 0) / (SELECT count(*) FROM documents) AS share,
   coalesce(hits_n, 0) AS hits_n, coalesce(sources_n, 0) AS sources_n, top_source, coalesce(top_source_n, 0) AS top_source_n
  FROM (VALUES {", ".join(f"('{c.category}', '{c.name}')" for c in dictionary)}) names(category, concept) LEFT JOIN
   (SELECT category, concept, CAST(sum(n) AS BIGINT) AS rows_n, CAST(sum(h) AS BIGINT) AS hits_n, count(*) AS sources_n, first(source ORDER BY n DESC, source) AS top_source, max(n) AS top_source_n
    FROM (SELECT category, concept, source, count(*) AS n, sum(hits) AS h FROM found GROUP BY ALL) GROUP BY ALL) USING (category, concept)""", extra=_found("", dictionary))


@query("concept_scan", _scan_sql(DICTIONARY))
def concept_scan(spark, sf):
    return concepts.concept_scan(documents(spark, sf, "text", "source"), ["text"], "source", DICTIONARY)


@query("concept_scan_many", _scan_sql(MANY))
def concept_scan_many(spark, sf):
    return concepts.concept_scan(documents(spark, sf, "text", "source"), ["text"], "source", MANY)


@query("concept_examples", oracle("""SELECT doc_id, category, concept, CAST(rn AS INTEGER) AS rank, left(replace(context, chr(10), ' / '), 120) AS context FROM
   (SELECT *, row_number() OVER (PARTITION BY category, concept ORDER BY doc_id) AS rn FROM found) WHERE rn <= 2""",
                                  extra=_found(_CONTEXT).replace(" END\n", " END AS context\n")))
def concept_examples(spark, sf):
    return concepts.concept_examples(documents(spark, sf, "doc_id", "text"), "doc_id", ["text"], DICTIONARY, 2)


@query("tag_concepts", oracle("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) AS INTEGER) AS pos, category, concept,
   CAST(hits AS INTEGER) AS hits, evidence FROM found""", extra=_found("regexp_extract(text, {q}, 0)").replace(" END\n", " END AS evidence\n")))
def tag_concepts(spark, sf):
    tags = concepts.tag_concepts(documents(spark, sf, "doc_id", "text"), ["text"], DICTIONARY, ["doc_id"])
    return tags.select("doc_id", (F.col("tag._no") + 1).alias("pos"), "tag.category", "tag.concept", "tag.hits", "tag.evidence")


def _conflict_sql(r: ConflictRule) -> str:
    unless = f" AND NOT list_has_any(publics, [{', '.join(repr(u) for u in r.unless)}])" if r.unless else ""
    return f"""SELECT id, '{r.kind}' AS type, '{r.field}' AS field, '{r.normalized_value}' AS normalized_value, '{r.concept}' AS concept
  FROM services_v JOIN found ON doc_id = id WHERE concept = '{r.concept}' AND list_contains(publics, '{r.normalized_value}'){unless}"""


@query("detect_conflicts", oracle(" UNION ALL ".join(map(_conflict_sql, CONFLICTS)), "services_v", extra=_found("")))
def detect_conflicts(spark, sf):
    rows = view(spark, sf, "services_v").select("id", "publics", "description")
    tagged = concepts.with_tags(rows, ["description"], DICTIONARY, ["id", "publics"])
    named = tagged.select("id", "publics", F.transform("tags", lambda t: t["concept"]).alias("concepts"))
    return concepts.detect_conflicts(named, "id", "concepts", "publics", CONFLICTS)


@query("value_tally", """SELECT lang AS value, count(*) AS n, (SELECT string_agg(ex, '|' ORDER BY doc_id) FROM
    (SELECT doc_id, text AS ex FROM documents i WHERE i.lang = d.lang ORDER BY doc_id LIMIT 3)) AS examples FROM documents d GROUP BY lang""")
def value_tally(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("ex"))
    return concepts.value_tally(rows, "lang", "ex", "doc_id", 3).withColumn("examples", F.array_join("examples", "|"))


def _age_list(patterns: list[str], less: int = 0) -> str:
    joined = [f"list_transform(regexp_extract_all(text, {_q(p)}, 1), lambda x: CAST(x AS INTEGER) - {less})" for p in patterns]
    return "list_concat(" + ", ".join(joined) + ")" if len(joined) > 1 else joined[0]


_AGES = f"""ages AS (SELECT id, list_min({_age_list(concepts.AGE_MIN)}) AS low, list_max(list_concat({_age_list(concepts.AGE_BELOW, 1)}, {_age_list(concepts.AGE_MAX)})) AS high,
  regexp_matches(text, {_q(concepts.AGE_SENTINEL_TEXT)}) AS fake FROM phrases_v)"""


@query("age_bounds", oracle("""SELECT id, CASE WHEN NOT fake AND NOT coalesce(low = 0 AND high = 120, false) THEN low END AS age_min,
  CASE WHEN NOT fake AND NOT coalesce(low = 0 AND high = 120, false) THEN high END AS age_max FROM ages""", "phrases_v", extra=_AGES))
def age_bounds(spark, sf):
    return view(spark, sf, "phrases_v").select("id", concepts.age_bounds(F.col("text")).alias("a")).select("id", "a.age_min", "a.age_max")


@query("tri_state", oracle(f"""SELECT id, CASE WHEN regexp_matches(text, {_q(LIMIT_ABSENT[0])}) THEN false WHEN regexp_matches(text, {_q(LIMIT_PRESENT[0])}) THEN true END AS resource_limit
  FROM phrases_v""", "phrases_v"))
def tri_state(spark, sf):
    return view(spark, sf, "phrases_v").select("id", concepts.tri_state(F.col("text"), LIMIT_PRESENT, LIMIT_ABSENT).alias("resource_limit"))


@query("concept_role", oracle(f"""SELECT id, CASE WHEN regexp_matches(text, {_q(CDI_GOAL[0])}) THEN 'goal' WHEN regexp_matches(text, {_q(CDI_STATUS[0])}) THEN 'status' END AS role
  FROM phrases_v""", "phrases_v"))
def concept_role(spark, sf):
    return view(spark, sf, "phrases_v").select("id", concepts.concept_role(F.col("text"), CDI_STATUS, CDI_GOAL).alias("role"))
