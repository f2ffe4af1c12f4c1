"""Concept scan over free text: hits, tags, evidence, age bounds, direction and role, conflicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import FactorIndex, fold, folds
from ..functions.text import any_of, ignore_case, joined_text
from .compute import once
from .ordering import top_k_per_group
from .profile import row_total
from .rules import Concept, ConflictRule, literal_rows


def _found(text: Column, patterns: Sequence[str]) -> Column:
    return any_of([text.rlike(ignore_case(p)) for p in patterns])


def hit_count(text: Column, concept: Concept, lowered: Column | None = None, index: FactorIndex | None = None,
              present: Column | None = None) -> Column:
    """Non-overlapping matches summed over the patterns, so overlapping patterns add up. With an index, a pattern
    runs only where one of its literal factors is present. `lowered` is the folded text: patterns of plain characters
    run on it with their case, which takes a fraction of the time."""
    def count(p: str) -> Column:
        hits = F.regexp_count(lowered, F.lit(p)) if lowered is not None and folds(p) else F.regexp_count(text, F.lit(ignore_case(p)))
        may = index.may_match(present, [p]) if index else None
        return hits if may is None else F.when(may, hits).otherwise(F.lit(0))

    hits = reduce(lambda a, b: a + b, map(count, concept.patterns))
    if concept.stem and lowered is not None:
        return F.when(lowered.contains(concept.stem), hits).otherwise(F.lit(0))
    return hits


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Text of the first match of the first pattern that matches."""
    found = [F.when(text.rlike(ignore_case(p)), F.regexp_extract(text, ignore_case(p), 0)) for p in patterns]
    return F.coalesce(*found)


def match_context(text: Column, patterns: Sequence[str], around: int = 20, limit: int = 120) -> Column:
    """First match with `around` characters on both sides, line breaks shown as ` / `."""
    def one(p: str) -> Column:
        # group 1 is everything ahead of the first match, counted in characters
        lead = F.length(F.regexp_extract(text, rf"(?iU)^([\s\S]*?)(?:{p})", 1))
        size = F.length(F.regexp_extract(text, ignore_case(p), 0))
        start = F.greatest(lead - around, F.lit(0))
        return F.when(text.rlike(ignore_case(p)), F.substring(text, start + 1, lead + size + around - start))
    return F.left(F.replace(F.coalesce(*[one(p) for p in patterns]), F.lit("\n"), F.lit(" / ")), F.lit(limit))


def _index(dictionary: Sequence[Concept]) -> FactorIndex:
    return FactorIndex([p for c in dictionary for p in c.patterns])


def _tags(text: Column, dictionary: Sequence[Concept], lowered: Column, index: FactorIndex, present: Column) -> Column:
    rows = [F.struct(F.lit(c.category).alias("category"), F.lit(c.name).alias("concept"),
                     hit_count(text, c, lowered, index, present).alias("hits")) for c in dictionary]
    return F.filter(F.array(*rows), lambda t: t["hits"] > 0)


def with_text(df: DataFrame, text_cols: Sequence[str], keep: Sequence[str], index: FactorIndex) -> DataFrame:
    """`keep` plus one newline-joined text column, its folded form and the literal factors in it."""
    columns = list(dict.fromkeys([*keep, *text_cols]))
    texts = df.select(*columns).select(*keep, joined_text(text_cols, "\n").alias("_text"))
    return once(once(texts, _lower=fold(F.col("_text"))), _present=index.present(F.col("_lower")))


def with_tags(df: DataFrame, text_cols: Sequence[str], dictionary: Sequence[Concept],
              keep: Sequence[str]) -> DataFrame:
    """`keep`, the joined `_text` and `tags`, the (category, concept, hits) found in each row, possibly none."""
    index = _index(dictionary)
    texts = with_text(df, text_cols, keep, index)
    return once(texts, tags=_tags(F.col("_text"), dictionary, F.col("_lower"), index, F.col("_present"))).drop("_lower", "_present")


def tag_concepts(df: DataFrame, text_cols: Sequence[str], dictionary: Sequence[Concept],
                 keep: Sequence[str]) -> DataFrame:
    """One row per table row and concept it mentions: `tag` is (_no, category, concept, hits, evidence)."""
    tagged = with_tags(df, text_cols, dictionary, keep)
    evidence = reduce(
        lambda rest, c: F.when((F.col("_tag")["category"] == c.category) & (F.col("_tag")["concept"] == c.name),
                               first_match(F.col("_text"), c.patterns)).otherwise(rest),
        dictionary, F.lit(None).cast("string"))
    # evidence is looked up for the concepts that hit, not for the whole dictionary
    rows = tagged.select(*keep, "_text", F.posexplode("tags").alias("_no", "_tag")).withColumn("_ev", evidence)
    item = F.struct("_no", F.col("_tag")["category"].alias("category"), F.col("_tag")["concept"].alias("concept"),
                    F.col("_tag")["hits"].alias("hits"), F.col("_ev").alias("evidence"))
    return rows.select(*keep, item.alias("tag"))


def concept_hits(df: DataFrame, text_cols: Sequence[str], dictionary: Sequence[Concept],
                 keep: Sequence[str]) -> DataFrame:
    """Long form: one row per table row and concept with hits > 0."""
    return with_tags(df, text_cols, dictionary, keep).select(*keep, F.inline("tags"))


def concept_scan(df: DataFrame, text_cols: Sequence[str], source: str, dictionary: Sequence[Concept]) -> DataFrame:
    """Per concept, zero counts included: rows, share, hits, distinct sources, most frequent source.

    Counts are reduced per (concept, source) first, so the last step sees one row per source.
    """
    hits = concept_hits(df.withColumn("_source", F.col(source)), text_cols, dictionary, ["_source"])
    per_source = hits.groupBy("category", "concept", "_source").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("hits").alias("_hits"))
    label = F.coalesce(F.col("_source").cast("string"), F.lit("null"))
    per_concept = per_source.groupBy("category", "concept").agg(
        F.sum("_rows").alias("rows_n"), F.sum("_hits").alias("hits_n"), F.count(F.lit(1)).alias("sources_n"),
        F.min(F.struct((-F.col("_rows")).alias("neg"), label.alias("source"))).alias("_top"))
    names = literal_rows(df.sparkSession, ["category", "concept"], [(c.category, c.name) for c in dictionary])
    total = row_total(df).scalar()
    return (names.join(per_concept, ["category", "concept"], "left")
                 .select("category", "concept",
                         F.coalesce("rows_n", F.lit(0)).alias("rows_n"),
                         F.try_divide(F.coalesce("rows_n", F.lit(0)), total).alias("share"),
                         F.coalesce("hits_n", F.lit(0)).alias("hits_n"),
                         F.coalesce("sources_n", F.lit(0)).alias("sources_n"),
                         F.col("_top.source").alias("top_source"),
                         F.coalesce(-F.col("_top.neg"), F.lit(0)).alias("top_source_n")))


def concept_examples(df: DataFrame, id_col: str, text_cols: Sequence[str], dictionary: Sequence[Concept],
                     k: int = 2) -> DataFrame:
    """Up to `k` contexts per concept, lowest ids first. Only ids and short contexts are ranked."""
    index = _index(dictionary)
    texts = with_text(df, text_cols, [id_col], index)
    text, lowered = F.col("_text"), F.col("_lower")
    rows = [F.when(hit_count(text, c, lowered, index, F.col("_present")) > 0,
                   F.struct(F.lit(c.category).alias("category"), F.lit(c.name).alias("concept"),
                            match_context(text, c.patterns).alias("context"))) for c in dictionary]
    found = once(texts, _found=F.array_compact(F.array(*rows))).select(id_col, F.inline("_found"))
    return top_k_per_group(found, ["category", "concept"], [id_col], k)


def value_tally(df: DataFrame, value: str, example: str, order: str, k: int = 3) -> DataFrame:
    """Frequency of each value with up to `k` literal examples, the first in `order`."""
    rows = df.select(F.col(value).alias("value"), F.col(example).alias("example"), F.col(order).alias("_ord"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    picked = top_k_per_group(rows, ["value"], ["_ord"], k)
    examples = picked.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("_ex"))
    joined = counts.join(examples, counts["value"].eqNullSafe(examples["value"]), "inner")
    return joined.select(counts["value"], "n", F.transform("_ex", lambda x: x["example"]).alias("examples"))


# -- text rules ------------------------------------------------------------------------------------

# Wordings of an age limit. Group 1 is the age.
AGE_BELOW = [r"\bmoins\s*de\s*([0-9]{1,3})\s*ans"]
AGE_MAX = [r"\bjusqu['’]?\s*[àa]\s*([0-9]{1,3})\s*ans", r"\b([0-9]{1,3})\s*ans\s*(?:inclus|max\b|maximum)",
           r"\b[0-9]{1,3}\s*(?:-|–|à|a)\s*([0-9]{1,3})\s*ans", r"\b(?:limite|maximum)\s*(?:de\s*)?([0-9]{1,3})\s*ans"]
AGE_MIN = [r"\b([0-9]{1,3})\s*ans\s*(?:et\s*\+|et\s*plus|minimum|ou\s*plus)", r"[àa]\s*partir\s*de\s*([0-9]{1,3})\s*ans",
           r"\bplus\s*de\s*([0-9]{1,3})\s*ans", r"\+\s*([0-9]{1,3})\s*ans", r"\b([0-9]{1,3})\s*(?:-|–|à|a)\s*[0-9]{1,3}\s*ans"]
AGE_ANY = r"[0-9]\s*ans"  # part of every wording above
AGE_SENTINEL = (0, 120)
AGE_SENTINEL_TEXT = r"[âa]ge\s+minimum\s*:\s*0\s+[âa]ge\s+maximum\s*:\s*120"


def _ages(text: Column, patterns: Sequence[str]) -> Column:
    found = [F.regexp_extract_all(text, F.lit(ignore_case(p)), F.lit(1)) for p in patterns]
    return F.transform(F.concat(*found), lambda x: x.cast("int"))


def age_bounds(text: Column) -> Column:
    """struct(age_min, age_max). "Less than N" is N - 1; several mentions give the widest range; the
    0..120 placeholder means no bound. Each wording is searched once, and only in texts that mention an age."""
    found = F.when(text.rlike(ignore_case(AGE_ANY)), F.struct(
        F.array_min(_ages(text, AGE_MIN)).alias("low"),
        F.array_max(F.concat(F.transform(_ages(text, AGE_BELOW), lambda x: x - 1), _ages(text, AGE_MAX))).alias("high"),
        text.rlike(ignore_case(AGE_SENTINEL_TEXT)).alias("placeholder")))

    def bounds(a: Column) -> Column:
        none = a["placeholder"] | F.coalesce((a["low"] == AGE_SENTINEL[0]) & (a["high"] == AGE_SENTINEL[1]), F.lit(False))
        return F.struct(F.when(~none, a["low"]).alias("age_min"), F.when(~none, a["high"]).alias("age_max"))

    # a lambda binds what was found, where a plain reuse would search again for every mention of it
    return F.get(F.transform(F.array(found), bounds), F.lit(0))


def tri_state(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """False where the negated wording occurs, else true where the positive one does, else null."""
    return F.when(_found(text, negative), F.lit(False)).when(_found(text, positive), F.lit(True))


def concept_role(text: Column, status: Sequence[str], goal: Sequence[str]) -> Column:
    """`goal` where the concept follows a goal verb, else `status` where it is mentioned, else null."""
    return F.when(_found(text, goal), "goal").when(_found(text, status), "status")


def detect_conflicts(tagged: DataFrame, id_col: str, concepts: str, normalised: str,
                     rules: Sequence[ConflictRule]) -> DataFrame:
    """One row per rule a row breaks: its concept is among `concepts` while the too broad or opposite
    value is among `normalised`. Rules are constants, so this is a projection without a join."""
    tags, values = F.coalesce(F.col(concepts), F.array()), F.coalesce(F.col(normalised), F.array())

    def broken(r: ConflictRule) -> Column:
        hit = F.array_contains(tags, r.concept) & F.array_contains(values, r.normalized_value)
        if r.unless:
            hit = hit & ~F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(u) for u in r.unless])), F.lit(False))
        return F.when(hit, F.struct(F.lit(r.kind).alias("type"), F.lit(r.field).alias("field"),
                                    F.lit(r.normalized_value).alias("normalized_value"),
                                    F.lit(r.concept).alias("concept")))

    found = once(tagged, _found=F.array_compact(F.array(*[broken(r) for r in rules])))
    return found.select(id_col, F.inline("_found"))
