import re
from collections import Counter, defaultdict

import pytest
from edge import clashing, edge, empty, rows_of
from oracle import connect, differences

from corpusloom.llm import divergence, sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows, least, top):
    n, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in documents[lang].items() if d >= least]

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        every = p(sum((n[lang, s] for s in sources), Counter()))
        own = {s: p(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[s][t] - every[t], t) for t in kept if n[lang, s][t] and own[s][t] > every[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def found(df):
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("blocks", [(128, 2048), (3, 7), (1, 1000)])
def test_equals_plain_sums_whatever_the_blocks(spark, sf, blocks):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    least = 30 if blocks[0] > 1 else 5
    assert found(divergence.divergence(docs, least, 50, *blocks)) == plain(rows, least, 50)


def test_edges(spark):
    rows = [tuple(r) for r in edge(spark).select("lang", "source", "text").collect()]
    for least, top in ((30, 50), (2, 3), (1, 50)):
        assert found(divergence.divergence(edge(spark), least, top)) == plain(rows, least, top)
    assert found(divergence.divergence(empty(spark))) == []
    assert rows_of(divergence.divergence(clashing(spark), 2)) == rows_of(divergence.divergence(edge(spark).repartition(5), 2))


def test_whole_division_is_exact_for_counts_of_a_hundred_terabytes(spark):
    from pyspark.sql import functions as F
    cases = [(0, 0, 1), (0, 0, 0), (7, 7, 1), (9_999_999_999_999, 9_999_999_999_999, 1), (3, 9_000_000_000_000, 1_000_000_007), (123_456_789_012, 9_876_543_210_987, 77)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    for r in df.withColumn("p", divergence.smoothed(F.col("n"), F.col("total"), F.col("kept"))).collect():
        assert r.p == 1 + 10 ** 9 * (r.n + 5) // max(r.total + 5 * r.kept, 1)


def test_sql_agrees_on_a_larger_table(spark, sf):
    wide = f"{sf}/../sf0.01"
    assert differences(divergence.op13_source_divergence(spark, wide), connect(wide), sql.SOURCE_DIVERGENCE) == []
