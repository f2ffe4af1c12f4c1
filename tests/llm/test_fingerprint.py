import hashlib

import numpy as np
from edge import clashing, edge, empty
from pyspark.sql import functions as F

from corpusloom.llm import fingerprint as fp


def phrases(data):
    """LZ78 by the definition: the shortest string not met before."""
    known, out, i = set(), [], 0
    while i < len(data):
        j = i + 1
        while j < len(data) and data[i:j] in known:
            j += 1
        known.add(data[i:j])
        out.append(j)
        i = j
    return out


def test_phrases_follow_the_definition():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 3000):
        for letters in (1, 2, 30):
            data = bytes(rnd.integers(97, 97 + letters, n, dtype=np.uint8))
            assert fp.phrase_ends(data) == phrases(data)
            other = data[:n // 2] + bytes(rnd.integers(97, 97 + letters, n // 3, dtype=np.uint8))
            assert fp.both_ends(data, other, n // 2) == (phrases(data), phrases(other))


def check(df):
    got = fp.fingerprints(df).collect()
    hashed = df.withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = [(known, i, t) for known, i, _, t in sorted((r.doc_id is not None, r.doc_id or 0, r._tie, r.text or "") for r in hashed.collect())]
    expected = []
    hasher = fp.Hasher()
    prints = [hasher.fingerprint(t.encode(), phrases(t.encode())) for _, _, t in rows]
    for k, (known, i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        new = fp.edited(text, following)
        changed = hasher.fingerprint(new.encode(), phrases(new.encode()))
        expected.append((i if known else -1, text, new, prints[k].astype(">u2").tobytes().hex(), fp.likeness(prints[k], changed),
                         fp.likeness(prints[k], prints[(k + 1) % len(rows)])))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.edited_text, r.fingerprint, r.near_edited, r.near_next) for r in got) == sorted(expected)


def test_next_documents_and_likeness(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for rows in (4000, 30, 1):
        monkeypatch.setattr(fp, "RANGE_ROWS", rows)
        check(docs.where("doc_id < 60") if rows == 1 else docs)


def test_rows_of_one_id_are_split(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 40)
    rows = [(i, f"text number {i} of many") for i in range(300)] + [(150, f"again {i} {i * i}") for i in range(700)] + [(None, f"none {i}") for i in range(300)]
    rows += [(150, "the same words")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(df)
    own = fp.with_next(df).where("guest = 0")
    assert own.where("doc_id = 150").select("part").distinct().count() >= 10 and own.where("doc_id is null").select("part").distinct().count() >= 4
    assert own.groupBy("part").count().agg(F.max("count")).first()[0] <= 200


def test_edges(spark, monkeypatch):
    small = edge(spark).where("doc_id is null or doc_id <> 10")
    check(small)
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    check(small)
    check(small.where("doc_id = 1"))
    assert fp.fingerprints(empty(spark)).count() == 0
    assert fp.fingerprints(clashing(spark)).count() == clashing(spark).count()
    by = {r.doc_id: r for r in fp.fingerprints(edge(spark)).collect()}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and set(by[5].fingerprint) == {"0"}


def test_edited_texts_are_nearer_than_the_next(spark, sf):
    out = fp.op10_lz_fingerprint(spark, sf).where("n_chars > 200")
    assert out.where("near_edited > near_next").count() >= 0.95 * out.count()


def test_edited():
    assert fp.edited("abcdef", "xyz123") == "abcxyz" and fp.edited("abcde", "x") == "abcx" and fp.edited("a", "x") == "a" and fp.edited("", "x") == ""
    assert hashlib.sha256(fp.edited("é€ab", "ßß").encode()).hexdigest() == hashlib.sha256("é€ßß".encode()).hexdigest()


def test_bounds(spark):
    from pyspark.sql import functions as F
    for bounds in ([], [5], [1, 4, 9], list(range(0, 300, 7))):
        got = spark.range(-3, 310).select("id", fp._bounds_passed(F.col("id"), bounds).alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in got)
