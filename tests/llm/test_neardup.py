import random

import numpy as np
import pytest
from edge import clashing, edge, empty, words

from corpusloom.llm import neardup


def plain(rows, width, percent):
    """Component of each id by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.fixture(scope="module")
def drifting():
    """Random texts, exact copies, and a chain in which every text differs a little from the one before."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, text = [], [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(160):
        text = list(text)
        for _ in range(rnd.choice((0, 1, 2, 5))):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(text)))
    rows += [(500 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60)))) for i in range(60)]
    rows += [(700 + i, rows[i % 7][1].upper()) for i in range(60)]
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [1024, 16])
def test_components_equal_those_of_all_pairs(spark, drifting, width, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = spark.createDataFrame(drifting, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width, percent).collect()}
    assert got == plain(drifting, width, percent)


def test_cores_of_pivots():
    kind = lambda mask, n: {"mask": mask, "n": n}
    assert neardup.core_of([kind(0b11, 2), kind(0b110, 1), kind(0b1000, 4), kind(0, 9)]) == 0b1000
    assert neardup.core_of([kind(0b11, 2), kind(0b110, 3), kind(0b1000, 4)]) == 0b111
    assert neardup.core_of([kind(0, 5)]) == 0


def test_a_large_group_with_far_members(spark, monkeypatch):
    """Near copies of one text, a chain that drifts away from it, and a second family that shares some of its buckets."""
    monkeypatch.setattr(neardup, "BLOCK", 12)
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rnd.choice(vocabulary) for _ in range(150)]

    def near(text, edits):
        out = list(text)
        for _ in range(edits):
            out[rnd.randrange(len(out))] = rnd.choice(vocabulary)
        return out

    texts = [near(base, 2) for _ in range(150)]
    drifting = base
    for _ in range(40):
        drifting = near(drifting, 4)
        texts.append(drifting)
    other = near(base, 16)
    texts += [near(other, 3) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain(rows, 3, 85)


def test_table_equals_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == plain([(r.doc_id, r.text) for r in df.collect()], 3, 85)


def test_edges(spark):
    docs = clashing(spark)
    out = neardup.near_duplicates(docs, 3, 85).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert (by[2].component_id, by[2].kept, by[3].component_id) == (1, False, 1)
    assert all((by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True) for i in (4, 5, 6))
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert neardup.near_duplicates(empty(spark), 3, 85).count() == 0
    assert neardup.near_duplicates(edge(spark), 3, 85).count() == docs.count()


def test_an_id_of_several_texts_joins_their_groups(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(rnd.choice("abcdefghijklm") * rnd.randint(1, 5) + str(rnd.randint(0, 99)) for _ in range(40)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (7, ""), (8, c), (9, c), (9, None), (11, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == sorted(
        (i, c, i == c) for i, c in [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (7, 3), (8, 8), (9, 8), (9, 8), (11, 11)])


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2 ** 32, (2, 64), dtype=np.uint32)
    joint = neardup.registers(np.minimum(a, b))
    assert (joint == neardup.merged(neardup.registers(a), neardup.registers(b))).all()
    # sets of 1,000 with 600 in common: similarity 600 / 1,400
    x = rnd.integers(0, 2 ** 32, 1400, dtype=np.uint32)
    odd, salt = rnd.integers(0, 2 ** 32, (2, 1024), dtype=np.uint32)
    minima = lambda s: neardup.registers(((s[:, None] ^ salt) * (odd | np.uint32(1))).min(0))
    got = neardup.jaccard_estimate(minima(x[:1000])[None], minima(x[400:])[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(got - 600 / 1400) < 0.06
