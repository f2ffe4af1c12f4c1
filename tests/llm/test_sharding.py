import zlib
from collections import Counter, defaultdict

from edge import clashing, empty

from corpusloom.llm import sharding


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_even_and_groups_stay_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = sharding.op7_sharding(spark, f"{sf}/../sf0.01").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and gapless(rows)
    load, where = Counter(), defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    mean = sum(load.values()) / 24
    assert set(load) == set(range(24)) and max(load.values()) < 1.05 * mean and min(load.values()) > 0.95 * mean
    assert all(len(s) == 1 for s in where.values())


def test_a_group_beyond_a_shards_share_is_split(spark):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, f"text number {i}") for i in range(600)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(out) == 1200 and gapless(out) and max(load.values()) < 1.1 * min(load.values())
    same = Counter(r.shard for r in out if r.doc_id < 1000)
    assert len(same) < 24  # gathered as far as the quotas allow


def test_a_table_of_copies_only_keeps_its_groups_whole(spark):
    rows = [(10 * g + c, f"text of group {g:05d} " + "x" * (g % 40)) for g in range(2_000) for c in range(2 + g % 2)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    load, where = Counter(), defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        where[r.doc_id // 10].add(r.shard)
    assert len(out) == len(rows) and gapless(out) and len(load) == 24
    assert all(len(s) == 1 for s in where.values())
    assert max(load.values()) < 1.03 * min(load.values())


def test_a_large_group_gathers_where_all_others_are_copies(spark):
    rows = [(i, "same text of the large group") for i in range(700)] + [(1000 + 10 * g + c, f"text of group {g:05d} of the rest") for g in range(700) for c in range(2)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    load, where = Counter(), defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        where[max(99, r.doc_id // 10)].add(r.shard)
    large = {r.shard for r in out if r.doc_id < 1000}
    assert len(out) == len(rows) and gapless(out) and len(large) < 16
    assert sum(len(s) > 1 for k, s in where.items() if k > 99) < 30 and max(load.values()) < 1.1 * min(load.values())


def test_edges(spark):
    docs = clashing(spark)
    out = sharding.sharded(docs).collect()
    assert len(out) == docs.count() and gapless(out) and all(0 <= r.shard < 24 for r in out)
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (4, 5)} == {(8, 0)}
    assert sharding.sharded(empty(spark)).count() == 0
    again = sharding.sharded(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id or -1, r.text_crc32, r.shard)
    assert sorted(map(key, again)) == sorted(map(key, out))
