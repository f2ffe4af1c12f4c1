"""Sharding by balanced label propagation: linked documents gather in one shard while sizes stay equal.

Documents are linked when their texts are equal. Every document starts in a shard chosen by a hash of its id; the
documents of a group in one shard move as a piece, so a group is at most as many rows as there are shards however many
copies it has. Groups beyond a shard's equal share come first: their pieces fill as few shards as they can. In each round
any other group wishes for the shard that already holds most of it, first among those with room for
the rest, and pieces move only to where more of their group is; wishes are granted in hash order up to the shard's
quota, the equal share less what it holds. Rounds end when
no piece moves, and a piece beyond its shard's equal share is let go again.

Where shards are full of linked documents few pieces can move. So groups that are still in several shards then leave
them and are packed whole into the room that this makes: those of at least a `LARGE`th of a share from the largest down,
each into the least room that takes it, then the others along a running sum of bytes. Of these the few that would lie
across the end of a shard go to the shard with most room, which they may fill beyond its share by less than a
`LARGE`th. Only a group for which no shard has room is split.

Documents without links, and those let go, then level the shards: from large to small size classes, each class is
dealt along a running sum of bytes into the shards' deficits, so that what one class leaves uneven the next evens out.

Running sums and slots are made of slices: a window within each slice of a hash, and one over the slices' totals. No
task sorts a whole shard. All of it is DataFrame operations; texts are read once and never shuffled.

Law `bytes`: sizes (UTF-8 bytes of the text plus 8) are near equal. Defined results: a null text is empty, with size 8 and
crc32 0; null and empty texts are equal texts. Null and repeated ids are rows like others. An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .tables import read

SHARDS = 24
LARGE = 64
SLICE_ROWS, MIN_SLICES, MAX_SLICES = 20_000, 32, 262_144
CLASS_FACTOR = 8  # sizes of a class differ by this factor at most
SEED = 71


def running(rows: DataFrame, parts: list[str], value: Column, turn: Column, slices: int, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows before, in the order of `turn` within `parts`."""
    sliced = rows.withColumn("_v", value).withColumn("_t", turn).withColumn("_slice", F.pmod("_t", F.lit(slices)))
    before = Window.partitionBy(*parts).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*parts, "_slice").agg(F.sum("_v").alias("_s"))
               .withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    inner = Window.partitionBy(*parts, "_slice").orderBy("_t", *[c for c in rows.columns if c not in parts]).rowsBetween(Window.unboundedPreceding, -1)
    return (sliced.withColumn("_b", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(offsets, [*parts, "_slice"])
            .withColumn(name, F.col("_b") + F.col("_o")).drop("_v", "_t", "_slice", "_b", "_o"))


def beyond(pieces: DataFrame, share: int, shards: int) -> list[tuple]:
    """(k1, k2, s0, label, bytes) of the pieces of groups beyond a share that find room, each group in as few shards as it can."""
    rows = pieces.collect()  # less than `shards` groups are so large, each of at most `shards` pieces
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault((r["k1"], r["k2"]), []).append(r)
    room, out = dict.fromkeys(range(shards), share), []
    for key, left in sorted(groups.items(), key=lambda g: (-sum(r["bytes"] for r in g[1]), g[0])):
        left.sort(key=lambda r: (-r["bytes"], r["s0"]))
        here = {r["s0"]: r["bytes"] for r in left}
        for label in sorted(room, key=lambda x: (-room[x], -here.get(x, 0), x)):
            for r in list(left):
                if r["bytes"] <= room[label]:
                    room[label] -= r["bytes"]
                    out.append((*key, r["s0"], label, r["bytes"]))
                    left.remove(r)
    return out


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of integers as a table."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def propagated(pieces: DataFrame, loads: dict[int, int], share: int, shards: int, slices: int) -> DataFrame:
    """`pieces` (k1, k2, s0, bytes) with `label`, the shard of each after label propagation under quotas, and `stays`,
    whether its shard has room for it beside `loads`."""
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("label", F.col("s0")))
    quota = F.element_at(F.array(*[F.lit(share - loads.get(s, 0)) for s in range(shards)]), F.col("label") + 1)
    every = spark.range(shards).select(F.col("id").cast("int").alias("label"))
    turn = F.xxhash64("k1", "k2", "s0", F.lit(SEED + 1))
    while True:  # every move adds to the sum of squares of a group's bytes by shard, so rounds end
        room = (every.join(pieces.groupBy("label").agg(F.sum("bytes").alias("load")), "label", "left")
                .select("label", (quota - F.coalesce("load", F.lit(0))).alias("room")))  # a row per shard
        held = (pieces.groupBy("k1", "k2", "label").agg(F.sum("bytes").alias("b"), F.min("bytes").alias("least"))
                .withColumn("pull", F.struct("b", F.xxhash64("k1", "k2", "label"))))
        group = Window.partitionBy("k1", "k2")  # a row per shard at most
        rest = F.sum("b").over(group) - F.col("b")
        fits = (held.withColumn("rest", rest).withColumn("least", F.min("least").over(group)).join(F.broadcast(room), "label")
                .where(F.col("room") >= F.col("least")))
        # a shard with room for all the rest goes first; a group too large for any gathers as far as quotas allow
        wish = fits.groupBy("k1", "k2").agg(F.max_by(F.struct(F.col("label").alias("target"), F.col("pull").alias("there")),
                                                     F.struct(F.col("rest") <= F.col("room"), "pull")).alias("w")).select("k1", "k2", "w.*")
        # only towards more of the group, so that no two pieces change places
        moves = (pieces.join(held.select("k1", "k2", "label", "pull"), ["k1", "k2", "label"]).join(wish, ["k1", "k2"])
                 .where((F.col("label") != F.col("target")) & (F.col("there") > F.col("pull"))).drop("pull", "there"))
        able = moves.join(F.broadcast(room.withColumnRenamed("label", "target")), "target").where("bytes <= room")
        granted = (running(able, ["target"], F.col("bytes"), turn, slices, "before")
                   .where(F.col("before") + F.col("bytes") <= F.col("room")).select("k1", "k2", "s0", "target"))
        after = cut(pieces.join(granted, ["k1", "k2", "s0"], "left")
                    .select("k1", "k2", "s0", "bytes", F.coalesce("target", "label").alias("label"), F.col("target").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        pieces = after.drop("moved")
        if not moved:
            break
    return running(pieces, ["label"], F.col("bytes"), turn, slices, "before").withColumn("stays", F.col("before") + F.col("bytes") <= quota).drop("before")


def packed(groups: DataFrame, loads: dict[int, int], share: int, shards: int, slices: int) -> DataFrame:
    """(k1, k2, label) of whole `groups` (k1, k2, bytes) in the room beside `loads`, without those that no shard has room for."""
    spark = groups.sparkSession
    groups = cut(groups)
    room = {s: max(0, share - loads.get(s, 0)) for s in range(shards)}
    out = []
    # shards hold a share each, so at most shards * LARGE groups are large
    for g in sorted(groups.where(F.col("bytes") * LARGE >= share).collect(), key=lambda g: (-g["bytes"], g["k1"], g["k2"])):
        if fits := [s for s in room if room[s] >= g["bytes"]]:
            label = min(fits, key=lambda s: (room[s], s))
            room[label] -= g["bytes"]
            out.append((g["k1"], g["k2"], label))
    ends, at = [], 0
    for s in range(shards):
        at += room[s]
        ends.append(at)
    line = F.array(*map(F.lit, ends))
    small = groups.where(F.col("bytes") * LARGE < share).withColumn("_all", F.lit(0))
    lain = cut(running(small, ["_all"], F.col("bytes"), F.xxhash64("k1", "k2", F.lit(SEED + 4)), slices, "before").select(
        "k1", "k2", "bytes", F.size(F.filter(line, lambda e: e <= F.col("before"))).alias("label"),
        F.size(F.filter(line, lambda e: e < F.col("before") + F.col("bytes"))).alias("last")))
    inside = lain.where(F.col("label") == F.col("last"))
    for r in inside.groupBy("label").agg(F.sum("bytes").alias("b")).collect():  # a row per shard
        room[r["label"]] -= r["b"]
    across = lain.where(F.col("label") != F.col("last")).collect()  # one for each end of a shard
    for g in sorted(across, key=lambda g: (-g["bytes"], g["k1"], g["k2"])):
        label = max(room, key=lambda s: (room[s], -s))
        room[label] -= g["bytes"]
        out.append((g["k1"], g["k2"], label))
    return inside.select("k1", "k2", "label").union(rows_of(spark, out, "k1 long, k2 long, label int"))


def gathered(pieces: DataFrame, share: int, shards: int, slices: int) -> DataFrame:
    """(k1, k2, s0, label): the shard of each of `pieces` (k1, k2, s0, bytes) that is not let go."""
    spark = pieces.sparkSession
    group = Window.partitionBy("k1", "k2")  # a row per shard at most
    pieces = cut(pieces.withColumn("_whole", F.sum("bytes").over(group)))
    large = beyond(pieces.where(F.col("_whole") > share).drop("_whole"), share, shards)
    loads: dict[int, int] = {}
    for *_, label, size in large:
        loads[label] = loads.get(label, 0) + size
    moved = propagated(pieces.where(F.col("_whole") <= share).drop("_whole"), loads, share, shards, slices)
    one = F.min("stays").over(group) & (F.min("label").over(group) == F.max("label").over(group))
    moved = cut(moved.withColumn("one", one).drop("stays"))
    for r in moved.where("one").groupBy("label").agg(F.sum("bytes").alias("b")).collect():  # a row per shard
        loads[r["label"]] = loads.get(r["label"], 0) + r["b"]
    apart = moved.where(~F.col("one"))
    places = packed(apart.groupBy("k1", "k2").agg(F.sum("bytes").alias("bytes")), loads, share, shards, slices)
    return (moved.where("one").select("k1", "k2", "s0", "label")
            .union(apart.select("k1", "k2", "s0").join(places, ["k1", "k2"]).select("k1", "k2", "s0", "label"))
            .union(rows_of(spark, [g[:4] for g in large], "k1 long, k2 long, s0 int, label int")))


def levelled(free: DataFrame, loads: dict[int, int], share: float, shards: int, slices: int) -> DataFrame:
    """`free` with `label`: dealt into the deficits of the shards, a size class at a time."""
    spark = free.sparkSession
    free = cut(free.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(float(CLASS_FACTOR)))).cast("int")))
    totals = {r["class"]: r["s"] for r in free.groupBy("class").agg(F.sum("size").alias("s")).collect()}  # a row per class
    done = []
    for c in sorted(totals, reverse=True):
        deficit = [max(0.0, share - loads.get(s, 0)) for s in range(shards)]
        if not sum(deficit):
            deficit = [1.0] * shards
        ends, at = [], 0.0
        for d in deficit:
            at += d
            ends.append(at / sum(deficit) * totals[c])
        own = free.where(F.col("class") == c).drop("class").withColumn("_all", F.lit(0))
        placed = running(own, ["_all"], F.col("size"), F.xxhash64("doc_id", "k1", F.lit(SEED + 2)), slices, "before").drop("_all")
        middle = F.col("before") + F.col("size") / 2
        label = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle)))
        placed = cut(placed.withColumn("label", label.cast("int")).drop("before"))
        for r in placed.groupBy("label").agg(F.sum("size").alias("s")).collect():  # a row per shard
            loads[r["label"]] = loads.get(r["label"], 0) + r["s"]
        done.append(placed)
    out = done[0] if done else spark.createDataFrame([], free.drop("class").withColumn("label", F.lit(0)).schema)
    for d in done[1:]:
        out = out.union(d)
    return out


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of `documents`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(SEED), text).alias("k2"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(shards)).cast("int").alias("s0")))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slices = min(MAX_SLICES, max(MIN_SLICES, -(-rows // SLICE_ROWS)))
    share = -(-total // shards)
    pieces = base.groupBy("k1", "k2", "s0").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    linked = pieces.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("k1", "k2")
    kept = cut(gathered(pieces.join(linked, ["k1", "k2"], "left_semi").drop("n"), share, shards, slices))
    joined = cut(base.join(kept, ["k1", "k2", "s0"], "left").drop("s0"))
    fixed = joined.where(F.col("label").isNotNull())
    loads = {r["label"]: r["s"] for r in fixed.groupBy("label").agg(F.sum("size").alias("s")).collect()}  # a row per shard
    free = levelled(joined.where(F.col("label").isNull()).drop("label"), loads, total / shards, shards, slices)
    both = fixed.select("doc_id", "size", "text_crc32", "k1", "label").union(free.select("doc_id", "size", "text_crc32", "k1", "label"))
    return (running(both, ["label"], F.lit(1), F.xxhash64("doc_id", "k1", F.lit(SEED + 3)), slices, "slot")
            .select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.col("slot").cast("long").alias("slot")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
