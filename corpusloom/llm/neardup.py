"""Near-duplicates by SetSketch registers: band, estimate jointly by likelihood, verify on full shingle sets.

A document's set is its distinct word shingles. Register i of its sketch is floor(1 - log_B x_i), where x_i is the
least of the set's exponentially distributed hash values, cut to 0..LIMIT: exponentially spaced truncated minima.
The sketch of a union is the register-wise maximum, and two sketches agree in a register with a probability
close to the Jaccard similarity.

1. One pass over the texts: set size, a 128-bit digest of the set, registers. Written to the shared folder; texts
   are not kept.
2. Documents with equal sets are one class, gathered by a partial aggregate, so a huge group of copies is one row.
3. Bands of `ROWS` registers: the classes of a bucket are compared register by register inside a task, in tiles of
   blocks of about `BLOCK`. Only a spanning forest of the plausible pairs leaves the task, at most a row for
   each member, so no task and no join emits the pairs of a group. Its components are clusters: both ends of
   every link are in one.
4. Whole texts of the clusters, one for each class, meet by cluster, again in tiles of blocks, bounded in rows and bytes. Pairs that the
   registers don't rule out are estimated by likelihood from `FINE` registers, and from the likeliest down every
   pair that is not connected yet is verified on the full shingle sets. A spanning forest of the links leaves.
   In both steps, members of a group of several blocks are held against a few pivots first (`forest_of`): those
   that the pivots connect need not meet each other, only the rest meets all.
5. Connected components of the links, brought back to all rows by the digests; components that share an id are one.

A pair is ruled out only `FLOOR_SIGMAS` standard errors under the threshold.
With 20 bands of 4 a pair at 0.85 shares a bucket with probability 1 - (1 - 0.85^4)^20 = 0.9999996, at 0.8 0.99997.

Defined results: null and empty texts and texts without words have no set, link with nothing and are kept. A null
doc_id links with nothing, its component is null and it is kept. Rows that repeat a doc_id are one vertex, whatever
their texts: what one of them reaches, all reach. `without_copies` takes rows, not ids, as vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .arrow_text import Words, mix, random_u64, runs, shingles, text_bytes
from .tables import bounded_batches, components, read

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BASE, LIMIT = 1.001, 65_534  # spacing of register values and the largest one
RATE = 20.0
FINE, BLOCK, BLOCK_BYTES = 1_024, 1_024, 8 << 20
PIVOTS = 8  # of a group of more than a block
FLOOR_SIGMAS = 6.0  # an estimate so many standard errors under the threshold ends a pair

_U64, _U32 = np.uint64, np.uint32


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of 32-bit hash minima, by the exponential value that each minimum stands for."""
    x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows a and b of sets with n_a and n_b members."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))[:, None]

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1 - 1e-9)

    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    even = np.clip(1 - up - down, 1e-9, 1)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(even)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def told_apart(documents: DataFrame) -> DataFrame:
    """(doc_id, text, t, u): rows of one id are told apart by two hashes of their text."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("t"), F.xxhash64(F.lit("u"), "text").alias("u"))


def sketches(documents: DataFrame, width: int, lower: bool = True) -> DataFrame:
    """(doc_id, t, u, n_shingles, d1, d2, regs, bands) of every row; t and u are 64-bit hashes of the text, d1 and d2 of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(17, lower)
        salt, odd = random_u64(REGISTERS, 23).astype(np.uint32), random_u64(REGISTERS, 29).astype(np.uint32) | _U32(1)
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            n = len(offsets) - 1
            size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima = np.full((n, REGISTERS), 0xFFFFFFFF, np.uint32)
            for i, j in runs(offsets, 1 << 18):
                _, _, hashes, word_at = words.of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                found, at = shingles(hashes, word_at, width)
                with np.errstate(over="ignore"):
                    for d in range(i, j):
                        own = np.unique(found[at[d - i]:at[d - i + 1]])
                        size[d] = len(own)
                        if len(own):
                            d1[d], d2[d] = mix(own ^ _U64(0x5851F42D4C957F2D)).sum(), mix(own + _U64(0x14057B7EF767814F)).sum()
                    small = (found >> _U64(20)).astype(np.uint32)
                    full = np.flatnonzero(np.diff(at))
                    for k in range(REGISTERS) if len(full) else ():
                        minima[i + full, k] = np.minimum.reduceat((small ^ salt[k]) * odd[k], at[:-1][full])
            regs = registers(minima)
            with np.errstate(over="ignore"):
                bands = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + regs[:, r::ROWS].astype(np.uint64) + _U64(1))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].cast(pa.int64()), batch["t"], batch["u"], pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel())),
            ], names=["doc_id", "t", "u", "n_shingles", "d1", "d2", "regs", "bands"])

    return told_apart(documents).mapInArrow(run, "doc_id long, t long, u long, n_shingles long, d1 long, d2 long, regs binary, bands array<long>")


def floor_of(percent: int, registers: int) -> float:
    """The least estimate that doesn't rule out the threshold."""
    t = percent / 100
    return t - FLOOR_SIGMAS * (t * (1 - t) / registers) ** 0.5


def close(left: np.ndarray, right: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (members of left, members of right) that set sizes and registers don't rule out, some rows of left at a time."""
    least = floor_of(percent, regs.shape[1]) * regs.shape[1]
    for lo in range(0, len(left), 128):
        i = left[lo:lo + 128]
        ok = 100 * np.minimum(n[i][:, None], n[right]) >= percent * np.maximum(n[i][:, None], n[right])
        ok &= i[:, None] < right if left is right else True
        if not ok.any():
            continue
        same = np.zeros(ok.shape, np.uint8)
        for k in range(regs.shape[1]):
            same += regs[i, k][:, None] == regs[right, k]
        p, q = np.nonzero(ok & (same >= least))
        yield i[p], right[q]


class Forest:
    """Joins members into trees."""

    def __init__(self, ids: list[int]):
        self.up, self.ids = list(range(len(ids))), ids

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        """The root of a tree is its member of the smallest id, so that every tile that finds a tree names it alike."""
        x, y = self.root(x), self.root(y)
        low, high = (x, y) if self.ids[x] <= self.ids[y] else (y, x)
        self.up[high] = low

    def edges(self) -> list[tuple[int, int]]:
        """(root, member) of every member that is not a root."""
        roots = [self.root(k) for k in range(len(self.up))]
        return [(self.ids[r], self.ids[k]) for k, r in enumerate(roots) if r != k]


def blocked(column: str, seed: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.col(blocks)).cast("int")


def all_blocks(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


EVERY, LEFT, RIGHT = 0, 1, 2  # sides of a tile: all members meet each other, or those of the left meet those of the right


def sides(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Members of a tile to compare with each other."""
    side = np.array([r["side"] for r in rows])
    if side[0] == EVERY:
        every = np.arange(len(rows))
        return every, every
    return np.flatnonzero(side == LEFT), np.flatnonzero(side == RIGHT)


def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def core_of(kinds: list) -> int:
    """The pivots, as bits, of the largest tree that the members' masks make of a group's pivots."""
    forest = Forest(list(range(PIVOTS)))
    for k in kinds:
        bits = [b for b in range(PIVOTS) if k["mask"] >> b & 1]
        for b in bits[1:]:
            forest.join(bits[0], b)
    held = [0] * PIVOTS
    for k in kinds:
        if k["mask"]:
            held[forest.root((k["mask"] & -k["mask"]).bit_length() - 1)] += k["n"]
    top = max(range(PIVOTS), key=lambda b: held[b])
    return sum(1 << b for b in range(PIVOTS) if held[top] and forest.root(b) == top)


def forest_of(members: Callable[[DataFrame], DataFrame], sizes: DataFrame, keys: list[str], columns: list[str], weight: Column,
              meets: Callable[[list[dict], list[dict]], np.ndarray], tile: Callable[[list[dict], np.ndarray, np.ndarray], Forest]) -> DataFrame:
    """(a, b): a spanning forest of the pairs that meet, in each group of `members(sizes)` (keys, id, columns, blocks).

    A group of one block is one tile. In a larger one, `PIVOTS` members are chosen by hash and every member is held against
    them, in salted parts, each of which gets a copy of the pivots. The largest tree of pivots with its members is
    the core; two members of it need not meet, as they are connected. The rest meets all members of the group, in tiles
    of blocks. So the rows that are shuffled grow with n, and with n²/`BLOCK` only by the share of the rest."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in groups(batches, [*keys, "x", "y"]):
            found += tile(rows, *sides(rows)).edges()
            if len(found) > 10_000:
                yield edges_of(found)
                found = []
        yield edges_of(found)

    def within(dealt: DataFrame) -> DataFrame:
        at = [*keys, "x", "y"]
        rows = dealt.select(*at, "side", "id", *columns).repartition(*at).sortWithinPartitions(*at)
        return rows.mapInArrow(tiles, "a long, b long").where("a <> b").distinct()

    alone = within(members(sizes.where("blocks = 1")).withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(EVERY)}))
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return alone
    hot = cut(members(large))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, [*keys, "x"]):
            pivots, own = [r for r in rows if r["pivot"] < PIVOTS], [r for r in rows if r["pivot"] == PIVOTS]
            met = meets(pivots, own)
            out = [{**{k: r[k] for k in keys}, "id": r["id"], "mask": sum(1 << pivots[j]["pivot"] for j in np.flatnonzero(m))} for r, m in zip(own, met)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    types = dict(hot.dtypes)
    schema = pa.schema([*((k, pa.int64() if types[k] == "bigint" else pa.int32()) for k in keys), ("id", pa.int64()), ("mask", pa.int32())])
    pivots = cut(hot.withColumn("pivots", F.lit(PIVOTS)).groupBy(*keys, blocked("id", "pivot", "pivots").alias("pivot")).agg(F.min("id").alias("id")))
    parts = hot.select(*keys, "id", *columns, blocked("id", "part", "blocks").alias("x"), F.lit(PIVOTS).alias("pivot")).unionByName(
        hot.join(pivots, [*keys, "id"]).select(*keys, "id", *columns, all_blocks("blocks").alias("x"), "pivot"))
    parts = parts.repartition(*keys, "x").sortWithinPartitions(*keys, "x", "pivot", "id")
    masks = cut(parts.mapInArrow(masked, ", ".join([*(f"{k} {types[k]}" for k in keys), "id long", "mask int"])))
    kinds = masks.groupBy(*keys, "mask").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("mask", "n")).alias("kinds"))
    core = kinds.select(*keys, F.udf(core_of, "int", useArrow=False)("kinds").alias("core")).join(pivots, keys)
    # the core hangs under its pivot of the smallest id, so that most groups that find a tree name it alike
    core = core.groupBy(*keys, "core").agg(F.min(F.when(F.col("core").bitwiseAND(F.expr("shiftleft(1, pivot)")) != 0, F.col("id"))).alias("a"))
    placed = masks.join(cut(core), keys)
    inside = F.col("mask").bitwiseAND(F.col("core")) != 0
    found = alone.unionByName(placed.where(inside & (F.col("a") != F.col("id"))).select("a", F.col("id").alias("b")))
    rest = placed.where(~inside).select(*keys, "id")
    rest = cut(hot.join(rest, [*keys, "id"], "left_semi"))
    if rest.isEmpty():
        return found
    few = rest.groupBy(*keys).agg(weight.cast("long").alias("rest_blocks"))
    left = rest.join(few, keys).withColumns({"x": blocked("id", "rest", "rest_blocks"), "side": F.lit(LEFT)}).withColumn("y", all_blocks("blocks"))
    right = hot.join(few, keys).withColumns({"y": blocked("id", "part", "blocks"), "side": F.lit(RIGHT)}).withColumn("x", all_blocks("rest_blocks"))
    return found.unionByName(within(left.unionByName(right)))


def plausible(members: Callable[[DataFrame], DataFrame], sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the plausible pairs of each bucket of `members` (band, key, id, n_shingles, regs, blocks)."""
    def arrays(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["n_shingles"] for r in rows], np.int64), np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(len(rows), -1)

    def meets(pivots: list[dict], rows: list[dict]) -> np.ndarray:
        n, regs = arrays([*pivots, *rows])
        out = np.zeros((len(rows), len(pivots)), bool)
        for p, q in close(np.arange(len(pivots)), np.arange(len(pivots), len(n)), n, regs, percent):
            out[q - len(pivots), p] = True
        return out

    def tile(rows: list[dict], left: np.ndarray, right: np.ndarray) -> Forest:
        n, regs = arrays(rows)
        forest = Forest([r["id"] for r in rows])
        for p, q in close(left, right, n, regs, percent):
            label = np.array([forest.root(k) for k in range(len(rows))])
            apart = label[p] != label[q]  # most pairs of a tight group are connected after the first rows
            for i, j in zip(p[apart].tolist(), q[apart].tolist()):
                forest.join(i, j)
        return forest

    return forest_of(members, sizes, ["band", "key"], ["n_shingles", "regs"], F.ceil(F.count("*") / BLOCK), meets, tile)


def linked(texts: DataFrame, sizes: DataFrame, width: int, percent: int, lower: bool) -> DataFrame:
    """(a, b): a spanning forest of the links of each component of `texts` (component, id, text)."""
    fine_floor = floor_of(percent, FINE)
    salt, odd = random_u64(FINE, 37).astype(np.uint32), random_u64(FINE, 43).astype(np.uint32) | _U32(1)

    def sets_of(rows: list[dict]) -> list[np.ndarray]:
        words, sets = Words(17, lower), []
        for r in rows:
            data, offsets = text_bytes(pa.array([r.pop("text")], pa.string()))
            _, _, hashes, at = words.of(data, offsets)
            sets.append(np.unique(shingles(hashes, at, width)[0]))
        return sets

    def minhashes(own: np.ndarray, k: int) -> np.ndarray:
        small, out = (own >> _U64(20)).astype(np.uint32), np.full(k, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(small), 256):  # a part of the set at a time
            out = np.minimum(out, ((small[s:s + 256, None] ^ salt[:k]) * odd[:k]).min(0))
        return registers(out)

    def link(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)

    def meets(pivots: list[dict], rows: list[dict]) -> np.ndarray:
        at, own = sets_of(pivots), sets_of(rows)
        return np.array([[link(a, b) for a in at] for b in own], bool).reshape(len(own), len(at))

    def tile(rows: list[dict], left: np.ndarray, right: np.ndarray) -> Forest:
        sets = sets_of(rows)
        n = np.array([len(s) for s in sets], np.int64)
        regs = np.stack([minhashes(s, REGISTERS) for s in sets]) if len(rows) > 8 else np.zeros((len(rows), 1), np.uint16)
        fine: dict[int, np.ndarray] = {}
        forest = Forest([r["id"] for r in rows])

        def sharp(k: int) -> np.ndarray:
            if k not in fine:
                fine[k] = minhashes(sets[k], FINE)
            return fine[k]

        p, q = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *close(left, right, n, regs, percent)))
        estimate = np.ones(len(p))
        if len(p) > 64:
            for s in range(0, len(p), 1000):
                a, b = (np.stack([sharp(k) for k in side[s:s + 1000].tolist()]) for side in (p, q))
                estimate[s:s + 1000] = jaccard_estimate(a, b, n[p[s:s + 1000]].astype(float), n[q[s:s + 1000]].astype(float))
        for k in np.argsort(-estimate, kind="stable"):
            if estimate[k] < fine_floor:
                break
            i, j = int(p[k]), int(q[k])
            if forest.root(i) != forest.root(j) and link(sets[i], sets[j]):
                forest.join(i, j)
        return forest

    return forest_of(lambda few: texts.join(few, "component"), sizes, ["component"], ["text"], blocks_of_texts(), meets, tile)


def blocks_of_texts() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `documents`."""
    table = cut(sketches(bounded_batches(documents), width, lower))
    # a class is a set; one row stands for it, and it has a number of its own, as an id may have several texts
    classes = (table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("d1", "d2")
               .agg(F.min(F.struct("doc_id", "t", "u")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"),
                    F.first("bands").alias("bands")))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    rows = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = cut(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
                 .select("band", "key", F.ceil(F.col("n") / BLOCK).alias("blocks")))

    def members(buckets: DataFrame) -> DataFrame:
        """Registers are looked up only for the members of a bucket."""
        return rows.join(buckets, ["band", "key"]).join(classes.select("id", "n_shingles", "regs"), "id")

    clusters = cut(components(cut(plausible(members, shared, percent))))
    chosen = clusters.join(classes.select("id", "row.doc_id", "row.t", "row.u"), "id")
    # rows that repeat id and text are one
    texts = cut(told_apart(documents).join(chosen, ["doc_id", "t", "u"]).groupBy("component", "id").agg(F.min("text").alias("text")))
    sizes = cut(texts.groupBy("component").agg(blocks_of_texts().cast("long").alias("blocks")))
    joined = components(cut(linked(texts, sizes, width, percent, lower)))
    group = classes.select("d1", "d2", "id").join(joined, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("group"))
    # a table's own rows find their class by the digest; rows without a set or an id have none
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    placed = cut(table.select("doc_id", "n_shingles", F.when(some, F.col("d1")).alias("d1"), F.when(some, F.col("d2")).alias("d2"))
                 .join(group, ["d1", "d2"], "left").select("doc_id", "n_shingles", "group"))
    vertices = cut(one_group(cut(placed.where(F.col("group").isNotNull()).select("doc_id", "group").distinct())))
    least = vertices.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = vertices.join(least, "group").select("doc_id", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_group(vertices: DataFrame) -> DataFrame:
    """(doc_id, group) with one group for each id: groups that share an id are one."""
    several = vertices.groupBy("doc_id").agg(F.min("group").alias("a"), F.count("*").alias("n")).where("n > 1").select("doc_id", "a")
    links = cut(vertices.join(several, "doc_id").where(F.col("group") != F.col("a")).select("a", F.col("group").alias("b")))
    if links.isEmpty():
        return vertices
    up = components(links).select(F.col("id").alias("group"), F.col("component"))
    return vertices.join(up, "group", "left").select("doc_id", F.coalesce("component", "group").alias("group")).distinct()


def without_copies(documents: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Rows of `documents`, all columns, one of each group of near-duplicates and copies: the smallest doc_id, a null one
    last, of equal ids any one row. Here every row is a vertex of its own, so a repeated id with another text stays
    and a repeated row does not; rows without words stay, each."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = cut(documents.select(row.alias("row"), F.col("doc_id").alias("own_id"), "text").withColumn("doc_id", F.monotonically_increasing_id()))
    found = near_duplicates(keyed.select("doc_id", "text"), width, percent, lower).select("doc_id", "component_id")
    order = F.struct(F.col("own_id").isNull(), "own_id", "doc_id")
    first = keyed.select("doc_id", "own_id").join(found, "doc_id").groupBy("component_id").agg(F.min(order).alias("first")).select("first.doc_id")
    return keyed.join(first, "doc_id", "left_semi").select("row.*")


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
