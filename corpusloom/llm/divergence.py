"""Source divergence audit: how far the sources of a language are from each other, and each from its language.

Terms are runs of ASCII letters and other than ASCII characters, A-Z in lower case; each language keeps the terms
that stand in at least `MIN_DOCUMENTS` of its documents (rows). A group (language and source) and a language give each
kept term p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), in whole numbers throughout.

Pairs are summed by a cube: the groups of a language are dealt into blocks of about `GROUPS`, its kept terms into blocks
of about `TERMS`, both by hash, and each cell (group block, group block, term block) is one task's group of rows. A
cell gets the slices of its two group blocks (every slice goes to as many cells as there are group blocks), holds
them as two small dense matrices, and returns a partial sum for each of its pairs; partial sums are added along the
term axis. Terms that neither slice holds need no column: the first term block adds V times the difference
of the two groups' values for a count of zero, and a column adds what it differs from that. So a cell's memory is
bounded by its blocks whatever the corpus holds, and no row meets another outside a cell.

Counts are added up within a task before they are shuffled; a hot source sends at most one row a term and flush.

Defined results: null text, language and source are read as ''. Every language and source that occurs is a group,
also without terms; with V = 0 all pairs have the value 0. Repeated rows count each time. Ties are ordered by item in
UTF-8. An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .arrow_text import text_bytes
from .tables import bounded_batches, read

MIN_DOCUMENTS = 30
PRIOR, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
GROUPS, TERMS = 128, 2_048  # sides of a cell
FLUSH = 200_000  # counters held in a task

COUNTS = "lang string, source string, term string, n long, documents long"
PARTIAL = "lang string, a_block int, a int, b_block int, b int, value long"


def letters() -> bytes:
    """A table for bytes.translate: letters in lower case and bytes of other characters stay, the rest is space."""
    keep = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in keep else 0x20 for b in range(256))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and rows with the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            raw = data.tobytes()
            at = offsets.tolist()
            for k, key in enumerate(zip(batch["lang"].to_pylist(), batch["source"].to_pylist())):
                n, rows = held.setdefault(key, (Counter(), Counter()))
                terms = raw[at[k]:at[k + 1]].translate(table).split()
                n.update(terms)
                rows.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > FLUSH:
                yield from flushed(held)
                held = {}
        yield from flushed(held)

    named = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return (bounded_batches(named).mapInArrow(run, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))


def flushed(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, rows) in held.items():
        terms = list(n)
        if terms:
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()),
                pa.array([rows[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "documents"])


def smoothed(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)) by long division in two steps: no product exceeds 63 bits
    up to 10^13 occurrences."""
    over, under = n + F.lit(PRIOR), F.greatest(total + F.lit(PRIOR) * kept, F.lit(1).cast("long"))
    high, low = 100_000, SCALE // 100_000
    first = F.call_function("div", over * F.lit(high), under)
    rest = (over * F.lit(high)) % under
    return F.lit(1) + first * F.lit(low) + F.call_function("div", rest * F.lit(low), under)


def block_of(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


def blocks_for(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def cell(table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of one cell: rows with col = -1 are its groups, with their value for a count of zero."""
    block, slot, col, p, kept = (np.asarray(table[c]) for c in ("block", "slot", "col", "p", "kept"))
    x, y, t = (table[c][0].as_py() for c in ("x", "y", "t"))
    key = block.astype(np.int64) << 32 | slot
    groups = np.flatnonzero(col < 0)
    groups = groups[np.argsort(key[groups])]
    base = p[groups]
    filled = np.flatnonzero(col >= 0)
    columns, at = np.unique(col[filled], return_inverse=True)
    values = np.repeat(base[:, None], len(columns), 1)
    values[np.searchsorted(key[groups], key[filled]), at] = p[filled]
    left, right = np.flatnonzero(block[groups] == x), np.flatnonzero(block[groups] == y)
    a, b, sums = [], [], []
    for i in left:
        others = right[right > i] if x == y else right
        zero = np.abs(base[others] - base[i])
        own = np.abs(values[others] - values[i]).sum(1) - len(columns) * zero
        a.append(np.full(len(others), i))
        b.append(others)
        sums.append(own + (kept[0] * zero if t == 0 else 0))
    a, b, sums = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (a, b, sums))
    of = lambda values, k: pa.array(values[groups][k], pa.int32())
    return pa.table([pa.array([table["lang"][0].as_py()] * len(a), pa.string()), of(block, a), of(slot, a), of(block, b), of(slot, b),
                     pa.array(sums, pa.int64())], names=["lang", "a_block", "a", "b_block", "b", "value"])


def divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS,
               group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source, `term` rows for a group's
    `top_terms` most over-represented terms."""
    tally = cut(term_counts(documents))
    kept = (tally.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"))
            .where(F.col("documents") >= min_documents).select("lang", "term", "total"))
    kept = cut(kept)
    found = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    found = cut(found)
    # a row for each language
    langs = (found.groupBy("lang").agg(blocks_for(F.count("*"), group_block).alias("g_blocks"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n")), "lang", "left")
             .select("lang", "g_blocks", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("lang_n", F.lit(0).cast("long")).alias("lang_n"))
             .withColumn("t_blocks", blocks_for(F.col("kept"), term_block)))
    langs = cut(langs)
    place = Window.partitionBy("lang", "t")
    terms = (kept.join(langs.select("lang", "t_blocks", "kept", "lang_n"), "lang").withColumn("t", block_of("term", "t_blocks"))
             .select("lang", "term", "t", (F.row_number().over(place.orderBy("term")) - 1).alias("col"),
                     smoothed(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q")))
    entries = cut(tally.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    place = Window.partitionBy("lang", "block").orderBy("source")
    groups = (found.join(langs, "lang").join(own, ["lang", "source"], "left")
              .withColumn("group_n", F.coalesce("group_n", F.lit(0).cast("long"))).withColumn("block", block_of("source", "g_blocks"))
              .withColumn("slot", F.row_number().over(place) - 1))
    groups = cut(groups)
    valued = entries.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("group_n"), F.col("kept")))

    slices = valued.select("lang", "block", "slot", "t", "col", "p", "kept", "g_blocks").unionByName(
        groups.select("lang", "block", "slot", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("t"), F.lit(-1).alias("col"),
                      smoothed(F.lit(0).cast("long"), F.col("group_n"), F.col("kept")).alias("p"), "kept", "g_blocks"))
    cells = (slices.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("g_blocks") - 1)))
             .select("lang", F.least("block", "h").alias("x"), F.greatest("block", "h").alias("y"), "t", "block", "slot", "col", "p", "kept"))
    pairs = cells.groupBy("lang", "x", "y", "t").applyInArrow(cell, PARTIAL).groupBy("lang", "a_block", "a", "b_block", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "block", "slot", "source")
    for side in ("a", "b"):
        pairs = pairs.join(names.select("lang", F.col("block").alias(f"{side}_block"), F.col("slot").alias(side), F.col("source").alias(f"{side}_name")),
                           ["lang", f"{side}_block", side])
    both = pairs.select("lang", "value", F.inline(F.array(
        F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item")))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = (valued.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return pair.unionByName(term)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
