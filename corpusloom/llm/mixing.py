"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

Source token shares p are raised to an exponent t and normalised: w = p^t / sum p^t. Between t = 1 (as the corpus is)
and t = 0 (all sources alike) the entropy of w only grows, and so does the most that a source is repeated; so the
exponent for a target is bisected, several halvings in one small job over the sources' totals.

Weights become whole rows by blocks. A source's documents fall by hash into blocks of about `BLOCK_TOKENS` tokens
(at most `MAX_BLOCKS`, so that one source's blocks fit a task whatever the corpus). Each epoch permutes the blocks by a
hash of (source, block, epoch). A source takes whole epochs while its budget lasts and, in the last one, blocks in
that epoch's order until the budget is met to within a block: the block that straddles it is taken if more than half
of it fits. Nothing is drawn at random, so a lost task comes back the same.

Defined results: a null or blank text has 0 tokens and follows its block; a null source is a source of its own; a
source without tokens has weight 0 and is taken once. With one source, or none with tokens, the exponent is 1. An
empty table gives no rows. Rows that repeat an id are taken alike. A target beyond what exponents in [0, 1] reach
gives the nearest end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .tables import read

BLOCK_TOKENS = 1_000_000
MAX_BLOCKS = 4_096
MIN_BLOCKS = 32  # so that small sources meet their budget closely
HALVINGS_A_JOB, JOBS = 5, 8
TARGET_ENTROPY = 0.97  # of the entropy of equal weights
REPEAT_LIMIT = 1.5  # in the pipeline, epochs of the most repeated source
SEED = 97


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def totals(sized: DataFrame) -> DataFrame:
    """(source, tokens, all_tokens, share) of each source."""
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sums = cut(sums)
    whole = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = F.col("tokens") / whole if whole else F.lit(0.0)
    return sums.select("source", "tokens", F.lit(whole).alias("all_tokens"), share.alias("share"))


def exponent(sources: DataFrame, entropy: float | None = None, repeat_limit: float | None = None) -> float:
    """The exponent in [0, 1] at which normalised weights have `entropy` (as a share of that of equal weights), or at
    which covering the largest source once repeats another `repeat_limit` times at most."""
    some = sources.where("share > 0")
    n, top = some.agg(F.count("*"), F.max("share")).first()
    if n < 2:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(JOBS):
        inner = 2 ** HALVINGS_A_JOB
        tries = [lo + (hi - lo) * k / inner for k in range(1, inner)]
        at = some.select("share", F.explode(F.array(*map(F.lit, tries))).alias("t"))
        power = F.pow("share", "t")
        if entropy is not None:  # H = ln Z - sum(p^t ln p^t) / Z
            value = (F.log(F.sum(power)) - F.sum(power * F.col("t") * F.log("share")) / F.sum(power)) / math.log(n)
            limit = entropy
        else:  # w_s / p_s against that of the largest source
            value, limit = F.max(F.pow(F.col("share") / F.lit(top), F.col("t") - 1)), repeat_limit
        # value falls as t grows: the answer is the least t whose value is within the limit
        within = at.groupBy("t").agg(value.alias("v")).where(F.col("v") <= limit).agg(F.min("t")).first()[0]
        hi = hi if within is None else within
        lo = max([t for t in [lo, *tries] if t < hi])
    return hi


def plan(sized: DataFrame, entropy: float | None = None, repeat_limit: float | None = None) -> DataFrame:
    """(source, fine, block, weight, copies, slot) for the fine blocks of `sized` (source, fine, tokens): how often one is
    taken, and its place in the source's last epoch. With `entropy` the budget is the corpus' own tokens; with
    `repeat_limit` it is the least that takes the largest source once, so that nothing is left out."""
    sources = totals(sized)
    t = exponent(sources, entropy, repeat_limit)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(t))).otherwise(0.0)
    z, top = sources.agg(F.sum(power), F.max("share")).first()
    budget = (F.col("all_tokens") * F.col("weight") if repeat_limit is None
              else F.col("tokens") * F.pow(F.col("share") / F.lit(top), F.lit(t - 1)))
    quotas = (sources.withColumn("weight", power / z if z else F.lit(0.0))
              .withColumn("budget", F.when(F.col("share") > 0, budget).otherwise(0.0))
              .withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS))))
              .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(1))
              .withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("tokens")))
              .select("source", "weight", "blocks", "epochs", "rest"))
    # fine blocks are summed before they meet the quotas, so a hot source is MAX_BLOCKS rows
    fine = sized.groupBy("source", "fine").agg(F.sum("tokens").alias("tokens"))
    quotas = quotas.withColumnRenamed("source", "s")
    blocks = cut(fine.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s")
                 .withColumn("block", F.pmod(F.col("fine"), F.col("blocks"))))
    whole = blocks.groupBy("source", "block", "weight", "epochs", "rest").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "epochs", F.lit(SEED)), "block")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = (whole.withColumn("slot", F.row_number().over(order)).withColumn("before", F.coalesce(before, F.lit(0)))
              .withColumn("copies", (F.col("epochs") + (F.col("before") + F.col("tokens") / 2 < F.col("rest")).cast("int")).cast("int")))
    placed = placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "copies", "slot")
    return cut(blocks.select("source", "fine", "block").join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
               .drop("s", "b"))


def fine_block(doc_id: Column) -> Column:
    """The finest block of a row; a source of fewer blocks joins them."""
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(MAX_BLOCKS))


def mixed(documents: DataFrame, entropy: float | None = None, repeat_limit: float | None = None) -> DataFrame:
    """`documents` with _tokens, _weight, _block, _slot and _copies (how often the mix takes the row, 0 or more)."""
    sized = documents.select("source", fine_block(F.col("doc_id")).alias("fine"), tokens(F.col("text")).alias("tokens"))
    planned = plan(cut(sized.groupBy("source", "fine").agg(F.sum("tokens").alias("tokens"))), entropy, repeat_limit)
    planned = planned.select(F.col("source").alias("_s"), F.col("fine").alias("_fine"), F.col("weight").alias("_weight"),
                             F.col("block").alias("_block"), F.col("slot").alias("_slot"), F.col("copies").alias("_copies"))
    rows = documents.withColumn("_key", fine_block(F.col("doc_id")))
    return rows.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_fine"))).drop("_s", "_fine", "_key")


def realised(documents: DataFrame, entropy: float | None = None, repeat_limit: float | None = None) -> DataFrame:
    """The mix itself: every row as often as it is taken, in the columns of `documents`."""
    rows = mixed(documents, entropy, repeat_limit).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*documents.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(documents.withColumn("_tokens", tokens(F.col("text"))), entropy=TARGET_ENTROPY).select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_block").cast("int").alias("block"),
        F.col("_slot").alias("slot"), F.col("_copies").alias("copies"))
