"""Document fingerprints from Lempel-Ziv phrases, compared by minimum hashes.

A text's UTF-8 bytes are parsed into the phrases of an LZ78 dictionary: each phrase is the shortest string not met
before. The set of phrases (the dictionary) is hashed, and the least hash per register makes the fingerprint. Texts that
compress alike share phrases, so the share of equal registers is a likeness from 0 to 1.

The next document, for `near_next` and the edited text, comes from a shuffle of rows into ranges of doc_id: each
range is sorted in its task, and the first row of a range is sent to the range before it as well, so no order passes
through one task. The bounds are the quantiles of the ids, a list as long as the number of
ranges, `MAX_RANGES` at most; beyond, ranges grow and are still read as a stream. An id of very many rows (also the null
id) is several quantiles and is split into as many ranges by the hash of the text; only rows equal in both stay together.

Defined results: a null text is empty. The empty text's fingerprint is all zeros; two empty texts have likeness 1, an empty
and another text 0. Rows with equal doc_id are ordered by the text's hash (xxhash64), then by text. Rows with a null doc_id come first in the order. In a
table of one row the next document is itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import mix, random_u64
from .tables import bounded_batches, read

REGISTERS = 64
RANGE_ROWS, MAX_RANGES = 4_000, 20_000

_U64 = np.uint64


def phrase_ends(data: bytes, start: int = 0, nodes: dict[int, int] | None = None) -> list[int]:
    """End of each LZ78 phrase of `data` from `start`, a phrase boundary; the last one may be a repeated phrase.
    `nodes` is the dictionary so far and takes the new phrases."""
    nodes = {} if nodes is None else nodes
    get, ends, fresh, node, at = nodes.get, [], 256 * (len(nodes) + 1), 0, start
    for at, byte in enumerate(data[start:] if start else data, start + 1):
        key = node + byte
        node = get(key, 0)
        if not node:  # a new phrase ends here
            nodes[key] = fresh
            fresh += 256
            ends.append(at)
    if node:
        ends.append(at)
    return ends


def both_ends(data: bytes, other: bytes, common: int) -> tuple[list[int], list[int]]:
    """Phrase ends of two texts that agree in their first `common` bytes, which are parsed once."""
    nodes: dict[int, int] = {}
    head = phrase_ends(data[:common], 0, nodes)
    if head and len(head) > len(nodes):  # the last phrase is unfinished: it may go on differently
        head.pop()
    at = head[-1] if head else 0
    return head + phrase_ends(data, at, dict(nodes)), head + phrase_ends(other, at, nodes)


class Hasher:
    """Hashes slices of a text by one prefix sum, and takes the least hash per register."""

    def __init__(self, registers: int = REGISTERS, seed: int = 41):
        self.table, self.base = random_u64(256, seed), 0x9E3779B97F4A7C15
        self.salt, self.odd = (random_u64(registers, seed + k).astype(np.uint32) | np.uint32(k - 1) for k in (1, 2))
        self.up = self.down = np.zeros(0, np.uint64)

    def slices(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice, in pieces of about a MiB."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if len(self.up) < hi - lo:
                n = max(hi - lo, 1 << 14)
                self.up = np.cumprod(np.full(n, _U64(self.base)))
                self.down = np.cumprod(np.full(n, _U64(pow(self.base, -1, 1 << 64))))
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.table[raw[lo:hi]] * self.up[:hi - lo], out=total[1:])
            out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * self.down[starts[i:j] - lo]
            i = j
        return mix(out + (ends - starts).astype(np.uint64))

    def fingerprint(self, data: bytes, ends: list[int]) -> np.ndarray:
        """The last 16 bits of the least hash of each register over the phrases of `data`; zeros without phrases."""
        least = np.full(len(self.salt), 0xFFFFFFFF, np.uint32)
        if not data:
            return np.zeros(len(self.salt), np.uint16)
        stop = np.array(ends, np.int64)
        with np.errstate(over="ignore"):
            h = (self.slices(np.frombuffer(data, np.uint8), np.append(0, stop[:-1]), stop) >> _U64(32)).astype(np.uint32)
            for k in range(0, len(h), 512):
                least = np.minimum(least, ((h[k:k + 512, None] ^ self.salt) * self.odd).min(0))
        return np.maximum(least & np.uint32(0xFFFF), 1).astype(np.uint16)  # zero is kept for empty texts


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal registers."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """`text` with its last half (rounded down) replaced by as many first characters of the following text, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _bounds_passed(key: Column, bounds: list[int], strict: bool = False) -> Column:
    """How many of the sorted bounds are at or under (strict: under) the key: counted among the heads of chunks, then in
    one chunk."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    under = lambda values: F.size(F.filter(values, lambda b: b < key if strict else b <= key))
    chunk = under(F.array(*[F.lit(c[0]) for c in chunks]))
    inner = F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), chunk - 1)
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * width + under(inner)).cast("int")


def _part(key: Column, tie: Column, bounds: list[int]) -> Column:
    """The range of a row. An id that is m >= 2 of the quantiles holds the rows of about m ranges, and is given m of them,
    by `tie`; ids over it follow in the last."""
    passed = _bounds_passed(key, bounds)
    hot = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    if not hot:
        return passed
    before = _bounds_passed(key, bounds, strict=True)
    share = tie / F.lit(float(1 << 63)) * 0.5 + 0.5  # 0 to 1, in the order of the ties
    within = F.least(F.floor(share * (passed - before)), passed - before - 1)
    return F.when(_bounds_passed(key, hot) > _bounds_passed(key, hot, strict=True), before + 1 + within).otherwise(passed).cast("int")


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, guest) of `documents`: each part is a range of ids, its guest row the first of the
    next part, or for the last part the first row of all."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = keyed.count()
    parts = min(MAX_RANGES, max(1, -(-rows // RANGE_ROWS)))
    step = [k / parts for k in range(1, parts)]
    bounds = sorted(keyed.select(F.percentile_approx("key", step, 10 * parts)).first()[0] or []) if step and rows else []
    placed = keyed.withColumn("part", _part(F.col("key"), F.col("tie"), bounds))
    first = {r["part"]: r["r"] for r in placed.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("r")).collect()}  # a row per part
    order = sorted(first)
    guests = [(*first[p], order[k - 1]) for k, p in enumerate(order)]  # the first row of all goes to the last part
    guest_of = spark.createDataFrame(guests or [(0, 0, 0)], "key long, tie long, guest_part int").where(F.lit(bool(guests)))
    firsts = (placed.drop("part").join(F.broadcast(guest_of), ["key", "tie"]).groupBy("key", "tie", "guest_part")  # a row per part
              .agg(F.min(F.struct("text", "doc_id")).alias("r"))
              .select("key", "tie", F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), F.col("guest_part").alias("part")))
    every = placed.select("part", "key", "tie", "doc_id", "text", F.lit(0).alias("guest")).union(firsts.select("part", "key", "tie", "doc_id", "text", F.lit(1)))
    return every.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "key", "tie", "text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    names = ("doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, due = Hasher(), None, None  # a row waits for its next text, then for that one's fingerprint

        def finished(doc_id, text, following):
            """The row without the likeness to the next text, and its fingerprint."""
            new = edited(text, following)
            data, other = text.encode(), new.encode()
            common = len(text[:len(text) - len(text) // 2].encode())
            own_ends, new_ends = both_ends(data, other, common) if new != text else (phrase_ends(data),) * 2
            own = hasher.fingerprint(data, own_ends)
            changed = hasher.fingerprint(other, new_ends) if new != text else own
            return [doc_id, text, new, own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(own, changed)], own

        for batch in batches:
            rows: list[list] = []
            for part, doc_id, text, guest in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "text", "guest"))):
                if held is not None and held[0] == part:
                    row, own = finished(*held[1:], text)
                    if due is not None:
                        rows.append([*due[0], likeness(due[1], own)])
                    due = (row, own)
                if guest:  # the last text of its part: fingerprinted for the row before it only
                    if due is not None:
                        data = text.encode()
                        rows.append([*due[0], likeness(due[1], hasher.fingerprint(data, phrase_ends(data)))])
                    held = due = None
                else:
                    held = (part, doc_id, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    return with_next(bounded_batches(documents)).select("part", "doc_id", "text", "guest").mapInArrow(
        run, "doc_id long, text string, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
