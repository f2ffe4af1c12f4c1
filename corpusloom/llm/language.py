"""Language identification by partial matching: byte context trees per language give exact code lengths.

Each language's tree holds the byte contexts of up to three bytes seen in a bounded sample of its training rows
(`SAMPLE_PER_LANGUAGE` documents, chosen by hash, long ones by a piece of `tables.PIECE_CHARS`). A byte that a context has seen
costs its share of the context's count plus the escapes; any other byte pays the escape (method C: distinct
followers over count plus distinct followers) and asks the context that is one byte shorter, down to a uniform
order -1. Statistics are frozen, so the trees are compiled into one table: longest known context and byte to
code length in 1/1024 bit per language. A text's code length is a sum of whole numbers, the same in any order.

Contexts of two bytes are all kept; of three bytes, the `MAX_CONTEXTS` most frequent with at least
`MIN_CONTEXT` occurrences (the model's size does not depend on the corpus). Bytes unseen in training share one
symbol, as do the cases of an ASCII letter. The language with the shortest code wins, ties go to the smaller name.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text when there are
no training rows. Empty texts have no letter. Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import runs, sums, text_bytes
from .tables import bounded_batches, crc_mod, piece_of, read, threshold_sample

SAMPLE_PER_LANGUAGE = 400
MAX_CONTEXTS = 16_384
MIN_CONTEXT = 8
SCALE = 1024
EVIDENCE_BYTES = 64  # a score weighs at most so many bytes' evidence
UNKNOWN = "und"
MAX_BITS_PER_BYTE = 9.0  # beyond it a text is in none of the learned languages


def _symbols(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> list[np.ndarray]:
    """Symbols of each byte and of the one, two and three before it; 0 before a text begins."""
    at = symbol[data].astype(np.int32)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    position = np.arange(len(data)) - start
    out = [at]
    for k in (1, 2, 3):
        before = np.zeros(len(at), np.int32)
        before[k:] = at[:-k] if len(at) > k else at[:0]
        before[position < k] = 0
        out.append(before)
    return out


def train(texts: pa.Array, languages: list[str]) -> dict:
    """Compiled trees from texts and their languages."""
    names = sorted(set(languages))
    if not names:
        return {"names": []}
    data, offsets = text_bytes(texts)
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[ord("A"):ord("Z") + 1] = np.maximum(symbol[ord("a"):ord("z") + 1], symbol[ord("A"):ord("Z") + 1])
    a = len(seen) + 1
    x, c1, c2, c3 = _symbols(data, offsets, symbol)
    two = c2.astype(np.int64) * a + c1
    three = c3.astype(np.int64) * a * a + two
    contexts, counts = np.unique(three, return_counts=True)
    often = np.flatnonzero(counts >= MIN_CONTEXT)
    often = often[np.lexsort((contexts[often], -counts[often]))][:MAX_CONTEXTS]
    known = np.sort(contexts[often])
    node = np.tile(np.arange(a * a, dtype=np.int32), a)  # the two-byte context at the end of each three-byte one
    node[known] = a * a + np.arange(len(known), dtype=np.int32)
    lang = np.repeat(np.array([names.index(v) for v in languages]), np.diff(offsets))
    table = np.empty(((a * a + len(known)) * a, len(names)), np.uint16)

    def escape(p_shorter: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Followers' probabilities from counts n (contexts x symbols) and those of the shorter contexts."""
        total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        empty = total == 0
        return np.where(n > 0, n / np.maximum(total + distinct, 1), np.where(empty, 1, distinct / np.maximum(total + distinct, 1)) * p_shorter)

    for k in range(len(names)):
        own = lang == k
        xs, t2, t3, b1 = x[own], two[own], three[own], c1[own]
        p0 = escape(np.full((1, a), 1 / 256), np.bincount(xs, minlength=a)[None, :].astype(float))
        p1 = escape(p0, np.bincount(b1.astype(np.int64) * a + xs, minlength=a * a).reshape(a, a).astype(float))
        p2 = escape(np.tile(p1, (a, 1)), np.bincount(t2 * a + xs, minlength=a ** 3).reshape(a * a, a).astype(float))
        inside = node[t3] >= a * a
        n3 = np.bincount((node[t3[inside]] - a * a).astype(np.int64) * a + xs[inside], minlength=len(known) * a)
        p3 = escape(p2[known % (a * a)], n3.reshape(len(known), a).astype(float))
        bits = -np.log2(np.concatenate([p2, p3])).ravel() * SCALE
        table[:, k] = np.minimum(np.rint(bits), 65535)
    return {"names": names, "symbol": symbol, "a": a, "node": node, "table": table}


def code_lengths(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(code length of each text in each language in 1/SCALE bit, bytes of each text)."""
    data, offsets = text_bytes(texts)
    a, out = model["a"], np.zeros((len(offsets) - 1, len(model["names"])), np.int64)
    for i, j in runs(offsets, 1 << 18):
        lo = offsets[i]
        while lo < offsets[j]:  # a longer text in pieces; three bytes before a piece are its context
            hi = min(offsets[j], lo + (1 << 19)) if j == i + 1 else offsets[j]
            lead = min(3, lo - offsets[i]) if j == i + 1 else 0
            at = np.clip(offsets[i:j + 1], lo, hi) - lo
            part = data[lo - lead:hi]
            x, c1, c2, c3 = _symbols(part, np.append(0, at[1:] + lead), model["symbol"])
            row = model["node"][(c3 * a + c2) * a + c1].astype(np.int64) * a + x
            out[i:j] += sums(model["table"][row[lead:]].astype(np.int64), at)
            lo = hi
    return out, np.diff(offsets)


def train_on(documents: DataFrame) -> dict:
    """Trees from the rows that may be learned from: a language and crc32(doc_id) mod 3 other than 1. Of rows that repeat id
    and text one teaches; at most languages x SAMPLE_PER_LANGUAGE pieces reach the driver."""
    turn = F.xxhash64("doc_id", "text", F.lit(2))
    allowed = documents.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1) & (F.octet_length("text") > 0))
    near = threshold_sample(allowed.select("lang", turn.alias("turn")), "lang", SAMPLE_PER_LANGUAGE, F.col("turn"))
    picks = near.distinct()
    rows = allowed.select("lang", turn.alias("turn"), "text").join(F.broadcast(picks), ["lang", "turn"])
    rows = rows.groupBy("lang", "turn").agg(F.min(piece_of(F.col("text"), F.col("turn"))).alias("text")).select("lang", "text").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("text", "ascending")]).combine_chunks()
    return train(rows["text"], rows["lang"].to_pylist())


STRUCT = "struct<lang_pred:string,score:double,bits:double>"


def predicted(text: Column, model: dict) -> Column:
    """A struct of the language, its score and the code length in bits per byte."""
    if not model["names"]:
        return F.lit(None).cast(STRUCT).withField("lang_pred", F.lit(UNKNOWN))

    @F.arrow_udf(STRUCT)
    def predict(texts: pa.Array) -> pa.Array:
        length, n = code_lengths(texts, model)
        best = length.argmin(1)
        bits = length / SCALE
        each = np.minimum(n, EVIDENCE_BYTES) / np.maximum(n, 1)
        gap = (bits - bits.min(1, keepdims=True)) * each[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 500)).sum(1)
        return pa.StructArray.from_arrays([
            pa.array([model["names"][k] for k in best], pa.string()), pa.array(score),
            pa.array(bits.min(1) / np.maximum(n, 1))], names=["lang_pred", "score", "bits"])

    return predict(text)


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """`documents` with a struct `_l`: lang_pred, score, bits (per byte), accepted."""
    found = bounded_batches(documents).withColumn("_l", predicted(F.col("text"), model))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model["names"]))
    name, score = F.when(letters, F.col("_l.lang_pred")).otherwise(UNKNOWN), F.when(letters, F.col("_l.score")).otherwise(0.0)
    return found.withColumn("_l", F.struct(name.alias("lang_pred"), score.alias("score"), F.col("_l.bits").alias("bits"),
                                           (letters & (F.col("_l.bits") <= MAX_BITS_PER_BYTE)).alias("accepted")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return identify(documents.select("doc_id", "text"), train_on(documents)).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "_l.lang_pred", "_l.score", "_l.bits")
