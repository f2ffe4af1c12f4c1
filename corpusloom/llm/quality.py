"""Quality rules: base counts of every text, and a hashed n-gram logistic regression over words and characters.

The model is fitted on a bounded sample of labelled rows (`SAMPLE_PER_LABEL` of each label, chosen by hash, long texts
by a piece of `tables.PIECE_CHARS`), calibrated on a held-back fifth of it, and moved to the label shares of all
labelled documents. Texts are scored in Arrow batches, a block of documents at a time; the feature space is
shares of byte 1- to 3-grams and of word 1- and 2-grams, so a score is one look-up and one sum per n-gram.

Defined results: a null text counts as empty; an empty text has no words, fails the base rule and has the score
of no evidence (the calibrated intercept). Repeated rows are scored alike. Other columns are left alone.
Without labelled rows of both kinds the score is 1.0 for all, so the base rule alone decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, code_points, is_space, mix, random_u64, runs, shingles, sums, text_bytes
from .calibration import HELD, platt
from .tables import bounded_batches, labelled_sample, read

SAMPLE_PER_LABEL = 2_000
BUCKETS = 1 << 15  # of each feature family
KEEP_AT = 0.5  # likelier good than not
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_U64 = np.uint64
FAMILIES = ("char1", "char2", "char3", "word1", "word2")


def features(data: np.ndarray, offsets: np.ndarray, words: Words):
    """For each family: (bucket of every n-gram, offsets by document). Buckets of families don't overlap."""
    n = len(data)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    key, table = np.zeros(n, np.uint64), random_u64(256, 11)
    with np.errstate(over="ignore"):
        for k in range(3):
            key[:n - k] = mix(key[:n - k] + table[data[k:]]) if n > k else key[:0]
            inside = np.flatnonzero(np.arange(n) + k < owner_end)
            yield ((key[inside] & _U64(BUCKETS - 1)).astype(np.int64) + k * BUCKETS, np.searchsorted(inside, offsets))
        _, _, hashes, at = words.of(data, offsets)
        yield (hashes & _U64(BUCKETS - 1)).astype(np.int64) + 3 * BUCKETS, at
        pairs, pair_at = shingles(hashes, at, 2)
        yield (pairs & _U64(BUCKETS - 1)).astype(np.int64) + 4 * BUCKETS, pair_at


def fit(texts: pa.Array, labels: np.ndarray, prior: float | None = None, steps: int = 60) -> dict:
    """Logistic regression by full-batch Adam on n-gram shares, then Platt scaling on every fifth row."""
    if not len(labels) or labels.min() == labels.max():
        return {"weights": None}
    data, offsets = text_bytes(texts)
    words, n = Words(7), len(labels)
    rows, cols, vals = [], [], []
    for i, j in runs(offsets):
        part = offsets[i:j + 1] - offsets[i]
        for bucket, at in features(data[offsets[i]:offsets[j]], part, words):
            count = np.diff(at)
            row = np.repeat(np.arange(i, j), count)
            pair, times = np.unique(row * np.int64(5 * BUCKETS) + bucket, return_counts=True)
            r = pair // (5 * BUCKETS)
            rows.append(r.astype(np.int32))
            cols.append((pair % (5 * BUCKETS)).astype(np.int32))
            vals.append((times / count[r - i]).astype(np.float32))
    rows, cols, vals = map(np.concatenate, (rows, cols, vals))
    y, held = labels.astype(np.float64), np.arange(n) % 5 == 4
    share = np.where(y == 1, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())) * ~held
    w, m, v, bias = np.zeros(5 * BUCKETS), np.zeros(5 * BUCKETS + 1), np.zeros(5 * BUCKETS + 1), 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=vals * w[cols], minlength=n) + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        g = np.append(np.bincount(cols, weights=vals * error[rows], minlength=len(w)) + 1e-6 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.5 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = np.bincount(rows, weights=vals * w[cols], minlength=n) + bias
    zh, yh = (z[held], y[held]) if min(y[held].sum(), (1 - y[held]).sum()) >= HELD else (z, y)
    a, b = platt(zh, yh, 0.5 if prior is None else prior)
    return {"weights": w.astype(np.float32), "bias": float(bias), "a": float(a), "b": float(b)}


def fit_on(documents: DataFrame, labels: DataFrame, column: str = "quality") -> dict:
    """The model from a bounded sample of `documents` labelled 0 or 1 in `column`."""
    rows, share = labelled_sample(documents, labels, column, SAMPLE_PER_LABEL, 1)
    order = np.argsort(np.arange(rows.num_rows) % 7, kind="stable")  # labels and lengths in every fifth row alike
    return fit(rows["text"].take(pa.array(order)).combine_chunks(), np.asarray(rows["y"])[order], share)


def scan(texts: pa.Array, model: dict) -> dict[str, np.ndarray]:
    """Base counts and score of each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out["score"] = np.ones(n)
    words, space = Words(7), is_space()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    weights = model["weights"]
    for i, j in runs(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        _, _, hashes, word_at = words.of(part, at)
        out["n_words"][i:j] = np.diff(word_at)
        out["word_chars"][i:j] = code_points(part, at) - sums(space[part], at)
        out["n_symbols"][i:j] = sums(symbol[part], at)
        out["n_dup_lines"][i:j] = duplicate_lines(part, at, words)
        out["n_repeat_words"][i:j] = repeated(hashes, word_at)
        if weights is not None:
            z = np.full(j - i, model["bias"])
            for bucket, feature_at in features(part, at, words):
                z += sums(weights[bucket].astype(np.float64), feature_at) / np.maximum(np.diff(feature_at), 1)
            out["score"][i:j] = 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30)))
    return out


def repeated(hashes: np.ndarray, word_at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each document inside a `width`-word window that the document holds twice or more."""
    n = np.diff(word_at)
    rolled, at = shingles(hashes, word_at, width)
    owner = np.repeat(np.arange(len(n)), np.diff(at))
    whole = n[owner] >= width  # shorter texts have no window
    position = (np.arange(len(rolled)) - at[owner] + word_at[owner])[whole]
    with np.errstate(over="ignore"):
        key = (mix(rolled ^ random_u64(1, 5)[0]) + mix(owner.astype(np.uint64)))[whole]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    if len(key):
        equal = key[order][1:] == key[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, position[same], 1)
    np.add.at(edge, position[same] + width, -1)
    return sums(np.cumsum(edge)[:-1] > 0, word_at) if len(hashes) else np.zeros(len(n), np.int64)


def duplicate_lines(part: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    out = np.zeros(len(at) - 1, np.int64)
    breaks = part == 10
    if not breaks.any():
        return out
    raw = part.tobytes()
    for d in np.flatnonzero(sums(breaks, at)):
        seen: set[bytes] = set()
        for line in raw[at[d]:at[d + 1]].split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                out[d] += line in seen
                seen.add(line)
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def scored(text: Column, model: dict) -> Column:
    """A struct of base counts and score for a text column."""
    @F.arrow_udf(FIELDS_STRUCT)
    def score(texts: pa.Array) -> pa.Array:
        found = scan(texts, model)
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))
    return score(text)


FIELDS_STRUCT = f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"


def quality(documents: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """`documents` with a struct `_q`: counts, score, base_failed and kept."""
    q = bounded_batches(documents).withColumn("_q", scored(F.col("text"), model))
    failed = (F.col("_q.n_words") < MIN_WORDS) | (100 * F.col("_q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q.n_words"))
    return q.withColumn("_q", F.col("_q").withField("base_failed", failed)
                        .withField("kept", ~failed & (F.col("_q.score") >= keep_at)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit_on(documents, read(spark, sf_dir, "labels"))
    return quality(documents.select("doc_id", "text"), model).select("doc_id", "_q.*")
