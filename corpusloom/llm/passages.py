"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages.

Every `PASSAGE` words are a passage. A passage is encoded as one learned score for each n-gram family (bytes, byte
trigrams, words, word pairs; hashed, as shares) and a few shares of its characters and words. Gated attention
weighs passages: softmax over a document of w . (tanh(V h) * sigmoid(U h)); the weighted sum of the encodings
goes through a logistic layer. Only documents have labels; V, U, w and the layer are learned from those together.

The fit uses a bounded sample (`SAMPLE_PER_LABEL` documents of a label, chosen by hash, long ones by a piece of
`tables.PIECE_CHARS`): every other document teaches the n-gram scores, the others the attention, and a fifth of those
the calibration (Platt, moved to the share of label 1 in all allowed labels; a small sample is not split so). Scoring reads whole texts, passage by
passage in bounded pieces.

Defined results: null and empty texts and texts without words have no passage; their score is the share of label 1
among such documents of the sample, 0 if it holds none. Without labelled rows of both kinds the score is the share of label 1, or 0 without labels. A null doc_id
is not held out. Repeated rows are scored alike, whatever stands beside them. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, mix, random_u64, runs, sums, text_bytes
from .calibration import HELD, balanced, platt
from .tables import bounded_batches, crc_mod, labelled_sample, read

PASSAGE = 64
SAMPLE_PER_LABEL = 1_500
BUCKETS = 1 << 15  # of each family
FAMILIES = 4
GATE = 8  # rows of V and U
PREDICT_AT = 0.7
SLICE_BYTES = 1 << 18

_U64 = np.uint64


def kinds() -> np.ndarray:
    """Per byte: is a lower-case letter, upper-case letter, digit, other ASCII sign, byte of another character."""
    table = np.zeros((256, 5), np.float32)
    for b in range(256):
        c = chr(b)
        k = 4 if b >= 0x80 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b > 0x20 else None
        if k is not None:
            table[b, k] = 1
    return table


class Encoder:
    """Passages of a batch of texts, and their n-grams and shares."""

    def __init__(self):
        self.words, self.table, self.kinds = Words(41), random_u64(256, 47), kinds()

    def passages(self, data: np.ndarray, offsets: np.ndarray):
        """(first and last byte of each passage, its first word, offsets by document, word bounds and hashes)."""
        start, end, hashes, word_at = self.words.of(data, offsets)
        count = -(-np.diff(word_at) // PASSAGE)
        at = np.append(0, np.cumsum(count))
        owner = np.repeat(np.arange(len(count)), count)
        first = word_at[:-1][owner] + PASSAGE * (np.arange(at[-1]) - at[:-1][owner])
        last = np.minimum(first + PASSAGE, word_at[1:][owner])
        return start[first], end[last - 1] if len(last) else end, first, last, at, start, end, hashes

    def slices(self, data: np.ndarray, offsets: np.ndarray):
        """For runs of passages: (numbers of the passages, [bucket of every n-gram and offsets by passage, for each family],
        shares)."""
        lo, hi, first, last, at, start, end, hashes = self.passages(data, offsets)
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(hi, lo[i] + SLICE_BYTES, "right")))
            raw, base = data[lo[i]:hi[j - 1]], lo[i]
            own_lo, own_hi = lo[i:j] - base, hi[i:j] - base
            limit = np.repeat(own_hi, np.diff(np.append(own_lo, len(raw))))
            spot = np.arange(len(raw))
            inside = np.flatnonzero(spot < limit)
            families = [(raw[inside].astype(np.int64), np.append(np.searchsorted(inside, own_lo), len(inside)))]
            key = np.zeros(len(raw), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(3):
                    key[:len(raw) - k] = mix(key[:len(raw) - k] + self.table[raw[k:]]) if len(raw) > k else key[:0]
                inside = np.flatnonzero(spot + 2 < limit)
                families.append(((key[inside] & _U64(BUCKETS - 1)).astype(np.int64) + BUCKETS, np.append(np.searchsorted(inside, own_lo), len(inside))))
                w = hashes[first[i]:last[j - 1]]
                word_at = np.append(first[i:j], last[j - 1]) - first[i]
                families.append(((w & _U64(BUCKETS - 1)).astype(np.int64) + 2 * BUCKETS, word_at))
                pairs = mix(w[:-1] + mix(w[1:] + _U64(3))) if len(w) > 1 else w[:0]
            within = np.ones(len(pairs), bool)
            within[word_at[1:-1] - 1] = False
            places = np.flatnonzero(within)
            families.append(((pairs[places] & _U64(BUCKETS - 1)).astype(np.int64) + 3 * BUCKETS, np.append(np.searchsorted(places, word_at[:-1]), len(places))))
            yield slice(i, j), families, self.shares(raw, families[0], w, word_at)
            i = j

    def shares(self, raw: np.ndarray, byte_family, words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
        n = np.diff(word_at)
        values, at = byte_family
        size = np.maximum(np.diff(at), 1)[:, None]
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, owner))
        fresh = np.ones(len(words), np.int64)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = sums(fresh, word_at) / np.maximum(n, 1)
        kind = sums(self.kinds[values], at) / size
        return np.column_stack([kind, distinct, np.log1p(n) / 4, np.log1p(size[:, 0] / np.maximum(n, 1)) / 4])


def segment_softmax(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of the passages of each document (all documents have some)."""
    bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
    e = np.exp(q - np.maximum.reduceat(q, at[:-1])[bag])
    return e / np.add.reduceat(e, at[:-1])[bag]


def attend(h: np.ndarray, at: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(attention weight of each passage, logit of each document); all documents have passages."""
    q = (np.tanh(h @ m["v"].T) / (1 + np.exp(-(h @ m["u"].T)))) @ m["w"]
    a = segment_softmax(q, at)
    return a, np.add.reduceat(a[:, None] * h, at[:-1], axis=0) @ m["c"] + m["b"]


def adam(parameters: dict, gradient, steps: int, rate: float) -> dict:
    m = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in parameters.items()}
    for t in range(1, steps + 1):
        for k, g in gradient(parameters).items():
            a, b = m[k] = 0.9 * m[k][0] + 0.1 * g, 0.999 * m[k][1] + 0.001 * g * g
            parameters[k] = parameters[k] - rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return parameters


def fit_scores(shares: tuple, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """A score for every bucket: logistic regression of the passages' document labels on n-gram shares."""
    rows, cols, vals = shares
    n = len(y)

    def gradient(p):
        z = np.bincount(rows, weights=vals * p["s"][cols], minlength=n) + p["b"]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        return {"s": np.bincount(cols, weights=vals * error[rows], minlength=FAMILIES * BUCKETS) + 1e-6 * p["s"], "b": error.sum()}

    return adam({"s": np.zeros(FAMILIES * BUCKETS), "b": np.zeros(())}, gradient, steps, 0.5)["s"]


def fit_attention(h: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300) -> dict:
    """V, U, w of the gated attention and the logistic layer c, b, from document labels by the whole gradient."""
    bag = np.repeat(np.arange(len(y)), np.diff(at))
    draw = (random_u64(2 * GATE * h.shape[1] + GATE, 53) / 2.0 ** 64 - 0.5) * 0.6
    size = GATE * h.shape[1]
    start = {"v": draw[:size].reshape(GATE, -1), "u": draw[size:2 * size].reshape(GATE, -1), "w": draw[2 * size:], "c": np.zeros(h.shape[1]), "b": np.zeros(())}

    def gradient(p):
        t, s = np.tanh(h @ p["v"].T), 1 / (1 + np.exp(-(h @ p["u"].T)))
        a = segment_softmax((t * s) @ p["w"], at)
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        error = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30))) - y) * weight
        of_weight = (h @ p["c"]) * error[bag]
        of_q = a * (of_weight - np.add.reduceat(a * of_weight, at[:-1])[bag])
        of_gate = of_q[:, None] * p["w"]
        out = {"v": (of_gate * s * (1 - t * t)).T @ h, "u": (of_gate * t * s * (1 - s)).T @ h, "w": (t * s).T @ of_q, "c": z.T @ error}
        return {k: g + 1e-3 * p[k] for k, g in out.items()} | {"b": error.sum()}

    return adam(start, gradient, steps, 0.05)


def encodings(families: list, shares: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The vectors of passages before they are scaled."""
    means = [sums(scores[bucket], at) / np.maximum(np.diff(at), 1) for bucket, at in families]
    return np.column_stack([*means, shares])


def fit(texts: pa.Array, labels: np.ndarray, share: float | None) -> dict:
    """The model from texts and their labels 0 and 1."""
    share = 0.0 if share is None else float(share)
    if not len(labels) or labels.min() == labels.max():
        return {"scores": None, "empty": share}
    encoder = Encoder()
    order = np.argsort(np.arange(len(labels)) % 7, kind="stable")  # labels and texts in every part alike
    data, offsets = text_bytes(texts.take(pa.array(order)))
    y = labels[order].astype(np.float64)
    at, kept, rows, cols, vals = [np.zeros(1, np.int64)], [], [], [], []
    total = 0
    for i, j in runs(offsets, SLICE_BYTES):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        own_at = encoder.passages(part, own)[4]
        for where, families, shares in encoder.slices(part, own):
            kept.append((families, shares))
            for bucket, bounds in families:
                count = np.diff(bounds)
                row = np.repeat(np.arange(where.start, where.stop) + total, count)
                pair, times = np.unique(row * np.int64(FAMILIES * BUCKETS) + bucket, return_counts=True)
                r = pair // (FAMILIES * BUCKETS)
                rows.append(r)
                cols.append(pair % (FAMILIES * BUCKETS))
                vals.append(times / count[r - total - where.start])
        at.append(own_at[1:] + total)
        total += int(own_at[-1])
    at = np.concatenate(at)
    filled = np.diff(at) > 0
    empty = float(y[~filled].mean()) if (~filled).any() else 0.0
    bag = np.repeat(np.arange(len(y)), np.diff(at))
    if len(set(y[filled])) < 2:
        return {"scores": None, "empty": share}
    rows, cols, vals = map(np.concatenate, (rows, cols, vals))
    doc = np.arange(len(y))
    teaches = (doc % 2 == 0) if len(set(y[filled & (doc % 2 == 0)])) == 2 and len(set(y[filled & (doc % 2 == 1)])) == 2 else np.ones(len(y), bool)
    other = ~teaches if not teaches.all() else teaches
    mine = np.flatnonzero(teaches[bag])
    number = np.full(total, -1)
    number[mine] = np.arange(len(mine))
    use = number[rows] >= 0
    per = (balanced(np.where(teaches & filled, y, -1.0)) / np.maximum(np.diff(at), 1))[bag][mine]
    scores = fit_scores((number[rows[use]], cols[use], vals[use]), y[bag][mine], per)
    h = np.concatenate([encodings(f, s, scores) for f, s in kept])
    docs = np.flatnonzero(other & filled)
    h_docs = np.concatenate([h[at[d]:at[d + 1]] for d in docs])
    mean, scale = h_docs.mean(0), h_docs.std(0) + 1e-6
    h = np.clip((h - mean) / scale, -6, 6)

    def of(numbers):
        return np.concatenate([h[at[d]:at[d + 1]] for d in numbers]), np.append(0, np.cumsum(np.diff(at)[numbers]))

    held = docs[np.arange(len(docs)) % 5 == 4]
    rest = docs[np.arange(len(docs)) % 5 != 4]
    if min((y[held] == 0).sum(), (y[held] == 1).sum()) < HELD:
        held = rest = docs
    model = fit_attention(*of(rest), y[rest], balanced(y[rest]))
    _, z = attend(*of(held), model)
    a, b = platt(z, y[held], share)
    return {**model, "scores": scores, "mean": mean, "scale": scale, "slope": a, "shift": b, "empty": empty}


def scan(texts: pa.Array, model: dict) -> dict[str, np.ndarray]:
    """Of each text: score, number of passages, the passage of the largest attention weight and that weight."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = {"score": np.full(n, model["empty"]), "n_passages": np.zeros(n, np.int64), "top_passage": np.full(n, -1, np.int64), "top_weight": np.zeros(n)}
    encoder = Encoder()
    for i, j in runs(offsets, SLICE_BYTES):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        at = encoder.passages(part, own)[4]
        count = np.diff(at)
        out["n_passages"][i:j] = count
        filled = np.flatnonzero(count)
        if model["scores"] is None or not len(filled):
            continue
        h = np.concatenate([encodings(f, s, model["scores"]) for _, f, s in encoder.slices(part, own)])
        h = np.clip((h - model["mean"]) / model["scale"], -6, 6)
        bounds = np.append(at[filled], at[-1])
        weight, z = attend(h, bounds, model)
        weight = np.round(weight, 9)  # the last bits depend on what is multiplied along with a text
        out["score"][i + filled] = np.round(1 / (1 + np.exp(-np.clip(model["slope"] * z + model["shift"], -30, 30))), 9)
        best = np.maximum.reduceat(weight, bounds[:-1])
        spots = np.flatnonzero(weight == np.repeat(best, np.diff(bounds)))
        first = spots[np.searchsorted(spots, bounds[:-1])]
        out["top_passage"][i + filled], out["top_weight"][i + filled] = first - bounds[:-1], best
    return out


STRUCT = "struct<score:double,n_passages:long,top_passage:long,top_weight:double>"


def scored(text: Column, model: dict) -> Column:
    """A struct of score, n_passages, top_passage (-1 without passages) and top_weight for a text column."""
    @F.arrow_udf(STRUCT)
    def score(texts: pa.Array) -> pa.Array:
        found = scan(texts, model)
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))
    return score(text)


def fit_on(documents: DataFrame, labels: DataFrame, column: str = "quality") -> dict:
    """The model from the labels that may be learned from: crc32(doc_id) mod 4 other than 2."""
    rows, share = labelled_sample(documents, labels, column, SAMPLE_PER_LABEL, 12, crc_mod(F.col("doc_id"), 4) != 2)
    return fit(rows["text"].combine_chunks(), np.asarray(rows["y"]), share)


def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit_on(documents, read(spark, sf_dir, "labels"))
    found = bounded_batches(documents.select("doc_id", "text")).select("doc_id", scored(F.col("text"), model).alias("found"))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "found.score",
                        (F.col("found.score") >= PREDICT_AT).cast("int").alias("predicted"), "found.n_passages", "found.top_passage", "found.top_weight")
