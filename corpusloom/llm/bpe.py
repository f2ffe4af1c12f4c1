"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes is zero modulo `CHUNK_BYTES`, so equal passages give equal
chunks wherever they stand. Within a worker each distinct chunk is encoded once (a bounded table, emptied when
full, so memory does not grow) and its ids are reused in all documents. A chunk's ids hold only between the first
and the last point in it where the pre-tokeniser must break whatever surrounds them: a space between two
characters that are not white space. What lies outside, the end of one chunk and the start of the next, is joined
and encoded again; a join that meets no such point grows into the next chunk until it does, so ids agree exactly
with those of the whole text.

The vocabulary file is read on the driver and travels with the job. Pieces of Latin letters, digits and ASCII go to
the byte-pair merges directly; a piece with any other character goes to the tokenizers library itself, whose
Unicode tables decide there.

Defined results: a null text is encoded as the empty text: no ids, decoded to the empty text. Special-token strings
in a text become their id, as the library does. Ids that are no whole UTF-8 decode with replacement characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import random_u64, runs, text_bytes
from .tables import bounded_batches, read

VOCABULARY = "byte_bpe_50k.json"
CHUNK_BYTES = 1024  # mean distance of cuts
CACHE_CHUNKS = 8_192
PATTERN = public_tokenizers.PATTERN


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others by code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding and decoding need of a byte-level BPE file whose ids follow its merges."""
    text = open(path, encoding="utf-8").read()
    file, back = json.loads(text), byte_characters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in special}
    for i, merge in enumerate(file["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if vocabulary[left + right] != 256 + i:
            raise ValueError(f"ids of {path} don't follow its merges")
    return {"file": text, "ranks": {bytes(back[c] for c in t): i for t, i in vocabulary.items()}, "special": special}


class Encoder:
    """Encodes texts by reusing the ids of equal chunks."""

    def __init__(self, vocabulary: dict, chunk_bytes: int = CHUNK_BYTES, cache_chunks: int = CACHE_CHUNKS):
        import tiktoken

        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=vocabulary["ranks"], special_tokens=vocabulary["special"])
        self.file, self.whole = vocabulary["file"], None
        self.known = re.compile("[\x00-ɏ‐-‧€™]*").fullmatch
        self.safe = re.compile(r"(?<=\S) (?=\S)")
        self.mask, self.table = np.uint32(chunk_bytes - 1), random_u64(256, 31).astype(np.uint32)
        self.limit, self.cache = cache_chunks, {}
        self.reused = self.encoded = 0

    def ids(self, text: str) -> np.ndarray:
        """Ids of a piece that stands alone."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.known(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions where a chunk begins: the rolling hash of the 16 bytes before is zero, at a whole character."""
        h = self.table[data]
        for width in (1, 2, 4, 8):
            older = np.zeros_like(h)
            older[width:] = h[:-width] << np.uint32(width) if len(h) > width else h[:0]
            h = h + older
        at = np.flatnonzero((h >> np.uint32(7)) & self.mask == 0) + 1
        at = at[at < len(data)]
        for _ in range(3):  # forward to the next character
            inside = (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80
            at = at + inside
        return np.unique(at[at < len(data)])

    def chunk(self, raw: bytes) -> tuple[str, np.ndarray, str] | None:
        """(text before the first safe point, ids between it and the last, text behind); None without such points."""
        found = self.cache.get(raw, self)
        if found is not self:
            self.reused += 1
            return found
        text = raw.decode("utf-8")
        points = [m.start() for m in self.safe.finditer(text)]
        found = (text[:points[0]], self.ids(text[points[0]:points[-1]]), text[points[-1]:]) if len(points) > 1 else None
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[raw] = found
        self.encoded += 1
        return found

    def document(self, raw: bytes, cuts: np.ndarray) -> list[np.ndarray]:
        """Parts of the ids of one text that is cut at `cuts`."""
        edges = [0, *cuts.tolist(), len(raw)]
        parts, open_ = [], ""
        for lo, hi in zip(edges, edges[1:]):
            piece = raw[lo:hi]
            known = self.chunk(piece)
            if known is None:
                open_ += piece.decode("utf-8")
                continue
            head, inner, tail = known
            parts += [self.ids(open_ + head), inner]
            open_ = tail
        return [*parts, self.ids(open_)]

    def encode(self, texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        blocks, counts = [np.zeros(0, np.int32)], np.zeros(len(offsets), np.int64)
        for i, j in runs(offsets):
            lo, parts = offsets[i], [np.zeros(0, np.uint32)]
            block = data[lo:offsets[j]]
            raw, cuts = block.tobytes(), self.cuts(block)
            for d in range(i, j):
                s, e = offsets[d] - lo, offsets[d + 1] - lo
                own = cuts[np.searchsorted(cuts, s, "right"):np.searchsorted(cuts, e, "left")] - s
                got = self.document(raw[s:e], own)
                counts[d + 1] = sum(map(len, got))
                parts += got
            blocks.append(np.concatenate(parts).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate(blocks)))


class Decoder:
    """Turns ids back into text, a batch at a time."""

    def __init__(self, vocabulary: dict):
        pieces = {i: t for t, i in vocabulary["ranks"].items()} | {i: t.encode() for t, i in vocabulary["special"].items()}
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.array([len(p) for p in ordered], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        self.flat = np.frombuffer(b"".join(ordered), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: pa.Array) -> pa.Array:
        if ids.null_count:
            ids = ids.fill_null([])
        at, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values, dtype=np.int64)
        out = []
        for i, j in runs(at, 1 << 17):
            sizes = np.append(0, np.cumsum(self.sizes[flat[at[i]:at[j]]]))[at[i:j + 1] - at[i]]
            raw = self.bytes_of(flat[at[i]:at[j]]).tobytes()
            out += [raw[s:e].decode("utf-8", "replace") for s, e in zip(sizes, sizes[1:])]
        return pa.array(out, pa.string())


def encode(text: Column, vocabulary: dict) -> Column:
    """The ids of a text column."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            yield encoder.encode(texts)

    return run(text)


def decode(ids: Column, vocabulary: dict) -> Column:
    """The text of a column of ids."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(vocabulary)
        for ids in batches:
            yield decoder.decode(ids)

    return run(ids)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    vocabulary = load(path or public_tokenizers.path(VOCABULARY))
    encoded = bounded_batches(documents).select("doc_id", encode(F.col("text"), vocabulary).alias("ids"))
    both = encoded.withColumn("decoded", decode(F.col("ids"), vocabulary))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
