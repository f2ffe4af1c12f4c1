"""Cross-tokenizer alignment by interval coalescing: which tokens of A and B cover the same bytes, and how often.

A text (with a space before it) is encoded by a byte-level vocabulary A and a sentence-piece vocabulary B. All
tokens of both lie on one axis of bytes: sorted by start (lexsort), with a running maximum of ends, a group of tokens
breaks where a start reaches that maximum, which is where tokens of both end. Within a group every A token
expands to the B tokens that its bytes overlap: the links.

Neither vocabulary joins anything across a space between two characters that are not white space, so texts are
cut there and each different piece is encoded and aligned once a task (a table of pieces, emptied when it holds
`PIECES`); documents are sums over their pieces. `load` checks that property of B's vocabulary.

1. One pass counts the links of every id pair: pieces' links times the pieces' occurrences, added up in a task,
   then by a shuffle of (a, b, n).
2. A second pass needs the counts beside the documents. The `HOT_PAIRS` most frequent pairs at most (a threshold read
   off a histogram of counts) go to the tasks with the job, 17 bytes each; the other pairs of a text, if there are any,
   are joined to their counts by a shuffle, one row for each different text and pair, and added.

Defined results: a text that is null, empty, or whose tokens' bytes don't give the text back (B cannot tell U+2581 from
a space) has no tokens: zeros and an empty groups_sha256; it adds to no count. Special tokens' strings are plain
text. Repeated rows count each time and get the same results. An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .arrow_text import sums
from .bpe import byte_characters
from .tables import bounded_batches, read

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECES = 400_000  # pieces held in a task
STEP, LINE = 16_384, 128  # pieces aligned at a time, and encoded in one text
FLUSH = 400_000  # pair counters held in a task
HOT_PAIRS = 1 << 19
PLAIN = "[\x00-ɏ‐-‧€™]*"
SPACE = "▁"  # stands for a space in B's pieces

PAIRS = "a int, b int, n long"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
          "rest_a array<int>, rest_b array<int>, rest_n array<int>")


def load(a_path: str, b_path: str) -> dict:
    """Both vocabulary files' contents, which travel with the job, and the bytes of every token."""
    import json

    import sentencepiece

    a_file, b_file = open(a_path, encoding="utf-8").read(), open(b_path, "rb").read()
    back, model = byte_characters(), json.loads(a_file)
    a_ids = model["model"]["vocab"] | {t["content"]: t["id"] for t in model["added_tokens"]}
    a_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in a_ids.items()}
    b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError(f"{b_path} has pieces that go across a word's start")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {a_bytes[i]: i for t, i in a_ids.items() if t not in special}
    return {"a": a_file, "b": b_file, "a_ranks": ranks, "a_bytes": [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], "b_bytes": b_bytes}


class Tokens:
    """Bytes of a vocabulary's tokens, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.append(0, np.cumsum(self.size))[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def give(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the tokens' bytes are `raw`."""
        n = self.size[ids]
        ends = np.cumsum(n)
        if (ends[-1] if len(ends) else 0) != len(raw):
            return False
        return bool((self.flat[np.repeat(self.first[ids] - (ends - n), n) + np.arange(len(raw))] == raw).all())


class Spans:
    """Tokens of pieces laid end to end on one axis of bytes."""

    def __init__(self, ids: list[np.ndarray], count: list[np.ndarray], size_of: np.ndarray):
        self.ids, self.count = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ids, count))
        self.size = size_of[self.ids]

    def place(self, base: np.ndarray) -> None:
        """Start and end bytes, where piece k begins at base[k]."""
        before = np.append(0, np.cumsum(self.size))
        first = before[np.cumsum(self.count) - self.count]
        self.start = before[:-1] + np.repeat(base - first, self.count)
        self.end = self.start + self.size


def coalesced(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of a and of b, numbered from 0 along the axis: all tokens sorted by start; a group begins
    where a start reaches the running maximum of the ends before it."""
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(a.start)], group[len(a.start):]


def overlaps(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) of all that share a byte: each token of a expands to a range of b."""
    first = np.searchsorted(b.end, a.start, "right")
    count = np.searchsorted(b.start, a.end, "left") - first
    left = np.repeat(np.arange(len(a.start)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + first[left]


class Aligner:
    """Aligns each different piece once. Pieces are encoded in lines of many, which neither vocabulary joins."""

    def __init__(self, vocabularies: dict, pieces: int = PIECES):
        import os

        import sentencepiece
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies["a"])
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        # the same merges on text whose character classes every table of Unicode agrees on
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabularies["a_ranks"], special_tokens={})
        self.plain = re.compile(PLAIN).fullmatch
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies["b"])
        self.tokens = [Tokens(vocabularies[f"{side}_bytes"]) for side in "ab"]
        most = max(len(t.size) for t in self.tokens)
        # id and the sign behind it, in cells of one width
        self.names = {sign: np.array([f"{i}{sign}".encode() for i in range(most)], f"S{len(str(most)) + 1}") for sign in ",|;"}
        self.width = np.char.str_len(self.names[","])
        self.cuts = re.compile(r"(?<=\S) (?=\S)").split
        self.limit = pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []  # what the piece adds to its text's groups
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, fits
        self.pair_at = np.zeros(1, np.int64)
        self.pair_a = self.pair_b = np.zeros(0, np.int32)

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece of each place, offsets by text); pieces are numbers into this object's lists."""
        if len(self.known) > self.limit:
            self.clear()
        known = self.known
        own = [self.cuts(text) if text else [] for text in texts]
        fresh = [p for p in dict.fromkeys(chain.from_iterable(own)) if p not in known]
        # only pieces without white space at their ends, which a text's first and last may have, may stand in one line
        solid = [p for p in fresh if not (p[0].isspace() or p[-1].isspace())]
        for group, line in ((solid, LINE), ([p for p in fresh if p[0].isspace() or p[-1].isspace()], 1)):
            for k in range(0, len(group), STEP):
                part = group[k:k + STEP]
                known.update(zip(part, range(len(known), len(known) + len(part))))
                self.align(part, line)
        counts = np.array([0, *map(len, own)])
        return np.fromiter(map(known.__getitem__, chain.from_iterable(own)), np.int64, int(counts.sum())), np.cumsum(counts)

    def encoded(self, text: str) -> np.ndarray:
        """A's ids of a text."""
        if self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def lines(self, fresh: list[str], step: int) -> Iterator[tuple[int, list[np.ndarray] | None, np.ndarray]]:
        """For runs of pieces: (how many, the ids of both sides or None, bytes of each piece). None stands for one piece that a
        side doesn't give back; a longer run that has such a piece is taken apart."""
        runs_of = [fresh[k:k + step] for k in range(0, len(fresh), step)]
        # B puts the space before a text by itself
        texts = [" ".join(x) for x in runs_of]
        for run, text, b in zip(runs_of, texts, self.b.encode(texts, num_threads=1)):
            size = np.array([len(p.encode()) + 1 for p in run], np.int64)
            raw = np.frombuffer(f" {text}".encode(), np.uint8)
            ids = [self.encoded(f" {text}"), np.array(b, np.int64)]
            if all(side.give(x, raw) for side, x in zip(self.tokens, ids)):
                yield len(run), ids, size
            elif len(run) > 1:
                yield from self.lines(run, 1)
            else:
                yield 1, None, size

    def align(self, fresh: list[str], line: int) -> None:
        """Adds pieces. Each stands without the space before it."""
        ids, count, fits, sizes = ([], []), ([], []), [], []
        for n, both, size in self.lines(fresh, line):
            fits.append(np.full(n, both is not None))
            sizes.append(size)
            for side in (0, 1):
                if both is None:
                    count[side].append(np.zeros(1, np.int64))
                    continue
                last = np.searchsorted(np.cumsum(self.tokens[side].size[both[side]]), np.cumsum(size))
                count[side].append(np.diff(last, prepend=-1))
                ids[side].append(both[side])
        fits, sizes = np.concatenate(fits), np.concatenate(sizes)
        a, b = (Spans(ids[side], count[side], self.tokens[side].size) for side in (0, 1))
        base = np.cumsum(sizes) - sizes
        for side in (a, b):
            side.place(base)
        group_a, group_b = coalesced(a, b)
        total = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        # places of tokens written group by group, A's before B's
        before = np.append(0, np.cumsum(in_a + in_b))[:-1]
        first_a, first_b = np.append(0, np.cumsum(in_a))[:-1], np.append(0, np.cumsum(in_b))[:-1]
        at_a = before[group_a] + np.arange(len(group_a)) - first_a[group_a]
        at_b = before[group_b] + in_a[group_b] + np.arange(len(group_b)) - first_b[group_b]
        written = np.empty(len(at_a) + len(at_b), self.names[","].dtype)
        written[at_a], written[at_b] = self.names[","][a.ids], self.names[","][b.ids]
        last_a, last_b = first_a + in_a - 1, first_b + in_b - 1
        written[at_a[last_a]], written[at_b[last_b]] = self.names["|"][a.ids[last_a]], self.names[";"][b.ids[last_b]]
        length = np.empty(len(written), np.int64)
        length[at_a], length[at_b] = self.width[a.ids], self.width[b.ids]
        flat, ends = written.tobytes().translate(None, b"\0"), np.append(0, np.cumsum(length))[np.append(0, np.cumsum(a.count + b.count))].tolist()
        self.groups += [flat[s:e - 1] for s, e in zip(ends, ends[1:])]
        left, right = overlaps(a, b)
        owner = np.repeat(np.arange(len(fresh)), a.count)
        links = np.bincount(owner[left], minlength=len(fresh))
        groups = np.bincount(owner[first_a], minlength=len(fresh)) if total else np.zeros(len(fresh), np.int64)
        self.numbers = np.concatenate([self.numbers, np.stack([a.count, b.count, groups, links, fits], 1)])
        self.pair_a = np.concatenate([self.pair_a, a.ids[left].astype(np.int32)])
        self.pair_b = np.concatenate([self.pair_b, b.ids[right].astype(np.int32)])
        self.pair_at = np.append(self.pair_at, self.pair_at[-1] + np.cumsum(links))

    def fitting(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that have pieces, all of which both vocabularies give back."""
        return (np.diff(at) > 0) & (sums(self.numbers[codes, 4], at) == np.diff(at))

    def links(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `codes`, link) of every link of the pieces."""
        count = self.numbers[codes, 3]
        place = np.repeat(np.arange(len(codes)), count)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + self.pair_at[codes][place]


def pair_counts(documents: DataFrame, vocabularies: dict) -> DataFrame:
    """(a, b, n): links of every id pair in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held = Aligner(vocabularies), Counter()

        def out() -> pa.RecordBatch:
            keys = np.fromiter(held.keys(), np.int64, len(held))
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                                               pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["a", "b", "n"])

        for batch in batches:
            codes, at = aligner.pieces(batch["text"].to_pylist())
            codes = codes[np.repeat(aligner.fitting(codes, at), np.diff(at))]
            pieces, times = np.unique(codes, return_counts=True)
            place, link = aligner.links(pieces)
            key = aligner.pair_a[link].astype(np.int64) << 32 | aligner.pair_b[link]
            pairs, where = np.unique(key, return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, where, times[place])
            held.update(dict(zip(pairs.tolist(), n.tolist())))
            if len(held) > FLUSH:
                yield out()
                held = Counter()
        yield out()

    return bounded_batches(documents.select("text")).mapInArrow(run, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def hottest(counted: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """At most `most` of the most frequent pairs, and whether these are all. The threshold is the lowest step of a
    histogram (eight steps a doubling, 512 rows at most) above which no more than `most` pairs lie."""
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted((r.step, r.pairs) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect())
    kept, least = 0, None
    for k, pairs in reversed(histogram):
        if kept + pairs > most:
            break
        kept, least = kept + pairs, k
    hot = counted.where(step >= F.lit(least)) if least is not None else counted.limit(0)
    return hot.toArrow(), kept == sum(pairs for _, pairs in histogram)


def scored(documents: DataFrame, vocabularies: dict, hot: pa.Table) -> DataFrame:
    """`RESULT` of every row: sums over the hot pairs, and the text's other pairs with their links."""
    keys = np.asarray(hot["a"]).astype(np.int64) << 32 | np.asarray(hot["b"])
    order = np.argsort(keys)
    keys, counts, best = keys[order], np.asarray(hot["n"])[order], np.asarray(hot["best"]).astype(np.int64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabularies)
        for batch in batches:
            codes, at = aligner.pieces(batch["text"].to_pylist())
            fits = aligner.fitting(codes, at)
            pieces, own = np.unique(codes, return_inverse=True)
            place, link = aligner.links(pieces)
            key = aligner.pair_a[link].astype(np.int64) << 32 | aligner.pair_b[link]
            where = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[where] == key if len(keys) else np.zeros(len(key), bool)
            of_piece = np.zeros((len(pieces), 2), np.int64)
            for c, values in enumerate((best, counts)):
                np.add.at(of_piece[:, c], place[found], values[where[found]])
            numbers = np.concatenate([aligner.numbers[codes, :4], of_piece[own]], 1)
            numbers = sums(numbers, at) * fits[:, None]
            digests, groups = [], aligner.groups
            for ok, s, e in zip(fits, at.tolist(), at[1:].tolist()):
                digests.append(hashlib.sha256(b";".join([groups[k] for k in codes[s:e].tolist()])).hexdigest() if ok else "")
            rest = [[], [], []]
            rest_at = np.zeros(len(fits) + 1, np.int64)
            if not found.all():
                missing = np.bincount(place[~found], minlength=len(pieces))
                begin = np.cumsum(missing) - missing
                unknown = key[~found]  # by piece
                for d in np.flatnonzero(fits):
                    mine, times = np.unique(own[at[d]:at[d + 1]], return_counts=True)
                    count = missing[mine]
                    each = np.repeat(np.arange(len(mine)), count)
                    lines = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + begin[mine][each]
                    pairs, at_pair = np.unique(unknown[lines], return_inverse=True)
                    rest_at[d + 1] = len(pairs)
                    rest[0].append(pairs >> 32)
                    rest[1].append(pairs & 0xFFFFFFFF)
                    rest[2].append(np.bincount(at_pair, weights=times[each], minlength=len(pairs)))
            offsets = pa.array(np.cumsum(rest_at), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*r, np.zeros(0)]).astype(np.int32))) for r in rest]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *[pa.array(numbers[:, c]) for c in range(6)], pa.array(digests, pa.string()), *lists],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest_a", "rest_b", "rest_n"])

    return bounded_batches(documents.select("doc_id", "text")).mapInArrow(run, RESULT)


def alignment(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    vocabularies = load(a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE))
    counted = cut(pair_counts(documents, vocabularies))
    top = counted.groupBy("b").agg(F.max("n").alias("most"))
    counted = cut(counted.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    hot, all_hot = hottest(counted, hot_pairs)
    found, names = scored(documents, vocabularies, hot), ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if all_hot:
        return found.select(names)
    table = cut(found)
    some = F.size("rest_a") > 0
    # equal digests are equal tokens, so other pairs are looked up once for each different text
    texts = table.where(some).groupBy("groups_sha256").agg(F.first(F.arrays_zip("rest_a", "rest_b", "rest_n")).alias("rest"))
    lines = texts.select("groups_sha256", F.inline("rest")).withColumnsRenamed({"rest_a": "a", "rest_b": "b", "rest_n": "times"})
    more = (lines.join(counted, ["a", "b"]).groupBy("groups_sha256")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    joined = table.where(some).join(cut(more), "groups_sha256")
    return table.where(~some).select(names).unionByName(joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), "groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"))
