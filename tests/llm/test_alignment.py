import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from edge import clashing, edge, empty, rows_of

from corpusloom.llm import alignment
from corpusloom.llm.bpe import byte_characters

ODD = ["<|endoftext|> a <s> b </s><unk>", "  two  spaces ", " ", "\n", "tab\tline\n\n  end ", "▁ lower block", "a▁b", "naïve café ﬁ ①", "日本　語 é é",
       "x\x00y z", "\x85 next line   sep", "don't we'll 12345 6.7", "🙂 smile🙂🙂", "﻿bom", "a ​ b", "<0x41> A", "\r\n \r", "word " * 300, "\x1c \x1f y"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, libraries):
    """(id, first byte, last byte) of both sides of a whole text; None where the bytes don't give it back."""
    if not text:
        return None
    (a, b), back = libraries, byte_characters()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    raw = [[bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]],
           [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    out = []
    for side, pieces in zip(ids, raw):
        at, own = 0, []
        for i, piece in zip(side, pieces):
            own.append((i, at, at + len(piece)))
            at += len(piece)
        out.append(own)
    return out


def plain(rows, libraries):
    aligned = {t: tokens(t, libraries) for t in {t for _, t in rows}}
    links = {}
    for text, both in aligned.items():
        if both:  # every pair whose bytes overlap, by two cursors
            (a, b), k, links[text] = both, 0, []
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                j = k
                while j < len(b) and b[j][1] < e:
                    links[text].append((i, b[j][0]))
                    j += 1
    count = Counter(p for _, text in rows for p in links.get(text, ()))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, text in rows:
        both = aligned[text]
        if not both:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = both
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            sides = [",".join(str(i) for i, s, e in side if low <= s < end) for side in both] if len(a) < 3000 else None
            groups.append("|".join(sides) if sides else None)
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        own = links[text]
        out.append((doc_id, len(a), len(b), len(ends), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest))
    return out


def agree(df, rows, libraries):
    expected, found = plain(rows, libraries), [tuple(r) for r in df.collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:7])
    assert len(found) == len(expected)
    for got, want in zip(sorted(found, key=order), sorted(expected, key=order)):
        assert got[:7] == want[:7] and (want[7] is None or got[7] == want[7])


def test_equals_plain_alignment_of_whole_texts(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.union(odd).union(edge(spark).select("doc_id", "text"))
    rows = [tuple(r) for r in every.collect()]
    agree(alignment.alignment(every), rows, libraries)


def test_pairs_that_are_not_sent_along_are_joined(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.union(odd).union(edge(spark).select("doc_id", "text"))
    rows = [tuple(r) for r in every.collect()]
    for most in (0, 300):
        agree(alignment.alignment(every, hot_pairs=most), rows, libraries)


def test_pieces_equal_whole_texts(libraries):
    """Random texts of odd characters: the pieces' tokens are those of the whole text."""
    vocabularies = alignment.load(*map(public_tokenizers.path, (alignment.A_FILE, alignment.B_FILE)))
    aligner = alignment.Aligner(vocabularies, pieces=50)
    draw = random.Random(5)
    alphabet = list(" \n\t\r   ᠎​\x1c\x85") + ["  ", "a", "B", "the", "'s", "12", "é", "é", "日", "▁", "🙂", "ß", ".", "<s>", "!!", "ﬁ", "؀"]
    texts = ["".join(draw.choice(alphabet) if draw.random() < 0.7 else " " for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    for lo in range(0, len(texts), 50):
        batch = texts[lo:lo + 50]
        codes, at = aligner.pieces(batch)
        fits = aligner.fitting(codes, at)
        for d, text in enumerate(batch):
            want = tokens(text, libraries)
            assert bool(fits[d]) == (want is not None), repr(text)
            if want:
                own = codes[at[d]:at[d + 1]]
                assert aligner.numbers[own, :2].sum(0).tolist() == [len(want[0]), len(want[1])]
                written = b";".join(aligner.groups[k] for k in own).decode()
                assert [[int(i) for g in written.split(";") for i in g.split("|")[side].split(",")] for side in (0, 1)] == [[t[0] for t in side] for side in want]


def test_edges(spark):
    none = alignment.alignment(empty(spark))
    assert none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and none.count() == 0
    assert rows_of(alignment.alignment(clashing(spark))) == rows_of(alignment.alignment(edge(spark).repartition(5)))
