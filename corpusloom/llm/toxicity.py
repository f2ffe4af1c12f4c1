"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the word classes of a clause and are composed into one machine:

* target marks what follows a person within `TARGET_REACH` words as aimed; a copula starts the reach anew;
* negation marks what follows within `NEGATION_REACH` words as denied;
* reported speech, and talk about a word as a word, marks the rest of the clause as reported;
* threat makes a match of subject, intent, verb and object: "I will kill you", "ich werde dich töten". A verb without
  them is an ordinary word, as in "they will kill the weeds";
* insult makes a match of a term that is aimed, or stands within `INSULT_REACH` words after another term. A term alone
  leaves as a mention, a weaker symbol with a weight of its own.

A clause scores the sum of its matches' term weights by the symbols and marks that leave the machine, a document the
calibrated sum over its clauses. Where labelled rows hold no case of a mark, its weight stays at a fixed one.

Words of all classes but insults are fixed lists. Insult terms are learned from
labelled rows: words, and stems of three to eight letters with several words, whose share among toxic documents is
`MIN_RATIO` times that among others and `MIN_SIGMAS` standard errors over chance; a word's own weight goes before its
stem's; at most `MAX_TERMS`, those of the largest weights, make the model. Copies and near copies, by sketches of their three-word shingles, count once, so a group of copies teaches
nothing; texts that only begin alike count each. The
rows are a bounded sample, `SAMPLE_PER_LABEL` of each label chosen by hash, long texts by a piece.
The weight of each mark and the calibration are a logistic regression on the same rows.

Whole texts are searched for terms by an Aho-Corasick automaton; only clauses that hold one are read by the machine,
as no other clause can match.

Defined results: null and empty texts have no clause and get the score of no evidence, under the threshold. Without
labels the fixed insult words apply with fixed weights. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, random_u64, shingles, text_bytes
from .neardup import Forest
from .tables import bounded_batches, crc_mod, labelled_sample, read

SAMPLE_PER_LABEL = 3_000
PIECE_CHARS = 32_768  # of a text: a toxic one may hold a single toxic clause
MIN_DOCUMENTS, MIN_RATIO, MIN_SIGMAS = 4, 8.0, 5.0
STEM_WORDS, STEM_SIZES = 3, (3, 4, 5, 6, 7, 8)
MAX_TERMS = 4_000
BANDS, ROWS, COPY_SHARE = 20, 4, 0.7  # of a sketch; copies agree in such a share of its minima
TOXIC_AT = 0.3
TARGET_REACH, NEGATION_REACH, INSULT_REACH, OBJECT_REACH = 6, 3, 3, 2  # words

# Fixed word lists (English, German, French, Spanish).
TARGETS = "you your yourself u he she they him her them you're he's she's they're du dein ihr sie tu vous ton votre tú usted ustedes vosotros".split()
OBLIQUES = "dich dir euch te toi ti os".split()  # persons that may be a verb's object before it
COPULAS = "are is am was were be been being r bist seid ist sind war es est êtes sont eres sois son".split()
NEGATIONS = "not no never none isn't aren't don't won't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = """said says say wrote writes called reported quoted according claims word words term terms phrase sagte sagt schrieb laut wort begriff
dit disait écrit selon mot terme dijo dice escribió según palabra término""".split()
SUBJECTS = "i we i'm we're someone somebody ich wir jemand je nous yo nosotros alguien".split()
INTENTS = "will shall gonna going must should werde werden wird vais va vont allons".split()
PLEDGES = "i'll we'll he'll she'll they'll voy vamos".split()  # subject and intent in one word
THREATS = "kill murder hurt destroy strangle stab töten umbringen vernichten tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron scum imbecile stupid worthless pathetic disgusting".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[^.,;:!?\n]+")

# symbols of the machine: classes of words, and marked matches
OTHER, TARGET, OBLIQUE, COPULA, NEGATION, REPORT, SUBJECT, INTENT, PLEDGE, INSULT, THREAT, MENTION = range(12)
CLASS = 15
MARKS = {"aimed": 16, "denied": 32, "reported": 64}
SOFT = MARKS["denied"] | MARKS["reported"]
WORD_CLASS = {w: c for c, words in ((TARGET, TARGETS), (OBLIQUE, OBLIQUES), (COPULA, COPULAS), (NEGATION, NEGATIONS), (REPORT, REPORTS),
                                    (SUBJECT, SUBJECTS), (INTENT, INTENTS), (PLEDGE, PLEDGES)) for w in words}


class Transducer:
    """Letter-to-letter transducer: (state, symbol) to (state, symbol); a missing arc copies its symbol and stays."""

    def __init__(self, start: int, arcs: dict[tuple[int, int], tuple[int, int]]):
        self.start, self.arcs = start, arcs

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))


def symbols() -> list[int]:
    marked = [m + sum(flags) for m in (INSULT, THREAT, MENTION) for flags in _subsets(list(MARKS.values()))]
    return [*range(INSULT), *marked]


def _subsets(items: list[int]) -> Iterator[list[int]]:
    for k in range(1 << len(items)):
        yield [x for i, x in enumerate(items) if k >> i & 1]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the output of `first`, which reads words without marks, to `second`, over their reachable pairs of states."""
    number = {(first.start, second.start): 0}
    todo, arcs = [(first.start, second.start)], {}
    while todo:
        p, q = pair = todo.pop()
        for s in range(MENTION):
            p2, middle = first.step(p, s)
            q2, out = second.step(q, middle)
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[pair], s] = (number[p2, q2], out)
    return Transducer(0, arcs)


def matches(mark: int, flags: set[int], reach: int | None, renew: int | None = None) -> Transducer:
    """Adds `mark` to matches after a symbol of `flags`: for `reach` words, or to the end of the clause. `renew` starts a
    running reach anew."""
    arcs, last = {}, reach or 1
    for state in range(last + 1):  # state: words left of the reach, 0 for none
        for s in symbols():
            then = state if reach is None else max(0, state - 1)
            out = s | mark if state and s & CLASS in (INSULT, THREAT) else s
            arcs[state, s] = (last if s in flags or state and s == renew else then, out)
    return Transducer(0, arcs)


def threat_transducer() -> Transducer:
    """A match of subject, intent, verb and object in this order, made at the object with the verb's marks; an oblique person
    before the verb is its object too, the match then is the verb. Other verbs leave as ordinary words."""
    arcs, start = {}, (0, False, 0, 0)  # 1 subject, 2 intent; an oblique person; words left for the object; marks of the verb
    todo, seen = [start], {start}
    while todo:
        phase, oblique, left, marks = state = todo.pop()
        for s in symbols():
            c = s & CLASS
            if c == THREAT and phase == 2:
                then, out = ((phase, oblique, 0, 0), THREAT | s & SOFT) if oblique else ((phase, oblique, OBJECT_REACH, s & SOFT), OTHER)
            elif c == THREAT:
                then, out = (phase, oblique, 0, 0), OTHER
            elif left and c in (TARGET, OBLIQUE):
                then, out = (phase, oblique, 0, 0), THREAT | marks
            else:
                now = 2 if c == PLEDGE or c == INTENT and phase else max(phase, int(c in (SUBJECT, TARGET)))
                then, out = (now, oblique or c == OBLIQUE, max(0, left - 1), marks if left > 1 else 0), s
            arcs[state, s] = (then, out)
            if then not in seen:
                seen.add(then)
                todo.append(then)
    return Transducer(start, arcs)


def insult_transducer() -> Transducer:
    """A term is a match if it is aimed or comes within `INSULT_REACH` words after another term, else a mention."""
    arcs = {}
    for state in range(INSULT_REACH + 1):  # words left since the last term
        for s in symbols():
            term = s & CLASS == INSULT
            alone = term and not state and not s & MARKS["aimed"]
            arcs[state, s] = (INSULT_REACH if term else max(0, state - 1), s - INSULT + MENTION if alone else s)
    return Transducer(0, arcs)


@cache
def grammar() -> Transducer:
    machine = matches(MARKS["aimed"], {TARGET, OBLIQUE}, TARGET_REACH, COPULA)
    machine = compose(machine, matches(MARKS["denied"], {NEGATION}, NEGATION_REACH))
    machine = compose(machine, matches(MARKS["reported"], {REPORT}, None))
    return compose(compose(machine, threat_transducer()), insult_transducer())


class Matcher:
    """Marks the matches of whole texts. terms: (term, is stem) to (class, weight)."""

    def __init__(self, terms: dict[tuple[str, bool], tuple[int, float]]):
        import ahocorasick

        self.terms, self.machine = terms, grammar()
        self.found = ahocorasick.Automaton()
        for term, stem in terms:
            self.found.add_word(term, term)
        if terms:
            self.found.make_automaton()
        self.stem_sizes = sorted({len(t) for t, stem in terms if stem})

    def term(self, word: str) -> tuple[int, float] | None:
        got = self.terms.get((word, False))
        for n in self.stem_sizes if got is None else ():
            if len(word) > n:
                got = self.terms.get((word[:n], True)) or got
        return got  # of the longest stem

    def clause(self, clause: str) -> list[tuple[int, float]]:
        """(marked match, weight) of each match of a clause, in order."""
        state, out, threat = self.machine.start, [], 0.0
        for m in WORD.finditer(clause):
            known = self.term(m[0])
            symbol = known[0] if known else WORD_CLASS.get(m[0], OTHER)
            state, mark = self.machine.step(state, symbol)
            if symbol == THREAT:
                threat = known[1]
            if mark & CLASS == THREAT:  # at the verb or at its object
                out.append((mark, threat))
            elif mark & CLASS in (INSULT, MENTION):
                out.append((mark, known[1]))
        return out

    def text(self, text: str) -> dict[int, float]:
        """Weight by mark over the clauses of a text."""
        total: dict[int, float] = defaultdict(float)
        if not text or not self.terms:
            return total
        lower = text.lower()
        ends = [end for end, _ in self.found.iter(lower)]
        k = 0
        for m in CLAUSE.finditer(lower) if ends else ():
            while k < len(ends) and ends[k] < m.start():
                k += 1
            if k == len(ends):
                break
            if ends[k] < m.end():
                for mark, weight in self.clause(m[0]):
                    total[mark] += weight
        return total


# Weights of `vector` before labels are seen, and of the bias.
WEIGHTS, BIAS = [1.0, 1.0, 1.0, 1.0, 0.2], -3.5


def vector(total: dict[int, float], length: int) -> list[float]:
    """Evidence of a text: what is said outright, in all and for its length, its insults, its threats, and what is denied or reported."""
    def of(*classes: int) -> float:
        return sum(w for m, w in total.items() if not m & SOFT and m & CLASS in classes)

    outright = of(INSULT, THREAT, MENTION)
    soft = sum(w for m, w in total.items() if m & SOFT)
    return [math.log1p(x) for x in (outright, 1000 * outright / (length + 500), of(INSULT), of(THREAT), soft)]


def originals(texts: list[str]) -> list[int]:
    """A number for each text, equal for copies and near copies."""
    words, forest = Words(17, True), Forest(list(range(len(texts))))
    n = BANDS * ROWS
    salt, odd = random_u64(n, 47).astype(np.uint32), random_u64(n, 53).astype(np.uint32) | np.uint32(1)
    first: dict[tuple, int] = {}
    sketches: list[np.ndarray | None] = []
    for k, text in enumerate(texts):
        data, offsets = text_bytes(pa.array([text], pa.string()))
        _, _, hashes, at = words.of(data, offsets)
        small = (np.unique(shingles(hashes, at, 3)[0]) >> np.uint64(20)).astype(np.uint32)
        sketches.append(((small[:, None] ^ salt) * odd).min(0) if len(small) else None)
        if (same := first.setdefault((-1, text), k)) != k:
            forest.join(same, k)
        for band in range(BANDS) if len(small) else ():
            other = first.setdefault((band, sketches[k][band * ROWS:(band + 1) * ROWS].tobytes()), k)
            if forest.root(other) != forest.root(k) and (sketches[other] == sketches[k]).mean() >= COPY_SHARE:
                forest.join(other, k)
    return [forest.root(k) for k in range(len(texts))]


def learn_terms(texts: list[str], labels: list[int]) -> dict[tuple[str, bool], tuple[int, float]]:
    """Insult words and stems with their weights, by the share of distinct documents that hold them."""
    holds: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    stems: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    forms: dict[str, set[str]] = defaultdict(set)
    seen: tuple[set, set] = (set(), set())
    for text, y, original in zip(texts, labels, originals(texts)):
        seen[y].add(original)
        for w in set(WORD.findall(text.lower())):
            holds[y][w].add(original)
            for n in STEM_SIZES:
                if len(w) > n:
                    stems[y][w[:n]].add(original)
                    if y:
                        forms[w[:n]].add(w)
    size = [len(o) + 1 for o in seen]

    def weight(found: tuple[dict, dict], key: str) -> float:
        yes, no = len(found[1].get(key, ())), len(found[0].get(key, ()))
        ratio = (yes / size[1]) / ((no + 0.5) / size[0])
        chance = (yes + no + 0.5) * size[1] / sum(size)
        sure = (yes - chance) / math.sqrt(chance) >= MIN_SIGMAS
        return math.log(ratio) if sure and yes >= MIN_DOCUMENTS and ratio >= MIN_RATIO else 0.0

    terms: dict[tuple[str, bool], tuple[int, float]] = {}
    good = {s: w for s in stems[1] if len(forms[s]) >= STEM_WORDS and (w := weight(stems, s))}
    for s, w in good.items():
        if w > max([0.0, *(good.get(s[:n], 0.0) for n in STEM_SIZES if n < len(s))]):  # no better than a shorter one: not needed
            terms[s, True] = (INSULT, w)
    for word in holds[1]:
        if w := weight(holds, word):
            terms[word, False] = (INSULT, w)
    top = sorted(terms, key=lambda t: (-terms[t][1], t))[:MAX_TERMS]
    return {t: (INSULT, min(3.0, terms[t][1] / 2)) for t in top}


def fit(texts: list[str], labels: list[int], prior: float | None) -> dict:
    """Terms, weights of the marks and calibration."""
    fixed = {(w, False): (INSULT, 1.0) for w in INSULTS} | {(w, False): (THREAT, 3.0) for w in THREATS}
    if len(set(labels)) < 2:
        return {"terms": fixed, "weights": WEIGHTS, "bias": BIAS}
    # terms from four fifths of the rows, the regression on all: a term that fits copies only meets rows without it
    part = [k for k in range(len(texts)) if k % 5]
    terms = {t: v for t, v in fixed.items() if v[0] == THREAT} | learn_terms([texts[k] for k in part], [labels[k] for k in part])
    matcher = Matcher(terms)
    x = np.array([[*vector(matcher.text(t), len(t)), 1.0] for t in texts])
    y = np.array(labels, float)
    before = np.array([*WEIGHTS, BIAS])
    w = before.copy()
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    prior = min(max(prior or 0.5, 1e-4), 1 - 1e-4)
    share = share * np.where(y == 1, 2 * prior, 2 * (1 - prior))
    ridge = 1e-3 * np.array([1, 1, 1, 1, 1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * (w - before)  # a mark that no row holds keeps its weight
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(hess, grad)
    return {"terms": terms, "weights": np.maximum(w[:-1], 0.0).tolist(), "bias": float(w[-1])}  # no match speaks for a text


def fit_on(documents: DataFrame, labels: DataFrame) -> dict:
    """The model from the rows that may be learned from: crc32(doc_id) mod 4 other than 2."""
    rows, share = labelled_sample(documents, labels, "toxic", SAMPLE_PER_LABEL, 3, crc_mod(F.col("doc_id"), 4) != 2, PIECE_CHARS)
    pairs = sorted(zip(rows["text"].to_pylist(), rows["y"].to_pylist()))
    return fit([t for t, _ in pairs], [y for _, y in pairs], share)


def scored(text: Column, model: dict) -> Column:
    """The score of a text column, 0 to 1."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher, weights, bias = Matcher(model["terms"]), model["weights"], model["bias"]
        for texts in batches:
            out = []
            for t in texts:
                text = t.as_py() or ""
                total = matcher.text(text)
                z = bias + (sum(a * b for a, b in zip(weights, vector(total, len(text)))) if total else 0.0)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.array(out, pa.float64())

    return run(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bounded_batches(read(spark, sf_dir, "documents"))
    model = fit_on(documents, read(spark, sf_dir, "labels"))
    rows = documents.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
