import numpy as np
import pytest
from edge import clashing, edge, rows_of

from corpusloom.llm import toxicity as tox

AIMED, DENIED, REPORTED = tox.MARKS["aimed"], tox.MARKS["denied"], tox.MARKS["reported"]


@pytest.fixture(scope="module")
def matcher():
    return tox.Matcher({("idiot", False): (tox.INSULT, 1.0), ("grum", True): (tox.INSULT, 2.0), ("hurt", False): (tox.THREAT, 2.0), ("töten", False): (tox.THREAT, 2.0)})


@pytest.mark.parametrize("clause,marks", [
    ("what an idiot", [tox.MENTION]), ("you are an idiot", [tox.INSULT | AIMED]), ("idiot is what you are", [tox.MENTION]),
    ("you are not an idiot", [tox.INSULT | AIMED | DENIED]), ("not that it matters to any idiot", [tox.MENTION]),
    ("she said idiot", [tox.INSULT | AIMED | REPORTED]), ("grumbler and grumpy", [tox.MENTION, tox.INSULT]), ("grum", []),
    ("grumbler of the town and an idiot", [tox.MENTION, tox.MENTION]), ("nothing here", []), ("idiotic", []),
    ("you were in all that time an idiot", [tox.INSULT | AIMED]), ("you went from here to the town where an idiot", [tox.MENTION]),
    ("the word idiot is listed", [tox.MENTION | REPORTED]),
    ("we hurt", []), ("they will hurt", []), ("they will hurt the weeds", []), ("they will hurt them", [tox.THREAT]),
    ("will this hurt you", []), ("i will not hurt you", [tox.THREAT | DENIED]), ("he said i will hurt you", [tox.THREAT | REPORTED]),
    ("i will hurt all of you", []), ("i will hurt all you idiot", [tox.THREAT, tox.INSULT | AIMED]),
    ("ich werde dich töten", [tox.THREAT]), ("te voy a töten", [tox.THREAT]), ("ich werde es töten", []), ("i'll töten him", [tox.THREAT]),
])
def test_marks_of_a_clause(matcher, clause, marks):
    assert [m for m, _ in matcher.clause(clause)] == marks


def test_a_threat_weighs_as_its_verb(matcher):
    assert matcher.clause("i will hurt you idiot") == [(tox.THREAT, 2.0), (tox.INSULT | AIMED, 1.0)]


def test_marks_end_with_the_clause(matcher):
    assert dict(matcher.text("You said so. Idiot! NOT me, IDIOT")) == {tox.MENTION: 2.0}
    assert not matcher.text("") and not matcher.text("idiotic grum words")


def test_composition_is_one_after_the_other():
    machines = [tox.matches(AIMED, {tox.TARGET, tox.OBLIQUE}, tox.TARGET_REACH, tox.COPULA), tox.matches(DENIED, {tox.NEGATION}, 3),
                tox.matches(REPORTED, {tox.REPORT}, None), tox.threat_transducer(), tox.insult_transducer()]
    import random
    rnd = random.Random(4)
    whole = tox.grammar()
    for _ in range(400):
        states, s, one, two = [m.start for m in machines], whole.start, [], []
        for _ in range(16):
            x = y = rnd.randrange(tox.MENTION)
            for k, m in enumerate(machines):
                states[k], y = m.step(states[k], y)
            s, joint = whole.step(s, x)
            one.append(y)
            two.append(joint)
        assert one == two


def test_threats_equal_a_plain_search(matcher):
    """The threat transducer against a search of each clause for its verb, what is before it and its object."""
    import random
    rnd = random.Random(6)
    for _ in range(3_000):
        clause = [rnd.choice(["i", "will", "voy", "hurt", "you", "dich", "weeds", "the", "them"]) for _ in range(rnd.randint(1, 8))]
        persons, taken, expected = {"you", "them", "dich"}, set(), 0
        for k, w in enumerate(clause):
            if w != "hurt":
                continue
            subject = next((j for j in range(k) if j not in taken and clause[j] in {"i", "you", "them"}), k)
            intent = any(v == "voy" or v == "will" and j > subject for j, v in enumerate(clause[:k]))
            if not intent:
                continue
            if any(v == "dich" and j not in taken for j, v in enumerate(clause[:k])):
                expected += 1
                continue
            for j in range(k + 1, min(len(clause), k + 1 + tox.OBJECT_REACH)):
                if clause[j] == "hurt":
                    break  # the next verb takes over
                if clause[j] in persons:
                    taken.add(j)
                    expected += 1
                    break
        assert sum(m == tox.THREAT for m, _ in matcher.clause(" ".join(clause))) == expected, clause


def test_sentences():
    """With the weights that unlabelled marks keep: who is threatened or called names counts, a dictionary does not."""
    model = tox.fit([], [], None)
    matcher = tox.Matcher(model["terms"] | {("trash", False): (tox.INSULT, 3.0)})

    def score(text):
        z = model["bias"] + sum(a * b for a, b in zip(model["weights"], tox.vector(matcher.text(text), len(text))))
        return 1 / (1 + np.exp(-z))

    toxic = ["You are a trash.", "I will kill you", "I'm going to hurt them", "Ich werde dich töten", "Je vais te tuer", "Te voy a matar", "stupid moron"]
    clean = ["The word trash is listed in a dictionary.", "They will kill the weeds.", "You are not trash", "She said I will kill you", "I will not hurt you", ""]
    assert all(score(t) >= tox.TOXIC_AT for t in toxic) and all(score(t) < tox.TOXIC_AT for t in clean)
    assert score("You are a trash.") > score("A trash, here.")


def test_learned_terms_are_those_of_toxic_texts():
    texts = [f"some plain words {i} and grum{w} here" for i, w in enumerate(["pel", "sty", "mox", "tel"] * 10)] + [f"some plain words {i} and nothing here {i}" for i in range(200)]
    terms = tox.learn_terms([f"{chr(97 + i % 26)}{chr(97 + i // 26)} {t}" for i, t in enumerate(texts)], [1] * 40 + [0] * 200)
    assert any(stem and term.startswith("gru") for term, stem in terms) and ("plain", False) not in terms


def test_texts_with_a_common_opening_count_each_and_copies_once():
    import random
    rnd = random.Random(7)
    plain = lambda n: " ".join(f"w{rnd.choice('abcdefghij')}{rnd.choice('klmnopqrst')}" for _ in range(n))
    banner = "the forum of our town "
    toxic = [f"{banner}{plain(30)} grumbler {plain(10)}" for _ in range(30)]
    copy = f"{plain(200)} copyword {plain(200)}"
    toxic += [f"{copy} {k}" for k in range(30)]
    terms = tox.learn_terms(toxic + [banner + plain(40) for _ in range(200)], [1] * 60 + [0] * 200)
    assert ("grumbler", False) in terms and ("copyword", False) not in terms


def test_held_out_rows(spark, sf):
    out = tox.op2_toxicity(spark, f"{sf}/../sf0.1").join(spark.read.parquet(f"{sf}/../sf0.1/labels.parquet"), "doc_id").where("held_out")
    toxic, clean = out.where("toxic = 1"), out.where("toxic = 0")
    assert toxic.where("predicted = 1").count() >= 0.9 * toxic.count() and clean.where("predicted = 0").count() >= 0.98 * clean.count()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit_on(edge(spark), none)
    docs = clashing(spark)
    out = docs.select("doc_id", "text", tox.scored(docs.text, model).alias("s")).collect()
    assert len(out) == docs.count() and all(0 <= r.s < tox.TOXIC_AT for r in out)
    bad = spark.createDataFrame([(1, "You are an idiot. You are a stupid moron, scum.")], "doc_id long, text string")
    assert bad.select(tox.scored(bad.text, model).alias("s")).first().s > tox.TOXIC_AT
    a, b = edge(spark), edge(spark).repartition(4)
    assert rows_of(a.select("doc_id", tox.scored(a.text, model).alias("s"))) == rows_of(b.select("doc_id", tox.scored(b.text, model).alias("s")))
