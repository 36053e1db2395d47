"""The grammar's five machines, one by one and composed."""

import itertools

from gridloom.llm import toxicity


def test_threats_weigh():
    w = toxicity.Grammar({"idiot": 4.0}).weight
    assert w("I will kill you") == w("you are an idiot") > w("they kill time") / 2 > 0
    assert w("I will kill you") > w("kill the lights") > w("I will see you") == 0
    assert w("ich werde dich töten") == w("I will kill you") and w("je vais te frapper") > 0
    assert w("I will not kill you") < w("I will kill you") and w("he said he would kill you") < w("he would kill you")
    assert w("kill the lights. see you") == w("kill the lights")


def test_threats_teach_and_score(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(i, f"you {name(i)} idiot" if i % 2 else f"a {name(i)} day") for i in range(400)] + [(1000, "I will kill you"), (1001, "a fine day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert got[1000] >= 0.5 > got[1001]


def plainly(symbols, weights):
    """The five machines' outputs, each read on its own along the clause, multiplied word by word."""
    T = toxicity
    total, threat, target, scope, reported = 0.0, False, False, 0, False
    for x, weight in zip(symbols, weights):
        factor = 1.0 if x in (T.INSULT, T.THREAT) else 0.0
        if x in (T.INSULT, T.THREAT):
            factor *= (T.NEGATED if scope else 1.0) * (T.REPORTED if reported else 1.0)
        total += factor * weight
        threat, target, reported = threat or x == T.THREAT, target or x == T.TARGET, reported or x == T.REPORT
        scope = T.SCOPE if x == T.NEGATION else max(0, scope - 1)
    return total * (T.THREAT_GAIN if threat and target else 1.0) * (T.TARGET_GAIN if target else 1.0)


def test_composition_is_the_five_machines():
    word = {toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.OTHER: "day"}
    g = toxicity.Grammar({"idiot": 3.0})
    changed = set()
    for n in range(1, 6):
        for symbols in itertools.product(word, repeat=n):
            weights = [g.weights[word[x]] for x in symbols]
            want = plainly(symbols, weights)
            assert abs(g.clause([word[x] for x in symbols]) - want) < 1e-12
            for x in word:
                if want != plainly([toxicity.OTHER if s == x else s for s in symbols], [0 if s == x else w for s, w in zip(symbols, weights)]):
                    changed.add(x)
    assert changed == set(word) - {toxicity.OTHER}


def test_every_word_of_enough_witnesses_is_learned(spark):
    """No limit on their number, and a word that one text repeats isn't evidence."""
    kinds = [f"{a}{b}{c}zz" for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklm"]
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(f"{name(i)} {kind} {name(i)}", 1) for i, kind in enumerate(kinds * 6)] + [("spam " * 500, 1)] + [(f"{name(10**5 + i)} plain", 0) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    learned = toxicity.learn_words(labelled)
    assert set(kinds) <= set(learned) and "spam" not in learned and "plain" not in learned
