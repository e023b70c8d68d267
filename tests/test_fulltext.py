import pytest

from lexiquarry.operators import fulltext, ftsq
from lexiquarry.operators.ftsq import Near, Op, Phrase

HOSTILE = ['"', '""', "(((", "NEAR(", "NEAR()", "a AND", "OR b", "NOT", "a NOT NOT b", '"a', "NEAR(a, x)", "(" * 30 + "a" + ")" * 30, "*", "“", "'", ")", ",", "AND OR NOT", " ", "\0"]


@pytest.mark.parametrize("text", HOSTILE)
def test_no_input_raises(text):
    q = ftsq.parse(text)
    assert all(name in ("query", "words", "phrase", "near") for name, _ in q.rungs)


def test_grammar():
    assert ftsq.parse('a "b c" OR d*').node == Op("or", Op("and", Phrase(("a",), True), Phrase(("b", "c"))), Phrase(("d",), True))
    assert ftsq.parse("a NOT b AND c").node is not None
    assert ftsq.parse('NEAR("a b" c, 4)').node == Near((Phrase(("a", "b")), Phrase(("c",), True)), 4)
    assert [n for n, _ in ftsq.parse("one two").rungs] == ["phrase", "near", "words"]
    assert [n for n, _ in ftsq.parse("one*").rungs] == ["words"]
    assert ftsq.parse("don't").rungs[0][1] == Phrase(("don", "t"), True)


def reference(docs, node):
    import re

    words = {i: re.findall(r"\w+", t.lower()) for i, t in docs}

    def places(w, p):
        n = len(p.terms)
        return [k for k in range(len(w) - n + 1) if all(w[k + j] == t or (p.open and j == n - 1 and w[k + j].startswith(t)) for j, t in enumerate(p.terms))]

    def hit(w, x):
        if isinstance(x, Phrase):
            return bool(places(w, x))
        if isinstance(x, Op):
            a, b = hit(w, x.left), hit(w, x.right)
            return {"and": a and b, "or": a or b, "not": a and not b}[x.kind]
        spots = [places(w, p) for p in x.phrases]
        if not all(spots):
            return False
        import itertools

        return any(max(s) - min((at, at + len(p.terms)) for at, p in zip(s, x.phrases))[1] <= x.within for s in itertools.product(*spots))

    return {i for i, w in words.items() if hit(w, node)}


@pytest.mark.parametrize("text", ['"a b"', "NEAR(a b, 1)", 'NEAR("a b" c, 2)', "a OR d NOT b", "(a b) OR c", "e*", "NEAR(a b c, 3)"])
def test_matches_equal_reference(spark, text):
    import random

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcd") if rng.random() < 0.6 else rng.choice(["ef", "eg", "x"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    node = ftsq.parse(text).node or ftsq.parse(text).rungs[-1][1]
    index = fulltext.postings(spark.createDataFrame([("d", i, t) for i, t in docs], "dict_id string, id long, body string"))
    assert {r["id"] for r in fulltext.matches(index, node).collect()} == reference(docs, node)
