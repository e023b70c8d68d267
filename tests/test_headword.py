import random

import pytest

from lexiquarry.functions import fold as fo
from lexiquarry.operators import direct, headword
from lexiquarry.operators.pattern import ANY, ONE, Pattern, PatternTooLong
from lexiquarry.plans.views import keyed


@pytest.mark.parametrize(
    "text, spelled, rest",
    [("cafe", [0, 1], []), ("café*", [0, 1, 3], [2, 4]), ("Café*", [0, 2, 4], [1, 3, 5]), ("Par*", [0, 2], [1, 3]), ("nacion*", [0, 1], [2]), ("c?t", [], [0]), ("C?t", [], [0, 1])],
)
def test_classes(text, spelled, rest):
    rules = Pattern.wildcard(text).rules()
    assert [r.rank for r in rules if r.spelled] == spelled
    assert [r.rank for r in rules if not r.spelled] == rest


def test_long_patterns_are_refused():
    with pytest.raises(PatternTooLong):
        Pattern.wildcard("a" * 65)
    assert len(Pattern.wildcard("a" + "*" * 90).tokens) == 2


def test_folds():
    assert [fo.fold_text(w) for w in ("café", "café", "Straße", "Łódź", "İ", "한")] == ["cafe", "cafe", "straße", "łodz", "i", "한"]


def matches(tokens, key):
    if not tokens:
        return not key
    if tokens[0] is ANY:
        return any(matches(tokens[1:], key[i:]) for i in range(len(key) + 1))
    return bool(key) and (tokens[0] is ONE or tokens[0] == key[0]) and matches(tokens[1:], key[1:])


def brute(words, pattern, n):
    """Words in rank order by the definition: class, then dictionary order."""
    from lexiquarry.operators.pattern import read

    out = []
    for i, w in enumerate(words):
        if len(w) > 1 and w[0] == "@":
            continue
        for rule in pattern.rules():
            if rule.spelled:
                hit = read(w, rule.reading) == rule.value
            else:
                tokens = [t if not isinstance(t, str) else x for t in pattern.tokens for x in ([t] if not isinstance(t, str) else list(read(t, rule.reading)))]
                hit = matches(tokens, read(w, rule.reading))
            if hit:
                caps = "".join("1" if fo.lower_char(c) != c and c.isupper() else "0" for c in w)
                out.append((rule.rank, fo.fold_text(w), fo.lower_text(w), caps, w, i))
                break
    return [(r[4], r[0]) for r in sorted(out, key=lambda r: (r[0], *(x.encode() for x in r[1:5]), r[5]))][:n]


def test_wildcards_equal_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aeénrtÉA[.*") for _ in range(rng.randint(1, 5))) for _ in range(300)} | {"@", "@aa", "x*y", "q?r"})
    rows = keyed(spark.createDataFrame([("d", i, w) for i, w in enumerate(words)], "dict_id string, id long, w string")).cache()
    for text in ["*", "a*e", "É*", "?n*", "*[*", "A?", "é", *["".join(rng.choice("aeéÉA?*") for _ in range(rng.randint(1, 4))) for _ in range(8)]]:
        pattern = Pattern.wildcard(text)
        got = [(r["key"], r["class"]) for r in headword.search(rows, None, pattern, 20).orderBy("rank").collect()]
        assert got == brute(words, pattern, 20), text


def test_aliases_need_the_typed_head(spark):
    entries = keyed(spark.createDataFrame([("d", 1, "coffee"), ("d", 2, "@café"), ("d", 3, "cafe")], "dict_id string, id long, w string"))
    aliases = keyed(spark.createDataFrame([("d", 1, "café", 1), ("d", 2, "Cafe au lait", 1)], "dict_id string, row long, w string, entry_id long"))
    got = headword.prefix(entries, aliases, "cafe").orderBy("rank").collect()
    assert [(r["id"], r["key"]) for r in got] == [(3, "cafe"), (1, "Cafe au lait")]
    assert headword.exact(entries, aliases, "@café").count() == 1


def test_bodies_are_not_read_before_the_cut(spark):
    plan = headword.prefix(keyed(spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_brand dict_id", "p_partkey id", "p_name w")), None, "gr")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "p_type" not in plan.split("Physical Plan")[1]


def test_redirects_of_any_length(spark):
    chain = [("d", f"w{k}", f"w{k + 1}") for k in range(24)] + [("d", "a", "b"), ("d", "b", "a"), ("d", "b", "w23"), ("d", "x", "y"), ("d", "y", "x"), ("d", "n", None), ("e", "w20", "w21")]
    links = spark.createDataFrame(chain, "dict_id string, w string, target string")
    entries = spark.createDataFrame([("d", "w24", 1), ("d", "w24", 2)], "dict_id string, w string, id long")
    got = {tuple(r) for r in direct.follow(entries, links).select("dict_id", "w", "id").collect()}
    assert got == {("d", w, i) for w in [*(f"w{k}" for k in range(24)), "a", "b"] for i in (1, 2)} | {("d", w, None) for w in "xyn"} | {("e", "w20", None)}
