"""Names are found in one pass, as pattern by pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scorewright.operators import aliases as A
from scorewright.operators import relevance


def fits(rule: str, text: str, a: int, z: int, name: str) -> bool:
    left, right = text[a - 1 : a] if a else "", text[z : z + 1]
    word = lambda c: bool(re.fullmatch(r"\w", c))
    if rule == "alnum":
        return not re.fullmatch("[A-Za-z0-9]", left) and not re.fullmatch("[A-Za-z0-9]", right)
    if rule == "word":
        return not word(left) and not word(right)
    if rule == "unit":
        return not word(left) and not (word(right) and not right.isdigit())
    if rule == "edge":
        return word(left) != word(name[0]) and word(right) != word(name[-1])
    return True


def plain(texts, names):
    out = set()
    for i, t in texts:
        low = (t or "").lower()
        for name, rule in {(n.lower(), r) for n, r in names if n and r}:
            at, n, end = None, 0, 0
            for a in range(len(low) - len(name) + 1):
                if low.startswith(name, a) and fits(rule, low, a, a + len(name), name):
                    at = a if at is None else at
                    if a >= end:
                        n, end = n + 1, a + len(name)
            if n:
                out.add((i, name, rule, at, n))
    return out


TEXTS = [(1, "ABC abc xabc, abc_ (abc)"), (2, "aaaaa aa aaa"), (3, "RM5 rm rmx xrm"), (4, "été d'été ÉTÉ9"), (5, None), (6, ""), (7, "she sells his hers"), (8, "a.b a.b.c"), (9, "abc")]
NAMES = [(n, r) for n in ("abc", "aa", "aaa", "rm", "été", "he", "she", "his", "hers", "a.b", ".b", "(abc)") for r in A.RULES] + [("", "any"), (None, "any"), ("abc", None), ("ABC", "any")]


@pytest.mark.parametrize("most", [1 << 19, 8])
def test_every_rule_against_a_plain_search(spark, most):
    texts = spark.createDataFrame([(i, t, "clash", 3) for i, t in TEXTS], "id int, text string, name string, n int")
    names = spark.createDataFrame([(*n, 1) for n in NAMES], "name string, rule string, id int")
    got = A.names_found(texts, names, F.col("text"), keep=["id"], most=most)
    assert {tuple(r) for r in got.collect()} == plain(TEXTS, NAMES)
    assert got.count() == len(plain(TEXTS, NAMES))


def test_random_texts_with_thousands_of_names(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    names = [(word(rng.randint(2, 6)), rng.choice(list(A.RULES))) for _ in range(2500)]
    texts = [(i, " ".join(word(rng.randint(1, 8)) for _ in range(25))) for i in range(20)]
    got = A.names_found(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name string, rule string"), F.col("text"), keep=["id"])
    assert {tuple(r) for r in got.collect()} == plain(texts, names)


def test_no_names_and_no_texts(spark):
    texts, names = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(NAMES, "name string, rule string")
    assert A.names_found(texts, names.where("1 = 0"), F.col("text"), keep=["id"]).count() == 0
    assert A.names_found(texts.where("1 = 0"), names, F.col("text"), keep=["id"]).count() == 0


def test_others_come_in_order_and_any_by_strength(spark):
    rows = [("A", "Alpha", "strong"), ("B", "Betatron", "strong"), ("B", "Alpha", "strong"), ("C", "gamma", "strong"), ("C", "four", "strong"), ("D", "alp", "medium"), ("E", "beta", "weak"), ("E", "of", "weak")]
    aliases = spark.createDataFrame(rows, "ticker string, alias string, match_strength string")
    a = spark.createDataFrame([(1, "A", "ALPHA betatrons and gammas of four"), (2, "B", "nothing"), (3, "Z", "offers"), (4, "C", None)], "id int, g string, text string")
    others = {r["id"]: r["hits"] for r in relevance.other_alias_hits(a, aliases, F.col("text"), id_col="id", group_col="g", order=["ticker"], most=2).collect()}
    assert others == {1: ["Alpha", "Betatron"]}
    anything = {r["id"]: (r["hits"], r["mentions"]) for r in relevance.any_alias_hits(a, aliases, F.col("text"), id_col="id", order=["ticker"]).collect()}
    assert anything == {1: (["Alpha", "Alpha", "Betatron", "four", "gamma", "alp", "of"], 6)}


def test_categories_keep_groups_without_hits(spark):
    d = spark.createDataFrame([("s", None, "The rm5 of it"), ("s", None, "the the"), (None, "de", "nichts"), ("t", "en", None)], "source string, lang string, text string")
    got = {(r["source"], r["lang"]): (r["has_a"], r["n_a"], r["n_b"]) for r in A.category_counts(d, {"a": ["the", "of"], "b": ["rm", "%"]}, F.col("text"), groups=["source", "lang"]).collect()}
    assert got == {("s", None): (True, 3, 1), (None, "de"): (False, 0, 0), ("t", "en"): (False, 0, 0)}


def test_own_names_by_join_are_those_of_the_automaton(spark):
    from scorewright.operators.aliases import own_names_found

    texts = spark.createDataFrame([(1, "g", "A.B (c) and x\\Ed"), (2, "h", "a.b is not g's"), (3, None, "a.b"), (4, "g", None), (5, "g", "axb xa.b\n")], "id long, g string, t string")
    names = spark.createDataFrame([("g", n) for n in ("a.b", "(c)", "x\\Ed", "x", "", None)] + [("h", "g"), ("h", "not")], "group_ string, alias string").selectExpr("group_", "alias", "lower(alias) AS name")
    got = [sorted(map(tuple, own_names_found(texts, names, F.col("t"), id_col="id", group_col="g", **more).collect())) for more in ({}, {"most": 1})]
    assert got[0] == got[1] == [(1, "(c)"), (1, "a.b"), (1, "x"), (1, "x\\Ed"), (2, "g"), (2, "not")]
    # names beyond what one automaton holds are not looked for in other groups' texts
    plan = own_names_found(texts, names, F.col("t"), id_col="id", group_col="g", most=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_texts_tell_their_names_in_one_row(spark):
    rows = [("B", "Beta", "strong"), ("A", "Beta", "strong"), ("C", "be", "weak"), ("C", "a b", "weak"), ("D", "x", "weak"), ("D", "eta", "medium")]
    aliases = spark.createDataFrame(rows, "ticker string, alias string, match_strength string")
    texts = spark.createDataFrame([(1, "Z", "BETA be beta_be A b, xx"), (2, "A", "beta Beta"), (3, "Z", "nothing"), (4, "B", "be"), (4, "C", "be be eta"), (4, "Z", "be")], "id int, g string, text string")
    found = A.names_held(texts, aliases.selectExpr("struct(ticker, alias) as a", "alias as name", "'any' as rule"), F.col("text"), keep=["id"], told="a")
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 4, 4, 4]
    for r in found.where("id = 2").collect():
        assert [(a["ticker"], n) for a, n in zip(r["held_"], r["times_"], strict=True)] == [("A", 2), ("B", 2), ("C", 1), ("C", 2), ("D", 2)] and r["total_"] == 7
    anything = relevance.any_alias_hits(texts, aliases, F.col("text"), id_col="id", order=["ticker"])
    # the hits of a text reach its id in one row, not a row a hit
    assert "Join" not in anything._jdf.queryExecution().optimizedPlan().toString()
    # texts with one id: counts that are equal count once, as in the SQL
    assert {r["id"]: (r["hits"], r["mentions"]) for r in anything.collect()} == {1: (["Beta", "Beta", "eta", "a b", "be"], 6), 2: (["Beta", "Beta", "eta"], 4), 4: (["eta", "be"], 4)}
    strong = aliases.selectExpr("ticker", "alias || ' be' AS alias", "'strong' AS match_strength")
    others = relevance.other_alias_hits(texts, strong, F.col("text"), id_col="id", group_col="g", order=["ticker"], most=1)
    assert sorted(map(tuple, others.collect())) == [(1, ["Beta be"]), (2, ["Beta be"])]
    assert "Join" not in others._jdf.queryExecution().optimizedPlan().toString()
