import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.functions import literals
from textlake.functions.literals import AllOf, AnyOf, Literal

DIGITS = AnyOf(tuple(map(Literal, "0123456789")))


@pytest.mark.parametrize(
    "pattern,fold,want",
    [
        ("sea", False, Literal("sea")),
        ("É[a-z]*x", True, AllOf((Literal("é", True), Literal("x", True)))),
        ("[[:digit:]]{2,}[^[:alnum:]]", False, DIGITS),
        (r"\ban\b|\s(é\w+)$", False, AnyOf((Literal("an"), Literal("é")))),
        (r"^def \w+", False, Literal("def ")),
        ("(ab)+c?d{3}e", False, AllOf((Literal("ab"), Literal("ddde")))),
        ("foo(bar|baz)?qux|x", False, AnyOf((AllOf((Literal("foo"), Literal("qux"))), Literal("x")))),
        ("a(?i)bC(?-i)d", False, AllOf((Literal("a"), Literal("bc", True), Literal("d")))),
        (r"\x41\Qa.b\E.", False, Literal("Aa.b")),
        ("(a|b|)z", False, Literal("z")),
        ("a*|b", False, None),
        (".+", False, None),
        ("ß", True, None),
        ("", False, None),
        ("[^abc]", False, None),
        ("[x]y", False, Literal("xy")),
    ],
)
def test_formulas(pattern, fold, want):
    assert literals.required(pattern, fold) == want


ATOMS = ["a", "b", "é", "É", "k", "s", "1", " ", ".", "[ab]", "[^a]", "[0-9]", r"\d", r"\w", r"\b", "^", "$", "(a|bé)", "(?:k|)", "(ab)", "(?i:aS)", "ı"]
QUANTIFIERS = ["", "", "", "*", "+", "?", "{2}", "{0,2}", "{1,}", "+?"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ATOMS), st.sampled_from(QUANTIFIERS)), min_size=1, max_size=6), st.booleans(), st.booleans(), st.integers(0, 10**6))
def test_a_text_with_a_match_satisfies_the_formula(parts, fold, split, seed):
    pattern = "".join(a + (q if a[0] not in "^$\\" or a in (r"\d", r"\w") else "") for a, q in parts)
    if split and len(parts) > 2:
        pattern = pattern.replace("é", "é|", 1) if "é*" not in pattern and "é+" not in pattern and "é?" not in pattern and "é{" not in pattern else pattern
    formula, compiled = literals.required(pattern, fold), re.compile(pattern, re.IGNORECASE if fold else 0)
    rnd = random.Random(seed)
    for _ in range(30):
        text = "".join(rnd.choice("abéÉkKſsSıİ12 xK") for _ in range(rnd.randint(0, 9)))
        if compiled.search(text):
            assert literals.satisfied(text, formula), (pattern, text, formula)


def test_condition_is_the_formula(spark):
    texts = ["", "Aé", "éx", "ÉTUDE Xk", "nothing", "12", "ſa", "K", "a.b", "İx é", "ΣΑΣ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, fold in (("É[a-z]*x", True), ("[[:digit:]]", False), ("a|(é|x)1?", False), ("sa", True), ("k", True), ("(?i)x k", False), (".", False)):
        formula = literals.required(pattern, fold)
        got = {r.t: r.ok for r in df.select("t", literals.may_match(df.t, formula).alias("ok")).collect()}
        assert got == {t: literals.satisfied(t, formula) for t in texts}, pattern
