import pytest

from glyphloom.operators.synthesis import TypeStats, position_pattern, should_enumerate
from glyphloom.plans import pattern as P


@pytest.mark.parametrize(
    ("pattern", "regex"),
    [
        (P.literal("a.b-c"), r"a\.b\-c"),
        (P.char_class("digit", 3, 3), r"\d{3}"),
        (P.char_class("upper", 1, P.INF), "[A-Z]+"),
        (P.char_class("alnum", 2, P.INF), "[a-zA-Z0-9]{2,}"),
        (P.char_class("lower", 0, P.INF), "[a-z]*"),
        (P.char_class("word", 0, 1), r"\w?"),
        (P.enum(["ORG", "ACC", "ORG"]), "(ACC|ORG)"),
        (P.enum([]), "()"),
        (P.optional(P.literal("ab")), "ab?"),
        (P.optional(P.enum(["a", "b"])), "((a|b))?"),
        (P.optional(P.char_class("digit", 2, 2)), r"\d{2}?"),
        (P.any_(), ".+"),
        (P.seq([P.enum(["ACC", "ORG"]), P.literal("-"), P.char_class("digit", 3, 5)]), r"(ACC|ORG)\-\d{3,5}"),
    ],
)
def test_regex(pattern, regex):
    assert pattern.regex() == regex


def test_cost_specificity_pretty():
    p = P.seq([P.enum(["ACC", "ORG"]), P.literal("-"), P.char_class("digit", 3, 5)])
    assert p.cost() == pytest.approx(4.2)
    assert p.pretty() == '{ACC|ORG} "-" <digit{3-5}>'
    assert P.enum([]).cost() == 1.0 and P.enum([]).specificity() == 0.9
    assert P.enum(["a"]).specificity() == 1.0 and P.enum(map(str, range(21))).cost() == 20.5
    assert P.enum(map(str, range(6))).pretty() == "{0|1|2|...(6 values)}"
    assert P.literal('q"\n#{').pretty() == '"q\\"\\n\\#{"'
    assert P.optional(P.any_()).specificity() == pytest.approx(0.08)


def test_optimized_joins_neighbours():
    p = P.seq([P.literal("a"), P.literal("b"), P.char_class("digit", 1, 2), P.char_class("digit", 3, 3)]).optimized()
    assert p == P.seq([P.literal("ab"), P.char_class("digit", 4, 5)])
    assert P.seq([P.literal("a"), P.literal("b")]).optimized() == P.literal("ab")


def test_rows_round_trip():
    p = P.seq([P.enum(["a", "b"]), P.literal("-"), P.char_class("digit", 1, P.INF), P.any_(2, 3)])
    assert P.from_rows(P.rows(p)) == p


@pytest.mark.parametrize(("d", "n", "t", "want"), [(3, 100, 10, True), (50, 100, 10, False), (10, 100, 10, True), (5, 5, 1, True), (6, 10, 10, False)])
def test_should_enumerate(d, n, t, want):
    assert should_enumerate(d, n, t) is want


def test_positions():
    one = lambda kind, d, n, a, b, v=(): [TypeStats(kind, d, n, a, b, tuple(v))]
    assert position_pattern([], 10) == P.enum([])
    assert position_pattern(one("delimiter", 1, 9, 1, 1, "-"), 10) == P.literal("-")
    assert position_pattern(one("whitespace", 2, 9, 2, 2, ["\t\t", "  "]), 10) == P.literal("  ")
    assert position_pattern(one("whitespace", 2, 9, 1, 2), 10) == P.char_class("any", 1, 2)
    assert position_pattern(one("literal", 11, 20, 1, 4), 10) == P.any_(1, 4)
    assert position_pattern(one("upper", 20, 30, 1, 3) + one("lower", 20, 30, 2, 5), 10) == P.char_class("alpha", 1, 5)
    assert position_pattern(one("upper", 20, 30, 1, 3) + one("digits", 20, 30, 2, 5), 10) == P.char_class("alnum", 1, 5)
