import pytest

from quillon.plans import query as Q


def test_left_deep():
    assert Q.parse("a b* c") == Q.And(Q.And(Q.Word("a"), Q.Word("b", prefix=True)), Q.Word("c"))
    assert Q.parse("a.b..c") == Q.Near(Q.Near(Q.Word("a"), Q.Word("b"), 1, 1), Q.Word("c"), -10, 10)
    assert Q.parse("a..b", (2, 5)) == Q.Near(Q.Word("a"), Q.Word("b"), 2, 5)
    assert Q.parse("a.,,.b") == Q.Near(Q.Word("a"), Q.Word("b"), 2, 2)
    assert Q.parse("a.;;;.b") == Q.Near(Q.Word("a"), Q.Word("b"), -3, -3)


def test_tight_operators():
    assert Q.parse("x a|b*") == Q.And(Q.Word("x"), Q.Or((Q.Word("a"), Q.Word("b", prefix=True))))
    assert Q.parse("[a b#c]") == Q.Join((Q.And(Q.Word("a"), Q.Word("b")), Q.Word("c")))
    assert Q.parse("a -b") == Q.Not(Q.Word("a"), Q.Word("b"))
    assert Q.parse("a (b)") == Q.Optional(Q.Word("a"), Q.Word("b"))
    assert Q.parse("alg*~") == Q.Word("alg", prefix=True, fuzzy=True)
    assert Q.parse("vw^") == Q.Word("vw", synonyms=True)
    assert Q.parse("1990--1999*") == Q.Range("1990", "1999", True)
    assert Q.parse(":ordering:year:1--:ordering:year:2") == Q.Range(":ordering:year:1", ":ordering:year:2")
    assert Q.parse('"a.b"') == Q.Word("a.b")
    assert Q.parse("") is None


@pytest.mark.parametrize("q", ["*", "-a b", "a.-b", "[a]"])
def test_errors(q):
    if q == "-a b":
        with pytest.raises(Q.QueryError):
            Q.parse(q)
    else:
        with pytest.raises(Q.QueryError):
            Q.parse(q)


def test_rewrites():
    assert Q.cleaned("a *b |c") == "a b c"
    assert Q.cleaned("alg~*") == "alg*~"
    assert Q.normalised("alg b*") == "norm:alg:*|alg norm:b*|b*"
    assert Q.separators_mapped(":facet:a:*") == "!facet!a!*"


def test_normal_forms_of_special_words():
    # only the part that is a word of text
    same = [":fil*", ":filter:Ü*", "C:32:*", ":facet:Ort:Köln*", "ce:author:Ü_x:*", ":Ä:ü"]
    assert [Q.normalised_part(p) for p in same] == same
    want = {"Köln*": "koeln*", "Café:*": "cafe:*", ":filter:Ort:Köln*": ":filter:Ort:koeln*", "Öl:C:7:*": "oel:C:7:*", "Öl:S:7:*": "oel:S:7:*", ":filter:Ä:Öl:Ü*": ":filter:Ä:oel:Ü*", ":filter:Ä:C:7:Öl:Ü": ":filter:Ä:C:7:oel:Ü", ":filter:A:Ä--:filter:A:Ö*": ":filter:A:ae--:filter:A:oe*"}
    assert {p: Q.normalised_part(p) for p in want} == want
    assert Q.normalised("Öl -Ü :filter:F:Ä* ä--ö x~") == "norm:oel:*|Öl -norm:ue:*|Ü :filter:F:ae* ae--oe x~"
    assert Q.parse(Q.normalised('"a.ä"')) == Q.Or((Q.Word("norm:a.ae:", prefix=True), Q.Word("a.ä")))


def test_parameters():
    p = Q.Parameters.from_url("/?q=a+b%2A&h=5&f=10&c=3&rd=1a&n=-3,7&fd=0.5&s=smms&format=json&en=99999")
    assert (p.query, p.hits, p.first_hit, p.completions, p.rank_docs, p.window, p.fuzzy_dampening, p.aggregation, p.format, p.excerpts) == ("a b*", 5, 10, 3, "1a", (-3, 7), 0.5, "SMMS", "json", 1000)
    assert Q.Parameters.from_url("/?q=%zz&n=5,1&fd=7").window == (-10, 10)
    assert p.k_hits == 100 and p.k_words == 100
