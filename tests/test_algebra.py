"""The query algebra on the small corpus of FIXTURES.md, section 1."""

import pytest

from quillon.operators import algebra, rank
from quillon.plans.session import Index

CORPUS = {1: "aachen aal aalglatt aargau", 2: "aachen aalglatt aal", 3: "babbeln baby babyboom babylonisch", 4: "babbeln baby babyboom"}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(d, w, k, 1) for d, t in CORPUS.items() for k, w in enumerate(t.split(), 1)]
    return Index(spark, spark.createDataFrame(rows, "doc_id long, word string, position int, score long").cache())


def got(index, q):
    return sorted((r.doc_id, r.word, r.score, r.position) for r in index.query(q).with_carry().collect() if r.word is not None), sorted((r.doc_id, r.score) for r in index.query(q).with_carry().where("word is null").collect())


@pytest.mark.parametrize(
    "q, words, carry",
    [
        ("", [], []),
        ("aachen", [(1, "aachen", 1, 1), (2, "aachen", 1, 1)], []),
        ("aal*", [(1, "aal", 1, 2), (1, "aalglatt", 1, 3), (2, "aal", 1, 3), (2, "aalglatt", 1, 2)], []),
        ("aachen aal", [(1, "aal", 1, 2), (2, "aal", 1, 3)], [(1, 1), (2, 1)]),
        ("aachen* aal", [(1, "aal", 1, 2), (2, "aal", 1, 3)], [(1, 1), (2, 1)]),
        ("aachen aal*", [(1, "aal", 1, 2), (1, "aalglatt", 1, 3), (2, "aal", 1, 3), (2, "aalglatt", 1, 2)], [(1, 1), (2, 1)]),
        ("aachen.aal", [(1, "aal", 2, 2)], []),
        ("aachen*.aal", [(1, "aal", 2, 2)], []),
        ("aachen.aal*", [(1, "aal", 2, 2), (2, "aalglatt", 2, 2)], []),
        ("aachen..aal", [(1, "aal", 2, 2), (2, "aal", 2, 3)], []),
        ("aachen*..aal", [(1, "aal", 2, 2), (2, "aal", 2, 3)], []),
        ("aachen..aal*", [(1, "aal", 2, 2), (1, "aalglatt", 2, 3), (2, "aal", 2, 3), (2, "aalglatt", 2, 2)], []),
        ("aachen|aal", [(1, "aachen", 1, 1), (1, "aal", 1, 2), (2, "aachen", 1, 1), (2, "aal", 1, 3)], []),
        ("aachen|aal*", [(1, "aachen", 1, 1), (1, "aal", 1, 2), (1, "aalglatt", 1, 3), (2, "aachen", 1, 1), (2, "aal", 1, 3), (2, "aalglatt", 1, 2)], []),
        ("[aachen#aal]", [], []),
        ("aachen.,,,.aargau", [(1, "aargau", 2, 4)], []),
        ("aalglatt.;.aal", [(1, "aal", 2, 2)], []),
        ("aachen=aachen", [], []),
        ("aachen -aargau", [(2, "aachen", 1, 1)], []),
        ("aachen (aargau)", [(1, "aachen", 1, 1), (2, "aachen", 1, 1)], [(1, 1)]),
        ("[aachen aal*#aalg*]", [(1, "aalglatt", 1, 3), (1, "aalglatt", 1, 3), (2, "aalglatt", 1, 2), (2, "aalglatt", 1, 2)], [(1, 1), (2, 1)]),
        ("aal--aalh", [(1, "aal", 1, 2), (1, "aalglatt", 1, 3), (1, "aargau", 1, 4), (2, "aal", 1, 3), (2, "aalglatt", 1, 2)], []),
    ],
)
def test_golden(index, q, words, carry):
    assert got(index, q) == (sorted(words), carry)


def test_hits_and_completions(index):
    m = index.query("aal*")
    assert [(r.doc_id, r.score) for r in rank.hits(m).collect()] == [(1, 2), (2, 2)]
    assert [(r.word, r.doc_count, r.occ_count) for r in rank.completions(m).collect()] == [("aal", 2, 2), ("aalglatt", 2, 2)]
    assert rank.totals(m).first()[:2] == (2, 2)
    assert [(r.doc_id, r.score) for r in rank.hits(index.query("aachen aal*")).collect()] == [(1, 3), (2, 3)]


def test_top_k(spark):
    docs, words = [1, 1, 1, 2, 3, 3, 3, 3], [2, 8, 1, 6, 5, 3, 7, 4]
    p = spark.createDataFrame([(d, str(w), k, 1) for k, (d, w) in enumerate(zip(docs, words))], "doc_id long, word string, position int, score long")
    m = algebra.Matches(p)
    assert [(r.doc_id, r.score) for r in rank.hits(m, "1a").collect()] == [(1, 3), (2, 1), (3, 4)]
    assert [r.word for r in rank.completions(m, "3a").collect()] == list("12345678")


def test_filtering_from_cache(index):
    index.keep("aachen aa*")
    assert got(index, "aachen aalg*") == ([(1, "aalglatt", 1, 3), (2, "aalglatt", 1, 2)], [(1, 1), (2, 1)])
    index.clear()


def test_near_against_brute_force(spark):
    import random

    r = random.Random(5)
    for low, high in ((1, 1), (-3, 4), (2, 2), (-2, -2)):
        one = [(r.randrange(5), "a", p, r.randrange(1, 4)) for p in r.sample(range(40), 12)]
        two = [(r.randrange(5), "b", p, r.randrange(1, 4)) for p in r.sample(range(40), 12)]
        schema = "doc_id long, word string, position int, score long"
        found = algebra.near(algebra.Matches(spark.createDataFrame(one, schema)), algebra.Matches(spark.createDataFrame(two, schema)), low, high)
        want = []
        for d, w, p, s in two:
            before = [(q, t) for e, _, q, t in one if e == d and q <= p - low]
            if before and p - max(before)[0] <= high and max(before)[0] != p:
                want.append((d, w, p, s + max(before)[1]))
        assert sorted(map(tuple, found.postings.select("doc_id", "word", "position", "score").collect())) == sorted(want)
