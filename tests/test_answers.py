"""Requests through an index: rankings of documents and words, and what the plans of its scans read."""

import re

import pytest

from quillon import queries
from quillon.operators import algebra, rank
from quillon.plans import query as Q
from quillon.plans.session import Index

SF = "/root/testdata/sf0.001"
ROWS = [(1, "tree", 1, 9), (1, "treat", 2, 1), (2, "tread", 1, 4), (3, "tree", 1, 2), (3, "tread", 2, 2), (3, "moss", 3, 5), (1, "moss", 3, 1)]


@pytest.fixture(scope="module")
def index(spark):
    return Index(spark, spark.createDataFrame(ROWS, "doc_id long, word string, position int, score long"))


def hits(index, q, **more):
    return [(h["doc_id"], h["score"]) for h in index.answer(Q.Parameters(query=q, **more))["hits"]]


def test_documents_by_completion(index):
    # tree counts 11, tread 6, treat 1
    assert hits(index, "tre*", rank_docs="5d") == [(3, 17), (1, 12), (2, 6)]
    assert hits(index, "moss tre*", rank_docs="5d") == [(3, 18), (1, 13)]  # where moss is, tread counts 2
    assert hits(index, "tre*", rank_docs="5a", hits=1, first_hit=1) == [(1, 12)]


def test_documents_by_likeness(index):
    # tree 100, tread and treat 60 each
    assert hits(index, "tree~", rank_docs="7d") == [(1, 9), (3, 2)]
    assert hits(index, "treed~", rank_docs="7d") == [(1, 7), (2, 3), (3, 2)]


def test_documents_grouped_by_word(index):
    found = index.answer(Q.Parameters(query="tre*", rank_docs="6d"))["hits"]
    assert [(h["word"], h["doc_id"]) for h in found] == [("tree", 1), ("tree", 3), ("tread", 2), ("tread", 3), ("treat", 1)]


def test_words_by_likeness(index):
    found = index.answer(Q.Parameters(query="treed~", rank_words="5d"))["completions"]
    assert [c["word"] for c in found] == ["tread", "tree"]


def test_carries(spark):
    p = spark.createDataFrame(ROWS, "doc_id long, word string, position int, score long")
    of = lambda w: algebra.Matches(p.where(f"word = '{w}'"))
    both = algebra.and_(of("moss"), of("tree"))
    assert sorted(map(tuple, both.carry.collect())) == [(1, 1), (3, 5)]
    assert sorted(map(tuple, rank.scored_docs(algebra.and_(both, of("tread"))).collect())) == [(3, 9)]
    assert sorted(map(tuple, rank.scored_docs(algebra.optionally(of("tree"), of("tread"))).collect())) == [(1, 9), (3, 4)]
    assert sorted(map(tuple, algebra.value_join([both, of("tree")]).carry.collect())) == [(1, 1), (3, 5)]


@pytest.mark.parametrize("name, scans", [("and_query", 2), ("and_three", 3), ("not_query", 2)])
def test_each_part_is_scanned_once(spark, name, scans):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert plan.count("FileScan parquet") == scans and len(pushed) == scans
    assert all(re.search(r"(EqualTo|StringStartsWith)\(word,", x) for x in pushed)


def test_custom_scores_deal_out_a_word(spark):
    """Looked up or dealt in shares, with the same scores; no shuffle is by the word alone."""
    rows = [(k, w, 1, 2) for k in range(300) for w in ("tree", "moss", "fern")]
    p = spark.createDataFrame(rows, "doc_id long, word string, position int, score long")
    custom = spark.createDataFrame([("tree", 3), ("moss", 0)], "word string, factor int")
    factor = {"tree": 3, "moss": 0}
    for most in (10, 1):
        found = rank.custom_scores(p, custom, most)
        assert sorted(map(tuple, found.collect())) == sorted((d, w, at, s * factor.get(w, 1)) for d, w, at, s in rows)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(word#\d+, (?!share)", plan)


@pytest.mark.parametrize("name", ["custom_scores", "max_aggregation"])
def test_custom_scores_shuffle_no_word(spark, name):
    assert "hashpartitioning(word#" not in queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_alternatives_are_dealt_by_document_first(spark, monkeypatch):
    """No task groups postings before they are dealt, and a larger table is dealt to more tasks; one shuffle serves both groupings."""
    monkeypatch.setattr(algebra, "SHARE_BYTES", 10_000)
    plan = queries.QUERIES["or_query"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    assert int(re.search(r"hashpartitioning\(doc_id#\d+L, (\d+)\)", plan)[1]) > spark.sparkContext.defaultParallelism
