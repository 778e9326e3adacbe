"""An open index: compiles query trees to DataFrames, ranks, and keeps results of earlier queries.

Postings of a word, prefix or range are one scan with a predicate on ``word`` that reaches the
Parquet reader; everything above it is joins on doc_id. Only ranked rows reach the driver.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import algebra, expand, rank
from ..operators.algebra import Matches
from ..operators.excerpts import excerpts
from . import query as Q


class Index:
    """postings (doc_id, word, position, score); docs (doc_id, url, title, info, text), synonyms and custom scores if any;
        specials (word, plain): words that stand wherever a plain word of the postings does, kept once and not by posting."""

    def __init__(self, spark: SparkSession, postings: DataFrame, docs: DataFrame | None = None, synonyms: DataFrame | None = None, custom: DataFrame | None = None, most_cached: int = 200, same_place: bool = False, max_docs: str = "S", normalise: bool = False, specials: DataFrame | None = None):
        self.spark, self.docs, self.synonyms = spark, docs, synonyms
        self.postings = rank.custom_scores(postings, custom) if custom is not None else postings.select(*algebra.POSTING)
        self.same_place, self.how, self.most_cached = same_place, max_docs, most_cached
        self._vocab: DataFrame | None = None
        self.damp = 1.0
        self.normalise = normalise  # the postings or specials have words norm:<normal form>:<word>
        self.specials = specials
        self._cache: OrderedDict[tuple, Matches] = OrderedDict()
        self._pinned: set[tuple] = set()

    @property
    def vocabulary(self) -> DataFrame:
        if self._vocab is None:
            self._vocab = rank.vocabulary(self.postings)
        return self._vocab

    # -- one word --------------------------------------------------------------------------------

    def scan(self, node) -> DataFrame:
        word = F.col("word")
        if isinstance(node, Q.Range):
            fits = (word >= node.low) & self._below(node)
        else:
            fits = word.startswith(node.text) if node.prefix else word == node.text
        found = self.postings.where(fits)
        if self.specials is None or (asked := self.specials.where(fits)).isEmpty():
            return found
        return found.unionByName(expand.special_postings(self.postings, asked))

    def _below(self, node: Q.Range):
        """Up to the last word with the prefix, or up to the first word from the upper bound on, itself included."""
        word = F.col("word")
        if node.high_prefix:
            return (word <= node.high) | word.startswith(node.high)
        words = [t.where(word >= node.high).agg(F.min("word")).first()[0] for t in (self.postings, self.specials) if t is not None]
        tops = [w for w in words if w is not None]
        return word <= min(tops, key=str.encode) if tops else F.lit(True)

    def _of_words(self, words: DataFrame) -> Matches:
        return Matches(self.postings.join(words.select("word").distinct(), "word", "left_semi").select(*algebra.POSTING))

    def likes(self, node: Q.Word) -> DataFrame:
        return expand.similar_words(self.vocabulary, node.text, node.prefix, self.damp)

    # -- trees -----------------------------------------------------------------------------------

    def compile(self, node) -> Matches:
        if node is None:
            return Matches(self.postings.where(F.lit(False)))
        if isinstance(node, Q.Word) and node.fuzzy:
            return self._of_words(self.likes(node))
        if isinstance(node, Q.Word) and node.synonyms and self.synonyms is not None:
            return self._of_words(expand.synonyms_of(self.synonyms, node.text))
        if isinstance(node, (Q.Word, Q.Range)):
            return Matches(self.scan(node))
        if isinstance(node, Q.Or):
            return algebra.any_of([self.compile(p) for p in node.parts])
        if isinstance(node, Q.Join):
            return algebra.value_join([self.compile(p) for p in node.queries])
        one, two = self.matches(node.first), self.compile(node.last)
        if isinstance(node, Q.And):
            return algebra.and_(one, two, self.how)
        if isinstance(node, Q.Near):
            return algebra.near(one, two, node.low, node.high, self.same_place)
        if isinstance(node, Q.Not):
            return algebra.without(one, two)
        return algebra.optionally(one, two, self.how)

    def matches(self, node) -> Matches:
        """The matches of a tree; from the cache, or from those of a wider prefix there."""
        key = (node, self.how, self.same_place)
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        wider = self._wider(node)
        if wider is not None:
            found = self._cache[(wider, self.how, self.same_place)]
            keep = F.col("word").startswith(node.last.text) if node.last.prefix else F.col("word") == node.last.text
            return Matches(found.postings.where(keep))
        return self.compile(node)

    def _wider(self, node):
        if not isinstance(node, Q.And) or not isinstance(node.last, Q.Word) or node.last.fuzzy or node.last.synonyms:
            return None
        for key in reversed(self._cache):
            c = key[0]
            if key[1:] == (self.how, self.same_place) and isinstance(c, Q.And) and c.first == node.first and isinstance(c.last, Q.Word) and c.last.prefix and not c.last.fuzzy and node.last.text.startswith(c.last.text):
                return c
        return None

    def keep(self, q: str, window: tuple[int, int] = (-10, 10), pin: bool = False) -> Matches:
        """Caches a query's matches on the executors (memory, then disk); the least used unpinned one makes room."""
        node = Q.parse(q, window)
        key = (node, self.how, self.same_place)
        if key not in self._cache:
            m = self.matches(node)
            self._cache[key] = Matches(m.postings.persist())
            if pin:
                self._pinned.add(key)
            while len(self._cache) > self.most_cached and (old := next((k for k in self._cache if k not in self._pinned and k != key), None)):
                self._drop(old)
        return self._cache[key]

    def _drop(self, key) -> None:
        self._cache.pop(key).postings.unpersist()

    def clear(self) -> None:
        for key in list(self._cache):
            self._drop(key)
        self._pinned.clear()

    def warm(self, queries: list[str]) -> None:
        for q in queries:
            self.keep(q, pin=True)

    # -- answers ---------------------------------------------------------------------------------

    def tree(self, q: str, window: tuple[int, int] = (-10, 10)):
        q = Q.cleaned(q)
        return Q.parse(Q.normalised(q) if self.normalise else q, window)

    def query(self, q: str, window: tuple[int, int] = (-10, 10)) -> Matches:
        return self.matches(self.tree(q, window))

    def facets(self, q: str, facets: DataFrame) -> DataFrame:
        return rank.facet_counts(self.query(q).postings, facets)

    def continuations(self, prefix: str, k: int = 0) -> DataFrame:
        """(rest, score, doc_count): what follows ``prefix*`` in words; none without the star."""
        p = prefix[:-1] if prefix.endswith("*") else None
        found = rank.completions(Matches(self.postings.where(F.col("word").startswith(p) if p is not None else F.lit(False))), k=k)
        return found.select(F.substring("word", len(p or "") + 1, 1 << 30).alias("rest"), "score", "doc_count")

    def suggest(self, words: list[str], gaps: list[bool] | None = None, k: int = 10) -> DataFrame:
        likes = [self.likes(Q.Word(w, fuzzy=True)) for w in words]
        return expand.suggestions(self.postings, likes, gaps or [False] * (len(words) - 1), k)

    def answer(self, p: Q.Parameters) -> dict:
        """Ranked rows of a request, ready for sinks.response."""
        node = self.tree(p.query, p.window)
        if node is None:
            t = rank.meta_info(self.postings).first()
            return {"query": p.query, "status": 0, "n_hits": t.n_docs, "n_completions": t.n_words, "completions": [], "hits": [], "first": p.first_hit}
        self.damp = p.fuzzy_dampening
        m = self.matches(node)
        likeness = self.likes(_last(node)) if isinstance(_last(node), Q.Word) and _last(node).fuzzy else None
        total = rank.totals(m).first()
        words = rank.completions(m, p.rank_words, p.k_words, p.aggregation[0], p.aggregation[1], likeness).limit(p.completions).collect()
        letter, up = p.rank_docs[:1], p.rank_docs[1:] == "a"
        if letter == "5":
            ranked = rank.page(rank.hits_by_completion(m, p.rank_words, p.k_words), up, p.k_hits, p.first_hit, p.hits)
        elif letter == "7":
            none = self.spark.createDataFrame([], "word string, likeness int")
            ranked = rank.page(rank.hits_by_likeness(m, likeness if likeness is not None else none), up, p.k_hits, p.first_hit, p.hits)
        elif letter == "6":
            groups = rank.grouped_hits(m, p.completions, 3, p.rank_words).orderBy(F.col("word_score").desc(), "word", "place")
            ranked = groups.offset(p.first_hit).limit(p.hits)
        else:
            ranked = rank.hits(m, p.rank_docs, p.k_hits, p.aggregation[3], p.first_hit, p.hits)
        if self.docs is not None and p.excerpts:
            shown, prefixes = _highlighted(node)
            docs = self.docs.withColumn("info", T.picked_part(F.col("info"), "\t", p.part)) if p.part else self.docs
            ranked = excerpts(ranked, docs, shown, prefixes, p.excerpt_radius, p.excerpts)
            by = F.col("doc_id" if letter == "1" else "score")
            order = [F.col("word_score").desc(), F.col("word"), F.col("place")] if letter == "6" else [by.asc() if up else by.desc(), F.col("doc_id")]
            ranked = ranked.orderBy(*order)
        return {"query": p.query, "status": 0, "n_hits": total.n_hits, "n_completions": total.n_completions, "completions": [r.asDict() for r in words], "hits": [r.asDict() for r in ranked.collect()], "first": p.first_hit}


def _last(node):
    """The part of a query whose words are its completions."""
    while hasattr(node, "first"):
        node = node.first if isinstance(node, (Q.Not, Q.Optional)) else node.last
    return node


def _highlighted(node) -> tuple[list[str], list[str]]:
    if isinstance(node, Q.Word):
        return ([], [node.text]) if node.prefix else ([node.text], [])
    parts = list(getattr(node, "parts", ())) + list(getattr(node, "queries", ()))
    if hasattr(node, "first"):
        parts += [node.first] if isinstance(node, Q.Not) else [node.first, node.last]
    words, prefixes = [], []
    for p in parts:
        a, b = _highlighted(p)
        words += a
        prefixes += b
    return words, prefixes
