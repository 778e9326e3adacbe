"""Hits, completions, facets and totals from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .algebra import Matches, aggregate, per_doc


def scored_docs(m: Matches, how: str = "S") -> DataFrame:
    """(doc_id, score): a document's postings aggregated, carried scores always added."""
    return per_doc(m, how)


def _kept_carry(m: Matches):
    return F.coalesce(F.max("carried"), F.lit(0)) if m.carries else F.lit(0)


def _direction(rank: str, default: str = "d") -> tuple[str, bool]:
    letter = rank[0] if rank else "0"
    return letter, (rank[1] if len(rank) > 1 else default) == "a"


def hits(m: Matches, rank: str = "0d", k: int = 0, how: str = "S", skip: int = 0, n: int = 0) -> DataFrame:
    """(doc_id, score) ranked by 0 score, 1 doc id or 2 first word; ties by doc id upwards; k best, then page [skip, skip + n)."""
    letter, up = _direction(rank)
    docs = scored_docs(m, how)
    if letter == "2":
        docs = docs.join(m.postings.groupBy("doc_id").agg(F.min("word").alias("first")), "doc_id")
    by = {"0": "score", "1": "doc_id", "2": "first"}[letter]
    out = docs.orderBy(F.col(by).asc() if up else F.col(by).desc(), "doc_id").select("doc_id", "score")
    out = out.limit(k) if k else out
    if skip:
        out = out.offset(skip)
    return out.limit(n) if n else out


def display(word: Column) -> Column:
    """What a word is shown as: the last part of norm:, C:id: and S:id: words, else the word."""
    return F.when(word.rlike(r"^norm:[^:]*:.+"), F.regexp_extract(word, r"^norm:[^:]*:(.+)$", 1)).when(word.rlike(r"^[CS]:\d+:.+"), F.regexp_extract(word, r"^[CS]:\d+:(.+)$", 1)).otherwise(word)


def word_stats(m: Matches, in_doc: str = "S", across: str = "S") -> DataFrame:
    """(word, score, doc_count, occ_count, last_doc) of every matched word; carried scores do not count."""
    p = m.postings.select(display(F.col("word")).alias("word"), "doc_id", "score").where("word is not null")
    one = p.groupBy("word", "doc_id").agg(aggregate(in_doc).cast("long").alias("score"), F.count("*").alias("n"))
    return one.groupBy("word").agg(aggregate(across).cast("long").alias("score"), F.count("*").alias("doc_count"), F.sum("n").alias("occ_count"), F.max("doc_id").alias("last_doc"))


def completions(m: Matches, rank: str = "0d", k: int = 0, in_doc: str = "S", across: str = "S", likeness: DataFrame | None = None) -> DataFrame:
    """Word statistics ranked by 0 score, 1 documents, 2 occurrences, 3 word, 4 last document or 5 likeness (of words
    without one: 0); ties by documents, then word."""
    letter, up = _direction(rank)
    by = {"0": "score", "1": "doc_count", "2": "occ_count", "3": "word", "4": "last_doc", "5": "likeness"}[letter]
    turn = lambda c: F.col(c).asc() if up else F.col(c).desc()
    stats = word_stats(m, in_doc, across)
    if letter == "5":
        like = likeness.select("word", "likeness") if likeness is not None else None
        stats = stats.join(like, "word", "left").fillna(0, ["likeness"]) if like is not None else stats.withColumn("likeness", F.lit(0))
    out = stats.orderBy(turn(by), turn("doc_count"), "word").drop("likeness")
    return out.limit(k) if k else out


def totals(m: Matches) -> DataFrame:
    """One row: n_hits, n_completions, n_postings."""
    return m.postings.agg(F.countDistinct("doc_id").alias("n_hits"), F.countDistinct("word").alias("n_completions"), F.count("*").alias("n_postings"))


def facet_counts(docs: DataFrame, facets: DataFrame) -> DataFrame:
    """(facet, value, n_docs) of all facets of the documents ``docs`` at once; facets: (doc_id, facet, value)."""
    found = facets.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.groupBy("facet", "value").agg(F.countDistinct("doc_id").alias("n_docs"))


def hits_by_completion(m: Matches, rank_words: str = "0d", k: int = 100) -> DataFrame:
    """(doc_id, score) where each posting counts as its completion does, 1 beyond the k best; carried scores are added."""
    best = completions(m, rank_words, k).select("word", F.col("score").alias("cs"))
    p = m.postings.withColumn("word", display(F.col("word"))).join(best, "word", "left")
    return p.groupBy("doc_id").agg((F.sum(F.coalesce("cs", F.lit(1))) + _kept_carry(m)).alias("score"))


def hits_by_likeness(m: Matches, likeness: DataFrame) -> DataFrame:
    """(doc_id, score) where each posting is damped by its word's likeness in percent, 1 for words without one; carried scores are added."""
    p = m.postings.join(likeness.select("word", "likeness"), "word", "left")
    damped = F.sum(F.when(F.col("likeness").isNull(), 1).otherwise(F.floor(F.col("score") * F.col("likeness") / 100)))
    return p.groupBy("doc_id").agg((damped + _kept_carry(m)).alias("score"))


def page(docs: DataFrame, up: bool = False, k: int = 0, skip: int = 0, n: int = 0) -> DataFrame:
    """The k best of (doc_id, score), ties by doc id upwards, then page [skip, skip + n)."""
    out = docs.orderBy(F.col("score").asc() if up else F.col("score").desc(), "doc_id")
    out = out.limit(k) if k else out
    out = out.offset(skip) if skip else out
    return out.limit(n) if n else out


def grouped_hits(m: Matches, k: int = 10, per_group: int = 3, rank_words: str = "0d") -> DataFrame:
    """(word, doc_id, score, word_score, place): the best documents of each of the k best words."""
    best = completions(m, rank_words, k).select("word", F.col("score").alias("word_score"))
    docs = m.postings.withColumn("word", display(F.col("word"))).groupBy("word", "doc_id").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("word").orderBy(F.col("score").desc(), "doc_id")
    # the limit per group comes before the join: a row_number below a constant is cut before the shuffle
    top = docs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)
    return top.join(best, "word").select("word", "doc_id", "score", "word_score", "place")


def with_documents(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    return ranked.join(docs, "doc_id")


#: Custom scores are looked up by every task up to so many words; of more, each word's postings are dealt to so many tasks (fixed values).
LOOKED_UP, SHARES = 1_000_000, 64


def custom_scores(postings: DataFrame, custom: DataFrame, most: int = LOOKED_UP) -> DataFrame:
    """Scores times the factor that (word, factor) has for the word. No task gets all postings of a word."""
    if custom.limit(most + 1).count() <= most:
        both = postings.join(F.broadcast(custom), "word", "left")
    else:
        shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
        both = postings.withColumn("share", F.pmod(F.hash("doc_id"), F.lit(SHARES))).join(custom.withColumn("share", shares), ["word", "share"], "left")
    return both.select("doc_id", "word", "position", (F.col("score") * F.coalesce("factor", F.lit(1))).cast("long").alias("score"))


def best_match_bonus(postings: DataFrame, word: str, bonus: int) -> DataFrame:
    return postings.withColumn("score", F.col("score") + F.when(F.col("word") == word, bonus).otherwise(0))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(word, doc_freq, occ_freq)."""
    one = postings.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return one.groupBy("word").agg(F.count("*").alias("doc_freq"), F.sum("n").alias("occ_freq"))


def meta_info(postings: DataFrame) -> DataFrame:
    """One row of collection counts: documents, words, word-in-document pairs, largest doc id."""
    one = postings.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    words = one.groupBy("word").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.max("doc_id").alias("last"))
    docs = postings.agg(F.countDistinct("doc_id").alias("n_docs"))
    return words.agg(F.count("*").alias("n_words"), F.sum("pairs").alias("n_pairs"), F.sum("n").alias("n_postings"), F.max("last").alias("max_doc_id")).crossJoin(docs).select("n_docs", "n_words", "n_pairs", "n_postings", "max_doc_id", (F.col("n_postings") / F.col("n_docs")).alias("words_per_doc"), (F.col("n_postings") / F.col("n_words")).alias("mean_frequency"))  # one row each


def block_volumes(postings: DataFrame, length: int = 2) -> DataFrame:
    """(block, n_postings): postings by the first letters of their word, special words by their first two parts."""
    return postings.groupBy(block_of(F.col("word"), length).alias("block")).agg(F.count("*").alias("n_postings"))


def block_of(word: Column, length: int = 2) -> Column:
    return F.when(word.startswith(":"), F.regexp_extract(word, r"^(:[^:]*:[^:]*:?)", 1)).otherwise(F.substring(word, 1, length))


def capped_blocks(postings: DataFrame, most: int, length: int = 2) -> DataFrame:
    """At most ``most`` postings of each block, the first by document and position (a feature of index builds)."""
    w = Window.partitionBy("block").orderBy("doc_id", "position", "word")
    return postings.withColumn("block", block_of(F.col("word"), length)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k", "block")
