"""Words a query word stands for: similar words, synonyms, words within words, and suggestions."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_distance, most_edits, normalised_score, prefix_distance, ruled_distances, threshold


def similar_words(vocab: DataFrame, query: str, completion: bool = False, damp: float = 1.0) -> DataFrame:
    """(word, distance, likeness) of vocabulary words within the query's error threshold.

    Completions compare the query with prefixes of words: beyond one error, the first four letters
    may hold one only; whole words compare as such, and a frequent query word (over 100 times) has no
    frequent words among its likes. A scan of the vocabulary, which is small beside the postings.
    """
    t = int(threshold(len(query)) * damp)
    d = prefix_distance(query, F.col("word"), t) if completion else edit_distance(F.col("word"), F.lit(query), t)
    out = vocab.withColumn("distance", d).where(F.col("distance").between(0, t))
    if completion and t > 1:
        start = F.levenshtein(F.substring("word", 1, 4), F.lit(query[:4]), 1)
        out = out.where((F.col("distance") <= 1) | (start >= 0))
    if not completion and "occ_freq" in vocab.columns:
        own = vocab.where(F.col("word") == query).agg(F.coalesce(F.max("occ_freq"), F.lit(0)).alias("own"))
        out = out.crossJoin(own).where((F.col("own") <= 100) | (F.col("occ_freq") <= 100) | (F.col("word") == query))  # one row
    return out.select("word", F.col("distance").cast("int").alias("distance"), normalised_score(F.col("distance"), len(query), F.char_length("word"), completion).alias("likeness"))


def ruled_words(vocab: DataFrame, query: str, rules: list[tuple[str, str, float]], cutoff: float) -> DataFrame:
    """(word, distance) of vocabulary words within the cutoff of a distance with rules.

    Words too far by plain edits don't reach Python. The words are compared as rows of their own, as the optimiser would push
    a condition on a function of the word below what makes the vocabulary, and so ask once for each posting.
    """
    def compared(batches):
        for b in batches:
            b = b.assign(distance=ruled_distances(query, b["word"].tolist(), rules, cutoff))
            yield b[b["distance"] <= cutoff]

    most = most_edits(query, rules, cutoff)
    known = vocab.groupBy("word").agg(F.count("*").alias("n"))
    near = known.where(F.when(F.col("n") > 0, F.levenshtein("word", F.lit(query), most)) >= 0)  # with n: after the grouping
    return near.select("word").mapInPandas(compared, "word string, distance double")


def deletions(vocab: DataFrame, most: int = 1, prefix: int | None = 7) -> DataFrame:
    """(form, word): each word's first ``prefix`` letters, or all where it is None, with up to ``most`` letters deleted; equal forms are candidates."""
    form = F.array(F.col("word") if prefix is None else F.substring("word", 1, prefix))
    for _ in range(most):
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        form = F.array_distinct(F.concat(form, F.flatten(F.transform(form, cut))))
    return vocab.select(F.explode(form).alias("form"), "word")


def similar_pairs(vocab: DataFrame, most: int = 1, prefix: int | None = None) -> DataFrame:
    """(word, other, distance) of all vocabulary words within ``most`` errors: the words of each deletion form, then their distances.

    Forms are of whole words unless ``prefix`` asks for those of beginnings, with the same pairs: words with a beginning in
    common grow in number with the vocabulary, and their pairs with its square, while few share a form of all their letters.
    """
    forms = deletions(vocab.select("word"), most, prefix)
    groups = forms.groupBy("form").agg(F.collect_list("word").alias("words")).where(F.size("words") > 1)
    pairs = groups.select("words", F.explode("words").alias("word")).select("word", F.explode("words").alias("other")).where("word < other")
    near = pairs.select("word", "other", F.levenshtein("word", "other", most).alias("distance")).where("distance >= 0")
    return near.distinct()


def synonym_groups(lines: DataFrame) -> DataFrame:
    """(group_id, word, starred) from (line_no, value): words split at spaces and commas; * before a word marks it as one
    that is found by the others but does not ask for them. Groups are numbered 2, 4, 6, ... by line."""
    one = lines.select((F.col("line_no") * 2).cast("int").alias("group_id"), F.explode(F.split("value", "[ ,]+")).alias("w")).where("w <> ''")
    return one.select("group_id", F.when(F.col("w").startswith("*"), F.substring("w", 2, 1 << 20)).otherwise(F.col("w")).alias("word"), F.col("w").startswith("*").alias("starred"))


def synonyms_of(groups: DataFrame, word: str) -> DataFrame:
    """(word): the word itself and all members of groups in which it is not starred."""
    mine = groups.where((F.col("word") == word) & ~F.col("starred")).select("group_id").distinct()
    rest = groups.join(mine, "group_id", "left_semi").select("word")
    return rest.union(groups.sparkSession.createDataFrame([(word,)], "word string")).distinct()


def partial_words(vocab: DataFrame, least: int = 6) -> DataFrame:
    """(inner, outer): vocabulary words of ``least`` letters or more inside another word, not at its start; at each place
    of the outer word the longest one."""
    n = F.char_length("word")
    starts = F.when(n > least, F.sequence(F.lit(2), n - least + 1)).otherwise(F.array().cast("array<int>"))
    spots = vocab.select(F.col("word").alias("outer"), F.explode(starts).alias("at")).select("outer", "at", F.expr(f"substring(outer, at, {least})").alias("head"))
    heads = vocab.where(n >= least).select(F.substring("word", 1, least).alias("head")).distinct()
    begun = spots.join(heads, "head", "left_semi")  # places where some word may begin, before all their lengths
    sizes = F.sequence(F.lit(least), F.char_length("outer") - F.col("at") + 1)
    parts = begun.select("outer", "at", F.explode(sizes).alias("size")).select("outer", "at", "size", F.expr("substring(outer, at, size)").alias("inner"))
    known = parts.join(vocab.select(F.col("word").alias("inner")), "inner", "left_semi").select("outer", "at", "size")
    best = known.repartition("outer").groupBy("outer", "at").agg(F.max("size").alias("size"))
    return best.select(F.expr("substring(outer, at, size)").alias("inner"), "outer").distinct()


def partial_specials(partial: DataFrame) -> DataFrame:
    """(word, plain): the special word ``inner:outer`` that stands where its outer word does."""
    return partial.select(F.concat_ws(":", "inner", "outer").alias("word"), F.col("outer").alias("plain"))


#: Special words that a query asks for are looked up by every task up to so many (fixed value).
LOOKED_UP = 1_000_000


def special_postings(postings: DataFrame, specials: DataFrame, most: int = LOOKED_UP) -> DataFrame:
    """Postings of special words (word, plain), each where its plain word stands; looked up where they are no more than ``most``."""
    few = specials.limit(most + 1).count() <= most
    named = specials.select(F.col("word").alias("special"), F.col("plain").alias("word"))
    both = postings.join(F.broadcast(named) if few else named, "word")
    return both.select("doc_id", F.col("special").alias("word"), "position", "score")


def with_partial_words(postings: DataFrame, partial: DataFrame) -> DataFrame:
    """Postings, and for words that hold another one the word ``inner:outer`` at the same place."""
    return postings.select("doc_id", "word", "position", "score").unionByName(special_postings(postings, partial_specials(partial)))


def suggestions(postings: DataFrame, likes: list[DataFrame], gaps: list[bool], k: int = 10) -> DataFrame:
    """(words, score): tuples of one similar word for each keyword, by documents that hold them all, damped by distance.

    likes: (word, distance) for each keyword; gaps[i]: keyword i + 1 must stand within two words of keyword i.
    """
    found = None
    for i, like in enumerate(likes):
        one = postings.join(like.select("word", "distance"), "word").select("doc_id", F.col("word").alias(f"w{i}"), F.col("distance").alias(f"d{i}"), F.col("position").alias(f"p{i}"))
        if i == 0 or not gaps[i - 1]:
            one = one.groupBy("doc_id", f"w{i}", f"d{i}").agg(F.min(f"p{i}").alias(f"p{i}")) if not (i < len(gaps) and gaps[i]) else one
        if found is None:
            found = one
        else:
            found = found.join(one, "doc_id")
            if gaps[i - 1]:
                found = found.where(F.abs(F.col(f"p{i}") - F.col(f"p{i - 1}")).between(1, 2))
    names, costs = [f"w{i}" for i in range(len(likes))], [F.col(f"d{i}") / F.greatest(F.lit(1), F.char_length(f"w{i}")) for i in range(len(likes))]
    per = found.select("doc_id", *names, *[f"d{i}" for i in range(len(likes))]).distinct()
    counted = per.groupBy(*names, *[f"d{i}" for i in range(len(likes))]).agg(F.count("*").alias("n"))
    total = costs[0]
    for c in costs[1:]:
        total = total + c
    out = counted.select(F.concat_ws(" ", *names).alias("words"), F.floor(F.col("n") * F.greatest(F.lit(0.0), 1 - total)).cast("long").alias("score"))
    return out.orderBy(F.col("score").desc(), "words").limit(k)
