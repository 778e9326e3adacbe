"""Excerpts of ranked documents: windows around matched words, joined where they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN


def excerpt_column(text: Column, matches, radius: int, most: int, before: str = "<hl>", after: str = "</hl>", gap: str = "...") -> Column:
    """Array of at most ``most`` excerpts; ``matches`` tells for a lower-cased word column whether it is highlighted.

    A matched word with ``radius`` words on each side is a window; windows that touch are one excerpt.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"{TOKEN}|[^\p{{L}}\p{{N}}_]+"), 0)
    words = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    at = F.filter(F.transform(words, lambda w, i: F.when(matches(F.lower(w)), i)), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<a:int,b:int>>")
    span = lambda i: F.struct(F.greatest(i - radius, F.lit(0)).cast("int").alias("a"), F.least(i + radius, F.size(words) - 1).cast("int").alias("b"))
    def add(acc, i):
        new, last = span(i), F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), new["b"].alias("b"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= new["a"] - 1), grown).otherwise(F.concat(acc, F.array(new)))
    spans = F.slice(F.aggregate(at, empty, add), 1, most)
    first = F.when(F.get(pieces, F.lit(0)).rlike(rf"^{TOKEN}$"), 0).otherwise(1)
    show = lambda p: F.when(p.rlike(rf"^{TOKEN}$") & matches(F.lower(p)), F.concat(F.lit(before), p, F.lit(after))).otherwise(p)
    cut = lambda s: F.array_join(F.transform(F.slice(pieces, s["a"] * 2 + first + 1, (s["b"] - s["a"]) * 2 + 1), show), "")
    return F.transform(spans, lambda s: F.concat(F.when(s["a"] > 0, F.lit(gap)).otherwise(""), cut(s), F.when(s["b"] < F.size(words) - 1, F.lit(gap)).otherwise("")))


def matcher(words: list[str], prefixes: list[str]):
    """Whether a word is one of ``words`` or begins with one of ``prefixes``.

    In a word with ^ before its parts, every part begins an end of the word: ``^flug^hafen`` is flughafen and hafen, not
    flug, and begins as these do. ^^ parts words of their own.
    """
    def matches(w: Column) -> Column:
        out = w.isin(*words) if words else F.lit(False)
        for p in prefixes:
            out = out | w.startswith(p)
        return out
    def ends(word: Column) -> Column:
        parts = F.filter(F.split(word, r"\^"), lambda x: x != "")
        return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), ""))
    return lambda w: F.exists(F.flatten(F.transform(F.split(w, r"\^{2,}"), ends)), matches)


def clean_markers(c: Column) -> Column:
    """^ between the parts of a word goes, ^^ is a hyphen's place, ^^^ ends a sentence."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\^{3,}", " "), r"\^\^", "-"), r"\^", "")


def excerpts(hits: DataFrame, docs: DataFrame, words: list[str], prefixes: list[str], radius: int = 5, most: int = 3) -> DataFrame:
    """Ranked hits with their documents and excerpts."""
    joined = hits.join(docs, "doc_id")
    return joined.withColumn("excerpts", excerpt_column(clean_markers(F.coalesce("text", F.lit(""))), matcher(words, prefixes), radius, most))
