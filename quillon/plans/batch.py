"""Running lists of queries: answers with times, and the postings a query's words have."""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import mean, median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import query as Q
from .session import Index


@dataclass
class Run:
    query: str
    seconds: float
    n_hits: int
    n_completions: int
    error: str = ""


def answer_queries(index: Index, queries: list[str], **parameters) -> list[Run]:
    """Each query once, in order; one that does not parse is reported and the rest go on."""
    out = []
    for q in queries:
        began = time.time()
        try:
            a = index.answer(Q.Parameters(query=q, **parameters))
            out.append(Run(q, time.time() - began, a["n_hits"], a["n_completions"]))
        except Q.QueryError as e:
            out.append(Run(q, time.time() - began, 0, 0, str(e)))
    return out


def statistics(runs: list[Run]) -> dict:
    times = [r.seconds for r in runs if not r.error] or [0.0]
    return {"queries": len(runs), "errors": sum(bool(r.error) for r in runs), "mean_s": mean(times), "median_s": median(times), "max_s": max(times), "with_hits": sum(r.n_hits > 0 for r in runs)}


def prefix_volumes(index: Index, prefixes: DataFrame) -> DataFrame:
    """(prefix, n_postings) for a table of prefixes: words meet their own beginnings in an equi-join, whatever the prefixes' lengths."""
    sizes = prefixes.select(F.char_length("prefix").alias("n")).distinct()
    lengths = [r.n for r in sizes.collect()]  # as many rows as there are different lengths
    if not lengths:
        return prefixes.select("prefix", F.lit(0).cast("long").alias("n_postings"))
    words = index.vocabulary.select("occ_freq", F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in lengths]))).alias("prefix"))
    return prefixes.join(words, "prefix", "left").groupBy("prefix").agg(F.coalesce(F.sum("occ_freq"), F.lit(0)).alias("n_postings"))


def queries_by_volume(index: Index, prefixes: DataFrame, least: int, most: int) -> DataFrame:
    """The prefixes whose words have between ``least`` and ``most`` postings."""
    return prefix_volumes(index, prefixes).where(F.col("n_postings").between(least, most))
