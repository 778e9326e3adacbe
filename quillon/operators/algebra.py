"""Posting-list algebra: matches of a query part given the matches of the parts before it.

``Matches.postings`` has a row for each (doc_id, word, position, score); where earlier parts' scores
are carried, its column ``carried`` has their sum for the document, the same in all its rows. So each
part of a query is planned, and scanned, once. All operators are equi-joins on doc_id, so the shuffle
key is the same throughout and one partitioning serves a whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSTING = ["doc_id", "word", "position", "score"]
#: Position under which a carried score is shown among postings (fixed value).
CARRY_POSITION = 99999


class Matches:
    def __init__(self, postings: DataFrame, carry: DataFrame | None = None):
        """carry: (doc_id, score), a row for each document, if the postings don't have the column yet."""
        if carry is not None:
            postings = postings.join(carry.select("doc_id", F.col("score").cast("long").alias("carried")), "doc_id", "left")
        self.postings = postings
        self.carries = "carried" in postings.columns

    @property
    def carry(self) -> DataFrame | None:
        """(doc_id, score) of the documents with a carried score; None if nothing is carried."""
        if not self.carries:
            return None
        return self.postings.where("carried is not null").groupBy("doc_id").agg(F.max("carried").alias("score"))

    def carried(self) -> Column:
        return F.col("carried") if self.carries else F.lit(None).cast("long")

    def with_carry(self) -> DataFrame:
        """Postings, and a row without word at the last position for each carried score."""
        p = self.postings.select(*POSTING)
        if not self.carries:
            return p
        return p.unionByName(self.carry.select("doc_id", F.lit(None).cast("string").alias("word"), F.lit(CARRY_POSITION).alias("position"), "score"))


def aggregate(how: str) -> Column:
    return F.max("score") if how == "M" else F.sum("score")


def per_doc(m: Matches, how: str = "S") -> DataFrame:
    """(doc_id, score): a document's postings aggregated, carried scores always added. One aggregation."""
    total = aggregate(how).cast("long")
    return m.postings.groupBy("doc_id").agg((total + F.coalesce(F.max("carried"), F.lit(0)) if m.carries else total).alias("score"))


def _docs(p: DataFrame) -> DataFrame:
    return p.select("doc_id").distinct()


def and_(one: Matches, two: Matches, how: str = "S") -> Matches:
    """Postings of the second part in documents of the first; the first part's scores are carried."""
    first = per_doc(one, how).select("doc_id", F.col("score").alias("before"))
    both = two.postings.join(first, "doc_id")
    return Matches(both.select(*POSTING, (F.col("before") + F.coalesce(two.carried(), F.lit(0))).alias("carried")))


def near(one: Matches, two: Matches, low: int, high: int, same_place: bool = False) -> Matches:
    """Postings of the second part whose nearest allowed posting of the first stands ``low`` to ``high`` places before.

    Of each document's postings in the first part, the one at the largest position p1 <= p2 - low
    counts, of several there the best scored; p1 = p2 never matches unless ``same_place``. An as-of
    join as one sort by document and one running last value. Scores add up, carries end here.
    """
    a = one.postings.select("doc_id", (F.col("position") + low).alias("at"), F.lit(0).alias("kind"), F.col("score").alias("s1"), F.struct("position", F.col("score").alias("s")).alias("first"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("score"))
    b = two.postings.select("doc_id", F.col("position").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("s1"), F.lit(None).cast("struct<position:int,s:long>").alias("first"), "word", F.col("position").cast("int").alias("position"), F.col("score").cast("long").alias("score"))
    a = a.withColumns({"s1": F.col("s1").cast("long"), "first": F.col("first").cast("struct<position:int,s:long>")})
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "s1").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("p1", F.last("first", ignorenulls=True).over(w)).where("kind = 1")
    gap = F.col("position") - F.col("p1.position")
    fits = F.col("p1").isNotNull() & (gap <= high)
    if not same_place:
        fits &= gap != 0
    return Matches(found.where(fits).select("doc_id", "word", "position", (F.col("score") + F.col("p1.s")).alias("score")))


def without(one: Matches, two: Matches) -> Matches:
    """Postings of the first part in documents without the second."""
    return Matches(one.postings.join(_docs(two.postings), "doc_id", "left_anti"))


def optionally(one: Matches, two: Matches, how: str = "S") -> Matches:
    """All postings of the first part; documents that also match the second carry its scores."""
    more = per_doc(two, how).select("doc_id", F.col("score").alias("more"))
    both = one.postings.join(more, "doc_id", "left")
    carried = F.when(F.col("more").isNotNull() | one.carried().isNotNull(), F.coalesce("more", F.lit(0)) + F.coalesce(one.carried(), F.lit(0)))
    return Matches(both.select(*POSTING, carried.alias("carried")))


#: Bytes of the largest table behind postings for each task that they are dealt to (fixed value).
SHARE_BYTES = 8 << 20


def _dealt(p: DataFrame) -> DataFrame:
    """Postings dealt by document, to more tasks for a larger table, so that what a task holds doesn't grow with it."""
    leaves = p._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    known = [x for x in sizes if x < 1 << 50]  # Spark's guess of a table it doesn't know is larger
    if not known:
        return p.repartition("doc_id")
    return p.repartition(max(p.sparkSession.sparkContext.defaultParallelism, -(-max(known) // SHARE_BYTES)), "doc_id")


def any_of(parts: list[Matches]) -> Matches:
    """Postings of any part; the same word at the same place once, with the score of the first part that has it.

    A document carries the largest of its parts' carried scores.
    """
    carries = any(p.carries for p in parts)
    both = None
    for k, p in enumerate(parts):
        tagged = p.postings.select(*POSTING, F.lit(k).alias("k"), *([p.carried().alias("carried")] if carries else []))
        both = tagged if both is None else both.unionByName(tagged)
    more = [F.max("carried").alias("carried")] if carries else []
    out = _dealt(both).groupBy("doc_id", "word", "position").agg(F.min_by("score", "k").alias("score"), *more)
    return Matches(_spread(out, F.max) if carries else out.select(*POSTING))


def _spread(postings: DataFrame, how) -> DataFrame:
    """Postings with one carried score for each document."""
    return postings.withColumn("carried", how("carried").over(Window.partitionBy("doc_id"))).select(*POSTING, "carried")


def value_join(parts: list[Matches]) -> Matches:
    """Postings of all parts whose word occurs in every part; documents carry the sum of their parts' carried scores."""
    words = parts[0].postings.select("word").distinct()
    for p in parts[1:]:
        words = words.join(p.postings.select("word").distinct(), "word", "left_semi")
    carries = any(p.carries for p in parts)
    both = None
    for k, p in enumerate(parts):
        tagged = p.postings.select(*POSTING, F.lit(k).alias("k"), *([p.carried().alias("carried")] if carries else []))
        both = tagged if both is None else both.unionByName(tagged)
    if not carries:
        return Matches(both.join(words, "word", "left_semi").select(*POSTING))
    # a part's carry is the same in all its rows of a document, and counts once, also where only another part's word is left
    once = F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("position", "word")) == 1
    summed = both.withColumn("one", F.when(once, F.col("carried"))).withColumn("carried", F.sum("one").over(Window.partitionBy("doc_id")))
    return Matches(summed.join(words, "word", "left_semi").select(*POSTING, "carried"))
