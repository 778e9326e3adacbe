"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text. Each Spark round looks one digit
deeper, only into groups still too large for a task, whose rows alone go on; digits widen from round to round. A group whose
texts all end within its digits is a group of equal texts. What is small enough is dealt to tasks by
its digits, and the same splitting goes on there. Texts are compared byte by byte; no digest decides.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, held, lookup, sliced, stored, texts

#: Bytes of the digits in the first round, and how many times as many the next one has.
FIRST, WIDER = 16, 4
#: Bounds of the size from which a group is split further, of bytes and of rows.
LEAST_BYTES, MOST_BYTES, LEAST_ROWS = 1 << 20, 64 << 20, 200
_SPACES = SPACES.encode()

OUT = "doc_id long, uid long, keep_id long, group_size long, kept boolean, text_sha256 string"


def split_equal(items: list[bytes]) -> list[list[int]]:
    """Indexes of equal items: recursive splitting by successive digits of 8, 16, 32, ... bytes."""
    done, todo = [], [(list(range(len(items))), 0, 8)]
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1:
            done.append(group)
            continue
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(items[i][at : at + width], []).append(i)
        for digit, part in parts.items():
            if len(digit) < width or len(part) == 1:  # ended, or alone
                done.append(part)
            else:
                todo.append((part, at + width, width * 2))
    return done


def _settle(batches):
    """Rows sorted by digits in, their groups out; holds the rows of one digit group at a time."""
    key, group_rows = None, []

    def judged():
        for group in split_equal([x[3] for x in group_rows]) if len(group_rows) > 1 else [[0]] * bool(group_rows):
            best = min(group, key=lambda i: (-group_rows[i][2], group_rows[i][0] is not None, group_rows[i][0] or 0, group_rows[i][1]))
            sha = hashlib.sha256(group_rows[best][3]).hexdigest()
            for i in group:
                yield group_rows[i][0], group_rows[i][1], group_rows[best][0], len(group), i == best, sha

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["doc_id", "uid", "keep_id", "group_size", "kept", "text_sha256"])

    out = []
    for b in sliced(batches):
        for k, ended, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (k, ended) != key:
                out += judged()
                key, group_rows = (k, ended), []
            group_rows.append(row)
        if len(out) > 5000:
            yield batch(out)
            out = []
    out += judged()
    if out:
        yield batch(out)


def _normalised(batches):
    held(None, None)
    for batch in sliced(batches):
        text = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.decode()) for t in text], pa.int64()), pa.array([t.translate(None, _SPACES) for t in text], pa.binary())], names=["doc_id", "uid", "n_cp", "norm"])


def exact_groups(docs: DataFrame, group_bytes: int | None = None, group_rows: int | None = None, uid_col: str | None = None) -> DataFrame:
    """(doc_id, uid, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when the same after deleting ASCII white space; null counts as empty, so null,
    empty and blank texts are one group. The row with most code points stays, then the one with the
    smallest doc_id (null first), then the first of repeated rows; exactly one row of a group has
    kept = true. uid is the row's place in the input, or ``uid_col`` where one is named. Other columns are left out. Groups beyond
    ``group_bytes`` or ``group_rows`` (default: a quarter of a shuffle partition's share, within
    fixed bounds) are split by a further round.
    """
    spark = docs.sparkSession
    base = texts(docs, uid=F.col(uid_col) if uid_col else F.monotonically_increasing_id()).select("doc_id", "uid", "text")
    norm = base.mapInArrow(_normalised, "doc_id long, uid long, n_cp long, norm binary")
    digits = lambda n: F.substring("norm", 1, n)
    base = stored(norm.withColumns({"size": F.octet_length("norm"), "key": digits(FIRST)}), "normalised", compression="zstd")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    group_bytes = group_bytes or min(max(total // parts, LEAST_BYTES), MOST_BYTES)
    group_rows = group_rows or max(n // parts, LEAST_ROWS)
    level, width, small, whole, groups = base.withColumn("ended", F.col("size") <= FIRST), FIRST, None, None, None
    while True:
        sums = level.groupBy(F.col("key").alias("k"), F.col("ended").alias("e")).agg(F.count("*").alias("c"), F.sum("size").alias("b"))
        # a row for each group beyond the limits, so few beside the documents
        large = stored(sums.where((F.col("c") > 1) & ((F.col("b") > group_bytes) | (F.col("c") > group_rows))).select("k", "e", F.concat_ws("-", F.lit(width), F.monotonically_increasing_id()).alias("g")), "radix")
        on = (F.col("key") == F.col("k")) & (F.col("ended") == F.col("e"))
        none, beyond = large.isEmpty(), lookup(large, 10_000)
        rest = (level if none else level.join(beyond, on, "left_anti")).select("key", "ended", "doc_id", "uid", "n_cp", "norm")
        small = rest if small is None else small.unionByName(rest)
        if none:
            break
        equal = level.join(beyond.where("e"), on).select("g", "doc_id", "uid", "n_cp")
        shas = large.where("e").select("g", F.sha2("k", 256).alias("sha"))
        whole, groups = (equal, shas) if whole is None else (whole.unionByName(equal), groups.unionByName(shas))
        if large.where("not e").isEmpty():
            break
        width *= WIDER  # only the rows of groups still open go on, as a table of their own
        wider = level.join(beyond.where("not e"), on, "left_semi").withColumns({"key": digits(width), "ended": F.col("size") <= width})
        level = stored(wider, "open", compression="zstd")
    out = small.repartition("key", "ended").sortWithinPartitions("key", "ended").mapInArrow(_settle, OUT)
    if whole is None:
        return out
    best = whole.groupBy("g").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_cp")).alias("n"), "doc_id", "uid")).alias("best"))
    best = stored(best.join(groups, "g"), "largest")
    ended = whole.join(lookup(best, 10_000), "g").select("doc_id", "uid", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.unionByName(ended)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept; see exact_groups."""
    # a table, as a second reading of the input may number its rows otherwise
    marked = stored(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered", compression="zstd")
    gone = exact_groups(marked, uid_col="__uid").where(~F.col("kept")).select(F.col("uid").alias("__gone"))
    return marked.join(gone, F.col("__uid") == F.col("__gone"), "left_anti").drop("__uid")
