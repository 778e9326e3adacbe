"""Substring dedup by recompression.

Rounds rename runs of one symbol and then pairs of adjacent symbols (a symbol's class, a bit of its
name, says whether it may open or close a pair), so equal passages get the same symbols inside,
whatever stands around them. A name is computed from what it stands for and so agrees on all
executors. Each window of words is represented by one interior symbol of its highest round with its
neighbours, chosen by the window's content alone; a Spark round tells which such names several
documents share, and a second one tells these windows apart by 96 bits of hashes of their words and
finds their first document.

Both rounds answer to the part of the documents a question came from, by tables in the shared folder,
so texts are never shuffled. Windows travel packed: a part sends each bucket of names its distinct
windows in a row, and the bucket answers a part in a row. Documents are first written as a table in
which every row has the label of its part; what partitions later jobs read that table in doesn't matter.
"""

from __future__ import annotations

import math
import re
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, framed, new_path, packed, rows, runs, stored, texts, unframed, unpacked

WINDOW, ROUNDS = 13, 1
#: Names a task gathers before it sends them.
BUFFER = 1_500_000
#: Bytes of text for each bucket of window names, which a task holds at once.
BUCKET_BYTES = 16 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


class Batch:
    """Word names of several texts in one array, a separator (class 2: joins nothing) after each text."""

    def __init__(self, text: list[bytes]):
        self.words = [t.split() for t in text]
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(text))
        self.start = np.cumsum(self.sizes + 1) - self.sizes - 1
        total = int(self.sizes.sum()) + len(text)
        mark = np.zeros(total, dtype=bool)
        mark[self.start + self.sizes] = True
        both = np.zeros((2, total), dtype=np.uint64)
        both[:, ~mark] = np.frombuffer(b"".join(h for w in self.words for h in map(xxhash.xxh3_128_digest, w)), dtype=np.uint64).reshape(-1, 2).T
        both[0, mark] = np.arange(len(text), dtype=np.uint64)
        (self.names, self.checks), self.mark = both, mark

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First places of all windows of ``size`` words, and the text each is in."""
        n = np.maximum(self.sizes - size + 1, 0)
        who = np.repeat(np.arange(len(n)), n)
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.start[who], who

    def _over(self, values: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
        out = np.zeros(max(0, len(values) - size + 1), dtype=np.uint64)
        for j in range(size):
            out *= by
            out += values[j : len(values) - size + 1 + j]
        return out

    def window_names(self, size: int, at: np.ndarray) -> np.ndarray:
        return mix(self._over(self.names, size, _M[0])[at] + _M[3])

    def window_checks(self, size: int, at: np.ndarray) -> np.ndarray:
        """32 bits more of the windows, from the other half of the words' bits."""
        return (mix(self._over(self.checks, size, _M[4])[at] + _M[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def one_round(names: np.ndarray, mark: np.ndarray):
    """One renaming of runs, then of pairs: names, marks, and for the windows the maps from old to new places."""
    new = np.append(True, (names[1:] != names[:-1]) | mark[1:] | mark[:-1]) if len(names) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    long = np.diff(np.append(first, len(names)))
    run_of = np.cumsum(new) - 1
    runs, marks = names[first], mark[first]
    runs = np.where(long > 1, mix(runs + _M[4] * long.astype(np.uint64)), runs)
    kind = np.where(marks, 2, ((runs * _M[0]) >> np.uint64(40)).astype(np.int64) & 1)
    second = np.append(False, (kind[1:] == 1) & (kind[:-1] == 0)) if len(runs) else np.zeros(0, bool)
    lead = np.flatnonzero(~second)
    pair_of = np.cumsum(~second) - 1
    out = runs[lead].copy()
    opened = np.flatnonzero(second)
    out[pair_of[opened]] = mix(runs[opened - 1] * _M[0] + runs[opened] * _M[3] + _M[4])
    return out, marks[lead], run_of, kind, pair_of


def anchors(batch: Batch, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first places, texts, names) of all windows' representatives, and each window's own name.

    [lo, hi) are the symbols that the window's content fixes. A run at an edge may go on outside and
    goes; then a symbol at the left that may close a pair with its outer neighbour, and one at the
    right that may open one. A window keeps the highest round that leaves three symbols or more and
    takes, of those with both neighbours fixed, the one of the smallest name, with the neighbours.
    A window for which no round leaves so many, as in long runs, stands for itself.
    """
    at, who = batch.windows(size)
    whole = batch.window_names(size, at) if len(at) else np.zeros(0, dtype=np.uint64)
    chosen = whole.copy()
    names, mark, lo, hi = batch.names, batch.mark, at, at + size
    live = np.arange(len(at))
    for _ in range(rounds):
        if not len(live):
            break
        names, mark, run_of, kind, pair_of = one_round(names, mark)
        lo, hi = run_of[lo] + 1, run_of[hi - 1]
        ok = hi > lo
        live, lo, hi = live[ok], lo[ok], hi[ok]
        lo, hi = lo + (kind[lo] == 1), hi - (kind[hi - 1] == 0)
        ok = hi > lo
        live, lo, hi = live[ok], lo[ok], hi[ok]
        lo, hi = pair_of[lo], pair_of[hi - 1] + 1
        ok = hi - lo >= 3
        live, lo, hi = live[ok], lo[ok], hi[ok]
        if not len(live):
            break
        order, best = mix(names + _M[3]), lo + 1
        least = order[best]
        for j in range(2, int((hi - lo).max()) - 1):
            inner = lo + j
            value = order[np.minimum(inner, len(order) - 1)]
            better = (inner < hi - 1) & (value < least)
            best, least = np.where(better, inner, best), np.where(better, value, least)
        triple = np.zeros(len(names), dtype=np.uint64)
        triple[1:-1] = mix((names[:-2] * _M[0] + names[1:-1]) * _M[0] + names[2:] + _M[1])
        chosen[live] = triple[best]
    return at, who, chosen, whole


def _by_part(batches, each):
    """What ``each`` makes of the rows of one part, (doc_id, text) batches and the part's label, for each run of them."""

    def parts():
        for batch in batches:
            p = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield int(p[a]), batch.slice(a, b - a)

    for p, found in groupby(parts(), key=lambda x: x[0]):
        yield from each((batch for _, batch in found), p)


def _sent(batches, p, size, rounds):
    """(name, from): names of a part's windows; from is twice the part, odd if two documents here have the name."""
    held, n = [], 0

    def out():
        names, docs = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        last = np.append(first[1:], len(names)) - 1
        return pa.RecordBatch.from_arrays([pa.array(names[first].view(np.int64)), pa.array((docs[first] != docs[last]) + np.int64(2 * p))], names=["name", "source"])

    for ids, text in rows(batches, most_rows=300, most_bytes=1 << 20):
        b = Batch(text)
        _, who, chosen, _ = anchors(b, size, rounds)
        null = np.array([d is None for d in ids])
        doc = np.array([d or 0 for d in ids], dtype=np.int64)[who]
        new = np.append(True, (chosen[1:] != chosen[:-1]) | (who[1:] != who[:-1])) if len(who) else np.zeros(0, bool)
        new &= ~null[who]
        held.append((chosen[new], doc[new]))
        n += int(new.sum())
        if n > BUFFER:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _shared(batches):
    """The names several documents have, for each part that asked."""
    for name, source in runs(batches):
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        sizes = np.diff(np.append(first, len(name)))
        many = np.repeat((sizes > 1) | (np.maximum.reduceat(source & 1, first) > 0), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(source[many] >> 1), pa.array(name[many])], names=["p", "name"])


def _told(path: str, p: int, column: str) -> list[pa.ChunkedArray]:
    """What the shared table tells this part, file by file. Schemes are those Arrow opens (file, hdfs, s3, gs, abfss)."""
    import pyarrow.fs as pfs
    import pyarrow.parquet as pq

    fs, root = pfs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    found = fs.get_file_info(pfs.FileSelector(f"{root}/p={p}", allow_not_found=True))
    return [pq.ParquetFile(fs.open_input_file(f.path)).read(columns=[column]).column(column) for f in found if f.base_name.endswith(".parquet")]


def _packed(names: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows sorted by name, which so differ by little."""
    return framed([packed(np.diff(names, prepend=np.uint64(0))), *map(packed, more)])


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    names, *more = unframed(data)
    return [np.cumsum(unpacked(names), dtype=np.uint64), *(unpacked(x, kind) for x, kind in zip(more, kinds))]


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of ``values`` in the sorted ``among``; -1 where missing."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _asked(batches, p, path, size, rounds, buckets):
    """To each bucket this part's windows whose representative is shared: name, check, first document here and how far the last is."""
    shared = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *(c.to_numpy() for c in _told(path, p, "name"))]))
    held, n = [], 0

    def out():
        names, checks, docs = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((docs, checks, names))
        names, checks, docs = names[order], checks[order], docs[order]
        first = _changes(names, checks)
        last = np.append(first[1:], len(names)) - 1
        cols = [names[first], checks[first], docs[first], docs[last] - docs[first]]
        bucket = ((cols[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        found, held_bytes = [], 0
        for a, b in pairwise([*_changes(bucket).tolist(), len(bucket)]):
            found.append((int(bucket[a]), p, _packed(*(c[a:b] for c in cols))))
            held_bytes += len(found[-1][2])
            if held_bytes > 4 << 20 or b == len(bucket):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "p", "data"])
                found, held_bytes = [], 0

    for ids, text in rows(batches, most_rows=300, most_bytes=1 << 20):
        b = Batch(text)
        at, who, chosen, whole = anchors(b, size, rounds)
        known = (_within(chosen.view(np.int64), shared) >= 0) & ~np.array([d is None for d in ids])[who]
        if known.any():
            held.append((whole[known], b.window_checks(size, at[known]), np.array([d or 0 for d in ids], dtype=np.int64)[who[known]]))
            n += len(held[-1][0])
        if n > BUFFER:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _earliest(batches):
    """To each part those of its windows in this bucket that it has in a later document than their first one, with that."""
    asked = []
    for batch in batches:
        for p, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            cols = _unpacked(data, np.int32, np.int64, np.int64)
            asked.append([*cols, np.full(len(cols[0]), p)])
    if not asked:
        return
    names, checks, low, more, p = (np.concatenate(x) for x in zip(*asked))
    order = np.lexsort((checks, names))
    names, checks, low, more, p = (c[order] for c in (names, checks, low, more, p))
    first = _changes(names, checks)
    least = np.repeat(np.minimum.reduceat(low, first), np.diff(np.append(first, len(names))))
    later = np.flatnonzero(low + more > least)
    later = later[np.argsort(p[later], kind="stable")]
    p, *cols = (c[later] for c in (p, names, checks, least))
    once = _changes(p, *cols)  # a part may ask several times
    p, *cols = (c[once] for c in (p, *cols))
    for a, b in pairwise([*_changes(p).tolist(), len(p)]):
        yield pa.RecordBatch.from_arrays([pa.array([int(p[a])]), pa.array([_packed(*(c[a:b] for c in cols))], pa.binary())], names=["p", "data"])


def _same(names, checks, among, among_checks) -> np.ndarray:
    """Places of (name, check) among those sorted by name; -1 where missing."""
    at = _within(names, among)
    while True:  # one step for each further entry of the same name
        wrong = np.flatnonzero(at >= 0)
        wrong = wrong[among_checks[at[wrong]] != checks[wrong]]
        if not len(wrong):
            return at
        after = at[wrong] + 1
        more = (after < len(among)) & (among[np.minimum(after, len(among) - 1)] == names[wrong])
        at[wrong] = np.where(more, after, -1)


def _cut(batches, p, path, size):
    told = [_unpacked(x, np.int32, np.int64) for c in _told(path, p, "data") for x in c.to_pylist()]
    names, checks, low = (np.concatenate(x) for x in zip([np.zeros(0, k) for k in (np.uint64, np.int32, np.int64)], *told))
    order = np.argsort(names, kind="stable")
    names, checks, low = names[order], checks[order], low[order]
    for ids, text in rows(batches, most_rows=300, most_bytes=1 << 20):
        b = Batch(text)
        at, who = b.windows(size)
        covered = np.zeros(len(b.names) + 1, dtype=np.int64)
        if len(at) and len(names):
            doc = np.array([-(1 << 63) if d is None else d for d in ids], dtype=np.int64)[who]
            found = _same(b.window_names(size, at), b.window_checks(size, at), names, checks)
            hit = at[(found >= 0) & (low[found] < doc)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + size, -1)
        covered = np.cumsum(covered)[:-1] > 0
        kept, spans = [], []
        for ws, a, n in zip(b.words, b.start.tolist(), b.sizes.tolist()):
            c = covered[a : a + n]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0])))).reshape(-1, 2)
            spans.append([{"a": x, "b": y} for x, y in edges.tolist()])
            kept.append(b" ".join(ws if not len(edges) else [w for w, gone in zip(ws, c.tolist()) if not gone]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(b.sizes), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "removed", "kept"])


def repeated_spans(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, removed, kept) of each row: removed spans of words as (start, end), kept words joined by a space.

    A window is ``size`` words between ASCII white space. Every word goes that a window covers which
    also starts in a document of smaller doc_id, judged on the input. Null text has no words; rows with
    null doc_id are not compared and keep all words; of repeated rows with one doc_id neither is
    earlier; texts of fewer words have no window; other columns are left out. ``bucket_bytes`` changes no result.
    """
    spark = docs.sparkSession
    base = stored(texts(docs, p=F.spark_partition_id().cast("long")), "parts", compression="zstd")
    names = base.mapInArrow(lambda it: _by_part(it, lambda part, p: _sent(part, p, size, rounds)), "name long, source long")
    shared = names.repartition("name").sortWithinPartitions("name").mapInArrow(_shared, "p long, name long")
    # dealt by the label itself: hashing so few values would give some tasks several times the others' share
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to_p = lambda df, path: df.repartitionById(tasks, F.col("p").cast("int")).sortWithinPartitions("p").write.partitionBy("p").parquet(path)
    first, second = new_path(spark, "shared-names"), new_path(spark, "first-documents")
    to_p(shared, first)
    buckets = min(1 << 20, max(1, math.ceil((base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / bucket_bytes)))
    asked = base.mapInArrow(lambda it: _by_part(it, lambda part, p: _asked(part, p, first, size, rounds, buckets)), "bucket int, p long, data binary")
    found = asked.repartitionById(buckets, "bucket").mapInArrow(_earliest, "p long, data binary")
    to_p(found, second)
    delete(spark, first)
    return base.mapInArrow(lambda it: _by_part(it, lambda part, p: _cut(part, p, second, size)), "doc_id long, n_words long, removed array<struct<a:int,b:int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
