"""N-gram Jaccard join over R-trees of count vectors.

A document is the set of its shingles. Shingles are hashed into groups, more groups the larger the
set; a set's counts by group are a point, and the overlap of two sets is at most the sum of the
coordinates' minima, of points as of the boxes of an R-tree. Pairs whose bound suffices are verified
on the sets themselves.

Spark prepares the trees in three exact steps. First it tells which shingles stand in several
documents: only these can be in an overlap, so a document without enough of them has no link and
leaves, and vectors and sets hold no others from there on. Then documents are dealt to cells: with
all shingles in one order, rarest first, linked sets share one of the first n - ceil(limit * n) + 1,
so each open set goes, as a point, to the cells of those of them that several documents have. An
R-tree joins the points of a cell; what the cells leave connected is a cluster, and the sets of a
cluster are joined once more by an R-tree, now verified. Shingles too frequent for a cell connect all
their documents to one cluster, and clusters too large for a task are spread over pages: joined first
inside pages, then over one member of each component, and exactly at the end, each member outside the
cluster's main component against all pages whose boxes allow a link. Links come as spanning forests;
no group's pairs are ever spelled out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, contracted, grouped, lean, lookup, packed, rows, runs, sliced, stored, texts, unpacked

FANOUT = 16
#: Of a page: sets and shingles at most (a single larger set is a page of its own).
PAGE_SETS, PAGE_SHINGLES = 2000, 1_000_000
#: Documents and shingles that one unit of the counting round holds; bytes of a bucket of it.
UNIT_DOCS, UNIT_SHINGLES, BUCKET_BYTES = 60_000, 1_500_000, 64 << 20
#: Documents from which a shingle is too frequent for a cell.
HOT = 255
#: Entries of a bucket that are counted at once.
RANGE = 500_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LOW, _16 = np.uint64(0xFFFF), np.uint64(16)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[4]
    x = (x ^ (x >> np.uint64(27))) * _C[5]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words (A-Z lower-cased); of fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * _C[0] + mix(h[i : len(h) - size + 1 + i] + _C[1])
    return np.unique(mix(out))


# -- count vectors and trees -----------------------------------------------------------------------


def groups_of(n: int) -> int:
    """Groups for a set of ``n``: a power of two, so that a group counts from 3 to 6 of them."""
    return 1 << max(4, math.ceil(math.log2(max(n, 1) / 6)))


def vector(s: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group, the group being the upper bits of 48, so that neighbouring groups add up to half as many."""
    return np.bincount((s >> np.uint64(48 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v.reshape(*v.shape[:-1], groups, -1).sum(-1)


class RTree:
    """Bulk-loaded over (vectors, sizes) in order of size: boxes of FANOUT points, and of FANOUT boxes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0] // 2, sizes))
        self.v, self.n = vectors[self.order], sizes[self.order]
        self.levels = []
        high, low, most = self.v, self.n, self.n
        while len(high) > FANOUT:
            cuts = np.arange(0, len(high), FANOUT)
            high, low, most = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, low, most))

    def search(self, v: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given) whose overlap bound allows a link with (v, n), best bound first, and bounds."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.v))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low, most = self.levels[k]
            at = at[self._fits(high[at], low[at], most[at], v, n, num, den)[0]]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.v))]
        fits, bound = self._fits(self.v[at], self.n[at], self.n[at], v, n, num, den)
        at, bound = at[fits], bound[fits]
        best = np.argsort(-bound, kind="stable")
        return self.order[at[best]], bound[best]

    @staticmethod
    def _fits(high, low, most, v, n, num, den):
        bound = np.minimum(high, v).sum(1)
        return (bound * (num + den) >= num * (low + n)) & (most * den >= num * n) & (n * den >= num * low), bound


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int, na: int | None = None, nb: int | None = None) -> bool:
    """Whether sets of na and nb shingles link, of which a and b are those that several documents have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * ((len(a) if na is None else na) + (len(b) if nb is None else nb) - both)


def join_sets(sets: list[np.ndarray], sizes, num: int, den: int, known=None, side=None) -> list[tuple[int, int]]:
    """Links that span the components of linked sets, verified.

    sizes: of the whole sets, of which ``sets`` may lack what no other set has; known: groups that
    count as connected beforehand; side: link only sets of side 0 with others.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sets) == 2 and known is None:
        return [(0, 1)] if linked(sets[0], sets[1], num, den, int(sizes[0]), int(sizes[1])) else []
    groups = groups_of(int(np.median(sizes)))
    vectors = np.stack([vector(s, groups) for s in sets]).astype(np.int32)
    tree, out = RTree(vectors, sizes), []
    label = np.arange(len(sets)) if known is None else np.unique(np.asarray(known), return_inverse=True)[1]
    for i in range(len(sets)):
        if side is not None and side[i]:
            continue
        found, _ = tree.search(vectors[i], int(sizes[i]), num, den)
        found = found[(label[found] != label[i]) & ((found > i) if side is None else True)]
        while len(found):
            j = int(found[0])
            if linked(sets[i], sets[j], num, den, int(sizes[i]), int(sizes[j])):
                label[label == label[j]] = label[i]
                out.append((i, j))
                found = found[label[found] != label[i]]
            else:
                found = found[1:]
    return out


# -- which shingles several documents have ---------------------------------------------------------

UNITS = "bucket long, unit long, kind int, data binary"
DOCS, LOCAL, SINGLE, MANY = range(4)


def _rows(found, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def _unit_rows(found):
    return _rows(found, ["bucket", "unit", "kind", "data"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()])


def _units(batches, size, buckets):
    """Shingles of units of documents by bucket: 48 bits of the shingle over 16 of its document's place in the unit.

    Of a shingle several documents of a unit have, the bucket gets one entry, with their number, and the unit
    keeps the rest; so a bucket has of no shingle more entries than there are units. A set that a unit has
    seen already adds nothing but its place, beside the first one's.
    """
    from pyspark import TaskContext

    unit = TaskContext.get().partitionId() << 24
    ids, ns, twins, held, seen, total = [], [], [], [], {}, 0

    def out():
        e = np.concatenate([*held, np.zeros(0, dtype=np.uint64)])
        e.sort()
        h = e >> _16
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(h)))
        several = first[c > 1]
        doc = b"".join(np.array(x, dtype=np.int64).tobytes() for x in (ids, ns, twins))
        found = [(unit % buckets, unit, DOCS, doc), (unit % buckets, unit, LOCAL, packed(e[np.repeat(c > 1, c)]))]
        for kind, part in ((SINGLE, e[first[c == 1]]), (MANY, h[several] << _16 | np.minimum(c[c > 1], 0xFFFF).astype(np.uint64))):
            cuts = np.searchsorted(((part >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24), np.arange(buckets + 1))
            found += [(b, unit, kind, packed(part[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        return _unit_rows(found)

    for some, text in rows(batches, most_rows=500, most_bytes=4 << 20):
        for d, t in zip(some, text):
            s = shingles(t, size)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            twin = seen.setdefault(digest, len(ids)) if d is not None and len(s) else -1
            if twin == len(ids):
                top = s & ~_LOW
                if (top[1:] == top[:-1]).any():  # two that agree in 48 bits
                    top = np.unique(top)
                held.append(top | np.uint64(len(ids)))
                total += len(s)
            ids.append(d or 0), ns.append(len(s) if d is not None else -1 - len(s)), twins.append(twin)
            if len(ids) >= UNIT_DOCS or total >= UNIT_SHINGLES:
                yield out()
                unit, ids, ns, twins, held, seen, total = unit + 1, [], [], [], [], {}, 0
    if ids:
        yield out()


def _counted(batches):
    """Of each bucket, to each unit that asked, the entries of shingles several documents have, with how many (up to HOT)."""
    for _, group in grouped(batches):
        yield from _bucket(group)


def _bucket(group):
    """The answers of one bucket; counted by ranges of hashes one after another, as the columns beside the entries take several times their room."""
    out = [(0, u, k, d) for _, u, k, d in group if k in (DOCS, LOCAL)]
    group = [x for x in group if x[2] in (SINGLE, MANY)]
    if group:
        parts = [unpacked(x[3]) for x in group]
        is_many = np.array([x[2] == MANY for x in group])
        low, high = (int(f(p[i] >> _16 for p in parts)) for f, i in ((min, 0), (max, -1)))
        n = 1 + sum(map(len, parts)) // RANGE
        edges = np.array([low + (high + 1 - low) * i // n << 16 for i in range(1, n)], dtype=np.uint64)
        cuts = [[0, *np.searchsorted(p, edges).tolist(), len(p)] for p in parts]
        kept = [[] for _ in parts]
        for i in range(n):
            for k, *found in _several([p[c[i] : c[i + 1]] for p, c in zip(parts, cuts)], is_many):
                kept[k].append(found)
        for x, found in zip(group, kept):
            if found:
                e, df = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                out.append((0, x[1], x[2], len(e).to_bytes(8, "little") + df.tobytes() + packed(e)))
    if out:
        yield _unit_rows(out)


def _several(parts, is_many):
    """(part, entries, numbers of documents) of the shingles several documents have; parts and entries in their order."""
    e, who = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), list(map(len, parts)))
    if not len(e):
        return
    order = np.argsort(e >> _16, kind="stable")
    e, who = e[order], who[order]
    h = e >> _16
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    df = np.add.reduceat(np.where(is_many[who], (e & _LOW).astype(np.int64), 1), first)
    df = np.repeat(df, np.diff(np.append(first, len(h))))
    keep = df > 1
    e, who, df = e[keep], who[keep], np.minimum(df[keep], HOT).astype(np.uint8)
    order = np.argsort(who, kind="stable")
    e, df, who = e[order], df[order], who[order]
    cuts = np.searchsorted(who, np.arange(len(parts) + 1)).tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield k, e[a:b], df[a:b]


SETS = "doc_id long, n long, twin long, hashes binary, often binary"


def _sets(batches, num, den):
    """A row for each document; with the first document of its unit that has the same set, if another; with its shared shingles, and how many documents have each, where they are enough for a link."""
    for _, group in grouped(batches):
        yield from _unit_sets(group, num, den)


def _unit_sets(group, num, den):
    of = lambda kind: [x[2] for x in group if x[1] == kind]
    doc = of(DOCS)[0]
    m = len(doc) // 24
    ids, ns, twins = np.frombuffer(doc, dtype=np.int64).reshape(3, m)
    local = unpacked(of(LOCAL)[0])
    pairs = {k: [(unpacked(d[8 + int.from_bytes(d[:8], "little") :]), np.frombuffer(d, dtype=np.uint8, offset=8, count=int.from_bytes(d[:8], "little"))) for d in of(k)] for k in (SINGLE, MANY)}
    e, often = (np.concatenate([*(p[k] for p in pairs[SINGLE]), np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.uint8)))
    if len(local):
        many, df = (np.concatenate([p[k] for p in pairs[MANY]]) for k in (0, 1))
        order = np.argsort(many)
        e, often = np.concatenate([e, local]), np.concatenate([often, df[order][np.searchsorted(many[order] >> _16, local >> _16)]])
    place = (e & _LOW).astype(np.int64)
    order = np.lexsort((e, place))
    h, often, place = (e >> _16)[order], often[order], place[order]
    cuts = np.searchsorted(place, np.arange(m + 1))
    is_open = (np.diff(cuts) * den >= num * ns) & (ns > 0)
    cuts = cuts.tolist()
    for at in range(0, m, 1000):
        span = range(at, min(at + 1000, m))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(ids[i]) if ns[i] >= 0 else None for i in span], pa.int64()),
                pa.array([int(ns[i]) if ns[i] >= 0 else int(-1 - ns[i]) for i in span], pa.int64()),
                pa.array([int(ids[twins[i]]) if twins[i] >= 0 and ids[twins[i]] != ids[i] else None for i in span], pa.int64()),
                pa.array([h[cuts[i] : cuts[i + 1]].tobytes() if is_open[i] else None for i in span], pa.binary()),
                pa.array([often[cuts[i] : cuts[i + 1]].tobytes() if is_open[i] else None for i in span], pa.binary()),
            ],
            names=["doc_id", "n", "twin", "hashes", "often"],
        )


# -- cells -----------------------------------------------------------------------------------------

CELLS = "cell long, doc_id long, n long, v binary"


def _prefix(h: np.ndarray, often: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first n - ceil(limit * n) + 1 shingles, rarest first, those that several documents have."""
    take = n + 1 + (-num * n // den) - (n - len(h))
    order = np.lexsort((h, often))[:take]
    return h[order], often[order]


def _dealt(batches, num, den, frequent, hot):
    """The cells of each open set, with its point; if ``hot``, the shingles too frequent for cells instead."""
    for batch in sliced(batches):
        cell, doc, size, point = [], [], [], []
        for d, n, h, often in zip(*(c.to_pylist() for c in batch.columns)):
            h, often = np.frombuffer(h, dtype=np.uint64), np.frombuffer(often, dtype=np.uint8)
            first, level = _prefix(h, often, n, num, den)
            first = first[(level >= frequent) == hot]
            if not len(first):
                continue
            v = b""
            if not hot:
                groups = groups_of(n)
                while (counts := vector(h, groups)).max() > 15:
                    groups *= 2
                v = (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
            cell.append(first), doc.append(np.full(len(first), d)), size.append(np.full(len(first), n))
            point += [v] * len(first)
        if cell:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int64)), pa.array(np.concatenate(doc).astype(np.int64)), pa.array(np.concatenate(size).astype(np.int64)), pa.array(point, pa.binary())], names=["cell", "doc_id", "n", "v"])


def _counts(v: list[bytes], groups: int) -> np.ndarray:
    """The rows of counts that points of as many groups are packed from, two to a byte."""
    both = np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, groups // 2)
    return np.stack([both & 15, both >> 4], axis=2).reshape(-1, groups)


def _fit(v: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (a, b) of points the sum of minima lets pass; the finer point of a pair is folded."""
    ok = np.flatnonzero((n[a] * den >= num * n[b]) & (n[b] * den >= num * n[a]))
    if not len(ok):
        return ok
    size = np.fromiter(map(len, v), dtype=np.int64, count=len(v)) * 2
    row, table = np.zeros(len(v), dtype=np.int64), {}
    for g in np.unique(size).tolist():
        of = np.flatnonzero(size == g)
        row[of] = np.arange(len(of))
        table[g] = _counts([v[i] for i in of.tolist()], g)
    good = []
    ga, gb = size[a[ok]], size[b[ok]]
    for x, y in np.unique(np.stack([ga, gb], axis=1), axis=0).tolist():
        here, g = ok[(ga == x) & (gb == y)], min(x, y)
        for part in np.array_split(here, 1 + len(here) * max(x, y) // (1 << 24)):
            left, right = table[x][row[a[part]]], table[y][row[b[part]]]
            if x != y:
                left, right = (t.astype(np.int32) if t.shape[1] == g else folded(t.astype(np.int32), g) for t in (left, right))
            bound = np.minimum(left, right).sum(1, dtype=np.int64)
            good.append(part[bound * (num + den) >= num * (n[a[part]] + n[b[part]])])
    return np.concatenate(good)


def _cell_pairs(v: list[bytes], doc: np.ndarray, n: np.ndarray, starts: np.ndarray, many: np.ndarray, num: int, den: int):
    """Surviving pairs of each cell: a cell of one leaf compares its points at once, a larger one searches its tree."""
    left, right = [], []
    for m in np.unique(many[(many > 1) & (many <= FANOUT)]).tolist():
        i, j = np.triu_indices(m, 1)
        at = starts[many == m][:, None]
        left.append((at + i).ravel()), right.append((at + j).ravel())
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])], axis=1)
        once = np.unique(pair, axis=0, return_index=True)[1]  # a pair often shares several cells
        once = once[pair[once, 0] != pair[once, 1]]
        a, b = a[once], b[once]
        good = _fit(v, n, a, b, num, den)
        yield np.stack([doc[a[good]], doc[b[good]]], axis=1)
    for s, m in zip(starts[many > FANOUT].tolist(), many[many > FANOUT].tolist()):
        of = np.arange(s, s + m)
        size = np.array([2 * len(v[i]) for i in of.tolist()])
        for g in np.unique(size).tolist():
            near = of[(size == g) | (size == 2 * g)]
            vectors = np.stack([folded(_counts([v[i]], k)[0].astype(np.int32), g) for i, k in zip(near.tolist(), size[near - s].tolist())])
            tree, label = RTree(vectors, n[near]), np.arange(len(near))
            for k in np.flatnonzero(size[near - s] == g).tolist():
                found, _ = tree.search(vectors[k], int(n[near[k]]), num, den)
                found = found[label[found] != label[k]]
                if len(found):
                    label[np.isin(label, label[found])] = label[k]
                    yield np.stack([np.full(len(found), doc[near[k]]), doc[near[found]]], axis=1)


def _joined_cells(batches, num, den):
    """Rows sorted by cell in; a forest of the pairs that survive in a task's cells out."""

    def pairs():
        for cell, doc, n, v in runs(batches):
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            many = np.diff(np.append(first, len(cell)))
            keep = np.repeat(many > 1, many)
            if keep.any():
                many = many[many > 1]
                for pair in _cell_pairs(v[keep].tolist(), doc[keep], n[keep], np.cumsum(many) - many, many, num, den):
                    if len(pair):
                        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    return contracted(pairs())


# -- clusters --------------------------------------------------------------------------------------


def _edges(found):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _raw(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _verified(batches, num, den):
    """(page, doc_id, n, hashes) sorted by page in, links out."""
    for _, group in grouped(batches):
        if len(group) > 1:
            found = join_sets([_raw(g[3]) for g in group], [g[2] for g in group], num, den)
            if found:
                yield _edges([(group[i][1], group[j][1]) for i, j in found])


def _crossed(batches, num, den):
    """(key, side, doc_id, n, component, hashes) sorted by key in, links between sides out."""
    for _, group in grouped(batches):
        found = join_sets([_raw(g[5]) for g in group], [g[3] for g in group], num, den, known=[g[4] for g in group], side=[g[1] for g in group])
        if found:
            yield _edges([(group[i][2], group[j][2]) for i, j in found])


BOX = 256


def _boxes(batches):
    for page, group in grouped(batches):
        sets = [vector(_raw(g[3]), BOX) for g in group]
        yield pa.RecordBatch.from_pylist([{"page": page, "low": min(g[2] for g in group), "high": np.stack(sets).max(0).tolist()}])


def _by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _pages(members: DataFrame, limits: tuple[int, int], num: int, den: int) -> DataFrame:
    """Members of large clusters with pages: by class of size and, within a class, by hash over as many pages as the limits ask for."""
    size = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    sized = members.withColumn("size", size)
    parts = sized.groupBy("cluster", "size").agg(F.ceil(F.greatest(F.count("*") / limits[0], F.sum("n") / limits[1])).alias("p"))
    parts = stored(parts, "parts").withColumnsRenamed({"cluster": "c", "size": "s"})
    return sized.join(parts, (F.col("cluster") == F.col("c")) & (F.col("size") == F.col("s"))).withColumn("page", F.xxhash64("cluster", "size", F.pmod(F.xxhash64("doc_id"), "p"))).drop("c", "s", "p", "size")


def jaccard_links(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, limits: tuple[int, int] = (PAGE_SETS, PAGE_SHINGLES), frequent: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(sets, links): sets (doc_id, n) of every row; links (a, b), a spanning forest of the linked documents.

    Two documents link when den * intersection >= num * union of their distinct ``size``-word
    shingles. Rows with the same doc_id are one node; a row with null doc_id, null text or no words
    links with nothing and is its own component. limits: sets and shingles of a page; frequent (at most
    HOT): documents from which a shingle is too frequent for a cell; neither changes the links' components. Columns other
    than doc_id and text are left out. Set sizes count 64-bit hashes; overlaps compare 48 bits of them.
    """
    spark = docs.sparkSession
    base = texts(docs)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # eight bytes for a shingle, of which a word of six letters begins one
    buckets = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 8 / 6 / BUCKET_BYTES)))
    asked = base.mapInArrow(lean(lambda it: _units(it, size, buckets)), UNITS)
    told = _by(asked, "bucket").mapInArrow(lean(_counted), UNITS).drop("bucket")
    every = stored(_by(told, "unit").mapInArrow(lean(lambda it: _sets(it, num, den)), SETS), "sets", compression="zstd")
    same = every.where("twin is not null").select(F.col("doc_id").alias("a"), F.col("twin").alias("b"))
    reps = every.where("hashes is not null").select("doc_id", "n", "hashes", "often")
    cells = reps.mapInArrow(lean(lambda it: _dealt(it, num, den, frequent, False)), CELLS)
    pairs = _by(cells, "cell").mapInArrow(lean(lambda it: _joined_cells(it, num, den)), "a long, b long")
    often = stored(reps.mapInArrow(lean(lambda it: _dealt(it, num, den, frequent, True)), CELLS).select("cell", "doc_id"), "frequent")
    heads = stored(often.groupBy(F.col("cell").alias("c")).agg(F.min("doc_id").alias("head")), "heads")
    hub = often.join(heads, F.col("cell") == F.col("c")).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    near = stored(components(stored(pairs.union(hub), "pairs")), "near")
    tops = near.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    members = stored(reps.join(lookup(stored(near.union(tops), "clusters")), F.col("node") == F.col("doc_id")).select(F.col("component").alias("cluster"), "doc_id", "n", "hashes"), "members", compression="zstd")
    return every.select("doc_id", "n"), _within(members, same, num, den, limits)


def _within(members: DataFrame, links: DataFrame, num: int, den: int, limits: tuple[int, int]) -> DataFrame:
    """``links`` and those among the members (cluster, doc_id, n, hashes) of each cluster."""
    inside = lambda p, key: _by(p.select(F.col(key).alias("page"), "doc_id", "n", "hashes"), "page").mapInArrow(lean(lambda it: _verified(it, num, den)), "a long, b long")
    sums = members.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    large = stored(sums.where(((F.col("k") > limits[0]) | (F.col("s") > limits[1])) & (F.col("k") > 2)).select("c"), "large")
    small = members.join(large, F.col("cluster") == F.col("c"), "left_anti")
    links = links.union(stored(inside(small, "cluster"), "links"))
    if large.isEmpty():
        return links
    wide = stored(_pages(members.join(large, F.col("cluster") == F.col("c"), "left_semi"), limits, num, den), "wide", compression="zstd")
    links = links.union(stored(inside(wide, "page"), "links"))
    last = None
    while True:
        comps = stored(components(links), "comps").select(F.col("node"), "component")
        placed = wide.join(comps, F.col("doc_id") == F.col("node"), "left").select("cluster", "doc_id", "n", "page", "hashes", F.coalesce("component", "doc_id").alias("component"))
        firsts = placed.groupBy("cluster", "component").agg(F.min(F.struct("doc_id", "n", "hashes")).alias("x"), F.count("*").alias("k"))
        firsts = stored(firsts.select("cluster", "component", "k", "x.*"), "firsts")
        main = stored(firsts.groupBy("cluster").agg(F.max(F.struct("k", "component")).alias("x"), F.count("*").alias("left")).where("left > 1").select(F.col("cluster").alias("c"), F.col("x.component").alias("main"), "left"), "main")
        left = main.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        if left == 0:
            return links
        if last is not None and left > 0.9 * last:
            break
        last = left
        again = firsts.join(main, F.col("cluster") == F.col("c"), "left_semi")
        links = links.union(stored(inside(_pages(again, limits, num, den), "page"), "links"))
    # exact: whatever is outside its cluster's largest component, against all of the cluster
    open_ = stored(placed.join(main, F.col("cluster") == F.col("c")).drop("c"), "open", compression="zstd")
    rest = _pages(open_.where("component <> main").drop("page"), limits, num, den)
    rest = stored(rest.withColumnRenamed("page", "ask"), "rest", compression="zstd")
    boxes = lambda p, key: _by(p.select(F.col(key).alias("page"), "doc_id", "n", "hashes"), "page").mapInArrow(lean(_boxes), "page long, low long, high array<long>")
    one = stored(boxes(rest, "ask"), "boxes").select(F.col("page").alias("ask"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    two = stored(boxes(open_, "page"), "boxes").select("page", F.col("low").alias("l2"), F.col("high").alias("h2"))
    one = rest.select("ask", "cluster").distinct().join(one, "ask")
    two = open_.select("page", "cluster").distinct().join(two, "page")
    bound = F.aggregate(F.zip_with("h1", "h2", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    todo = stored(one.join(two, "cluster").where(bound * (num + den) >= num * (F.col("l1") + F.col("l2"))).select(F.xxhash64("ask", "page").alias("key"), "ask", "page"), "todo")
    first = rest.join(todo.select("key", "ask"), "ask").select("key", F.lit(0).alias("side"), "doc_id", "n", "component", "hashes")
    second = open_.join(todo.select("key", "page"), "page").select("key", F.lit(1).alias("side"), "doc_id", "n", "component", "hashes")
    return links.union(stored(_by(first.union(second), "key").mapInArrow(lean(lambda it: _crossed(it, num, den)), "a long, b long"), "links"))


def near_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``; see jaccard_links."""
    sets, links = jaccard_links(docs, size, num, den)
    comps = components(links).select(F.col("node"), "component")
    return sets.join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def without_near(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; all columns kept.

    Repeated rows of a doc_id that stays all stay; so do rows with null doc_id.
    """
    _, links = jaccard_links(docs, size, num, den)
    gone = components(links).select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
