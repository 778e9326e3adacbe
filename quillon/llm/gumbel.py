"""Subword sampling without replacement: Gumbel top-k over the segmentation lattice, and decoding.

All segmentations of a text form a tree: each path from the root fixes piece after piece. With
backward sums over the lattice every edge has its probability given the node before it. A* with
perturbed scores (Gumbel noise, drawn from the top down: a subtree's largest perturbed score is its
parent's or is truncated by it) opens the subtrees in the order of their best member and so emits
distinct segmentations, as if drawn one after another without replacement. Noise is a hash of row
key, sample and place, so a row's samples do not depend on partitions.

A lattice falls apart where no piece reaches over, so it is built once for each distinct unit, a word
with the spaces before it, and all units of a batch of texts advance together, piece by piece.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, rows, sliced, texts

SPACE = "▁"
#: Lattice nodes a worker keeps.
NODES = 2_250_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def _times(k: int, c: np.uint64) -> np.uint64:
    return np.uint64(k * int(c) & (1 << 64) - 1)


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def trunc(x: np.ndarray, bound) -> np.ndarray:
    """Gumbel values given that they stay below ``bound``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return -np.logaddexp(-bound, -x)


class Vocabulary:
    """Pieces of a sentencepiece model with log-probabilities falling with their rank, ``(rank + 2) ** -alpha``."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        weight = lambda r: -alpha * np.log(r + 2.0)
        total = np.log(sum((r + 2.0) ** -alpha for r in range(len(plain) + 1)))
        self.lp = {i: float(weight(r) - total) for i, r in rank.items()}
        self.byte_lp = float(weight(len(plain)) - total)
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([self.byte_id.get(b, -1 - b) for b in range(128)])
        self.text = [b""] * n
        for i in plain:
            self.text[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.text[i] = bytes([b])
        self.pieces = {sp.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        assert not any(" " in p.lstrip(" ") for p in self.pieces), "a piece reaches over a space"
        alone = "" if "\n" in inner else "\n"
        self.unit = re.compile(f" *[^ {alone}]+| +|{alone}" if alone else " *[^ ]+| +")
        # a trie over characters as one sorted array of (state, character) and where they lead
        states, keys, leads, ends = {"": 0}, [], [], [-1]
        for p in sorted(self.pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    ends.append(-1)
                    keys.append(states[p[: k - 1]] << 21 | ord(p[k - 1])), leads.append(states[p[:k]])
            ends[states[p]] = self.pieces[p]
        order = np.argsort(keys)
        self.keys, self.leads, self.ends = np.array(keys)[order], np.array(leads)[order], np.array(ends)
        # from the root, where every character starts, by the character itself
        self.root = np.full(0x110000, -1, np.int32)
        here = self.keys < 1 << 21
        self.root[self.keys[here]] = self.leads[here]
        self.lps = np.full(n, -np.inf)
        for i, x in self.lp.items():
            self.lps[i] = x

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))[1:]


_vocabulary = lru_cache(maxsize=2)(Vocabulary)


class Lattices:
    """Nodes and edges of the lattices of all units so far; a node's edges lie together, the likeliest first."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self):
        self.base: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self.first, self.many = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.cum, self.log, self.other = (np.zeros(1 << 17, np.float32) for _ in range(3))
        self.to, self.piece = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32)

    def _room(self, names, used, more):
        if used + more > len(getattr(self, names[0])):
            for name in names:
                old = getattr(self, name)
                new = np.zeros(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def add(self, units: list[str]) -> None:
        """Builds the lattices of new units together; piece -c stands for the bytes of character c - 1."""
        v = self.v
        text = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        end = np.repeat(np.cumsum(size), size)
        src, dst, piece, lp = [], [], [], []
        state = v.root[text]
        at = np.flatnonzero(state >= 0)
        far, state = at + 1, state[at].astype(np.int64)
        single = np.zeros(len(text), bool)
        while len(at):
            e = v.ends[state]
            full = e >= 0
            src.append(at[full]), dst.append(far[full]), piece.append(e[full]), lp.append(v.lps[e[full]])
            single[at[full & (far == at + 1)]] = True
            ok = far < end[at]
            at, far, state = at[ok], far[ok], state[ok]
            key = state << 21 | text[far]
            k = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            ok = v.keys[k] == key
            at, far, state = at[ok], far[ok] + 1, v.leads[k[ok]]
        raw = np.flatnonzero(~single)
        width = 1 + (text[raw] >= 0x80) + (text[raw] >= 0x800) + (text[raw] >= 0x10000)
        src.append(raw), dst.append(raw + 1), piece.append(np.where(text[raw] < 0x80, v.byte_ids[np.minimum(text[raw], 0x7F)], -1 - text[raw])), lp.append(v.byte_lp * width)
        src, dst, piece, lp = (np.concatenate(x) for x in (src, dst, piece, lp))
        back = np.zeros(len(text) + 1)  # log of the sum over all ways to the unit's end; entry i: from character i
        away = end[src] - src
        order = np.argsort(away * len(text) + src)
        src, dst, piece, lp, away = src[order], dst[order], piece[order], lp[order], away[order]
        done = dst == end[src]
        cuts = np.flatnonzero(np.append(True, away[1:] != away[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(away)]):
            s = src[a:b]
            w = lp[a:b] + np.where(done[a:b], 0.0, back[dst[a:b]])
            f = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            top = np.maximum.reduceat(w, f)
            back[s[f]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(f, len(w))))), f))
        log = np.minimum(0.0, lp + np.where(done, 0.0, back[dst]) - back[src])
        order = np.argsort(src * 64.0 + np.minimum(-log, 63.9))
        src, dst, piece, log, done = src[order], dst[order], piece[order], log[order], done[order]
        p = np.exp(log)
        f = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        many = np.diff(np.append(f, len(src)))
        cum = np.cumsum(p)
        cum -= np.repeat(cum[f] - p[f], many)
        cum[f + many - 1] = 2.0
        with np.errstate(divide="ignore"):  # log of what the node's other edges have; small masses beside a likely edge are summed, not subtracted
            other = np.log1p(-np.minimum(p, 0.999))
            beside = p.copy()
            beside[f] = 0.0
            other[f] = np.log(np.add.reduceat(beside, f))
        log[f[many == 1]] = 0.0
        self._room(("first", "many"), self.n_nodes, len(text))
        self._room(("cum", "log", "other", "to", "piece"), self.n_edges, len(src))
        n, e = slice(self.n_nodes, self.n_nodes + len(text)), slice(self.n_edges, self.n_edges + len(src))
        self.first[n], self.many[n] = f + self.n_edges, many
        self.cum[e], self.log[e], self.other[e], self.piece[e] = cum, log, other, piece
        self.to[e] = np.where(done, -1, dst + self.n_nodes)
        self.base.update(zip(units, (np.cumsum(size) - size + self.n_nodes).tolist()))
        self.n_nodes += len(text)
        self.n_edges += len(src)

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path to the end of each unit from ``node`` (-1: none): all edges in order, and their number by unit."""
        count, steps = np.zeros(len(node), np.int64), []
        live = np.flatnonzero(node >= 0)
        cur, key = node[live], key[live]
        t = 0
        while len(live):
            edge = self.first[cur].copy()
            more = np.flatnonzero(self.many[cur] > 1)
            u = uniform(key[more] + _times(t, _M[3]))
            while len(more):
                on = u >= self.cum[edge[more]]
                more, u = more[on], u[on]
                edge[more] += 1
            steps.append((live, edge))
            count[live] += 1
            cur = self.to[edge]
            on = cur >= 0
            live, cur, key = live[on], cur[on], key[on]
            t += 1
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (who, edge) in enumerate(steps):
            out[start[who] + t] = edge
        return out, count


class Path:
    """A sampled segmentation: its edges, log-probability and perturbed score; ``open``: at each place, the largest
    perturbed score of what turns off there and was not emitted; ``gone``: edges at a place that were."""

    __slots__ = ("edges", "log", "score", "open", "gone")


def _noise(row, sample: int, place: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(place.astype(np.uint64) * _M[0] + (row + _times(sample, _M[3]) + _M[2]))))


def _extend(lat, row, nodes, todo, sample):
    """Random ends to beginnings of paths. todo: (text, edges so far, their log, node to go on from or -1, next unit, score)."""
    starts = [np.append(n, nodes[d][u:]) if n >= 0 else nodes[d][u:] for d, _, _, n, u, _ in todo]
    sizes = np.array([len(x) for x in starts])
    which = np.repeat(np.arange(len(todo)), sizes)
    unit = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array([u - (n >= 0) for _, _, _, n, u, _ in todo]), sizes)
    keys = mix(row[np.array([x[0] for x in todo])][which] + _times(sample, _M[0]) + unit.astype(np.uint64) * _M[4])
    edges, count = lat.walk(np.concatenate(starts), keys)
    stop = np.cumsum(np.bincount(np.repeat(which, count), minlength=len(todo)))
    logs = lat.log[edges].astype(np.float64)
    before_all, at, out = np.cumsum(logs) - logs, 0, []
    size = np.diff(np.append(0, stop))
    first = np.repeat(stop - size, size)
    done = np.array([x[2] for x in todo])
    depth = np.arange(len(edges)) - first + np.repeat(np.array([len(x[1]) for x in todo]), size)
    of = np.repeat(np.array([x[0] for x in todo]), size)
    with np.errstate(over="ignore"):
        loc = before_all - before_all[first] + np.repeat(done, size) + lat.other[edges]
        noise = _noise(row[of], sample, depth)
        opened = -np.logaddexp(-np.repeat(np.array([x[5] for x in todo]), size), -(loc + noise))
    for (d, before, log, _, _, score), b in zip(todo, stop.tolist()):
        x = Path()
        x.edges, x.score, x.gone = np.concatenate([before, edges[at:b]]), score, {}
        x.log = log + float(logs[at:b].sum())
        x.open = np.append(np.full(len(before), -np.inf), opened[at:b])
        out.append((d, x))
        at = b
    return out


def _turn(lat, row, d, paths, sample):
    """Opens the best subtree of a text that is not emitted yet: an entry for _extend, or None if all are."""
    best = max(range(len(paths)), key=lambda j: paths[j].open.max(initial=-np.inf))
    x = paths[best]
    score = x.open.max(initial=-np.inf)
    if score == -np.inf:
        return None
    at = int(x.open.argmax())
    gone = x.gone.setdefault(at, [int(x.edges[at])])
    node = int(np.searchsorted(lat.first[: lat.n_nodes], np.int32(x.edges[at]), side="right")) - 1
    rest = [e for e in range(lat.first[node], lat.first[node] + lat.many[node]) if e not in gone]
    if not rest:
        x.open[at] = -np.inf
        return _turn(lat, row, d, paths, sample)
    p = np.cumsum(np.exp(lat.log[rest].astype(np.float64)))
    u = uniform(row[d : d + 1] + _times(sample, _M[4]) + _M[1])[0]
    new = rest[min(int(np.searchsorted(p, u * p[-1], side="right")), len(rest) - 1)]
    gone.append(new)
    log = float(lat.log[x.edges[:at]].sum(dtype=np.float64))
    left = [e for e in rest if e != new]
    x.open[at] = trunc(log + np.log(np.exp(lat.log[left].astype(np.float64)).sum()) + _noise(row[d : d + 1], sample + 1000, np.array([at]))[0], score) if left else -np.inf
    done = int((lat.to[x.edges[:at]] < 0).sum())
    return d, np.append(x.edges[:at], new), log + float(lat.log[new]), int(lat.to[new]), done + 1, float(score)


def sample_batch(lat: Lattices, keys: list[int], text: list[str], k: int, seed: int) -> list[tuple[list[Path], float]]:
    """For each text its paths, best perturbed score first (k, or all there are), and the next perturbed score."""
    if lat.n_nodes > NODES:
        lat.clear()
    units = [lat.v.unit.findall(" " + t) if t else [] for t in text]
    flat = list(chain.from_iterable(units))
    new = [u for u in dict.fromkeys(flat) if u not in lat.base]
    if new:
        lat.add(new)
    nodes = np.split(np.fromiter(map(lat.base.__getitem__, flat), dtype=np.int64, count=len(flat)), np.cumsum([len(us) for us in units])[:-1])
    row = mix(np.array(keys, dtype=np.int64).view(np.uint64) + _times(seed, _M[0]))
    root = -np.log(-np.log(uniform(row + _M[4])))
    none = np.zeros(0, np.int64)
    paths: list[list[Path]] = [[] for _ in text]
    todo = [(d, none, 0.0, -1, 0, float(root[d])) for d in range(len(text))]
    for s in range(1, k + 1):
        for d, x in _extend(lat, row, nodes, todo, s) if todo else ():
            paths[d].append(x)
        if s < k:
            todo = [t for d in range(len(text)) if (t := _turn(lat, row, d, paths[d], s + 1))]
    return [(p, max(x.open.max(initial=-np.inf) for x in p)) for p in paths]


def ids_of(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    piece = lat.piece[edges]
    if len(piece) and piece.min() < 0:
        return np.array([i for c in piece.tolist() for i in ([c] if c >= 0 else [lat.v.byte_id[b] for b in chr(-1 - c).encode()])], dtype=np.int64)
    return piece


def inclusion(log: float, bound: float) -> float:
    """log P(perturbed score above ``bound``): how likely a segmentation is among the samples, given the bound."""
    if bound == -np.inf:
        return 0.0
    x = np.exp(min(log - bound, 50.0))
    return float(np.log(-np.expm1(-x))) if x > 0 else float(log - bound)


OUT = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("score", pa.float64()), ("inclusion", pa.float64())])
DDL = "doc_id long, sample int, ids array<int>, log_prob double, score double, inclusion double"


def _sampled(batches, path, k, alpha, seed):
    lat = held(("lattices", path, alpha), lambda: Lattices(_vocabulary(path, alpha)))
    for keys, raw in rows(batches, most_rows=200, most_bytes=400_000):
        docs, number, flat, sizes, log, score, inc = [], [], [], [], [], [], []
        for d, (paths, bound) in zip(keys, sample_batch(lat, [d or 0 for d in keys], [t.decode() for t in raw], k, seed)):
            for s, x in enumerate(paths, 1):
                ids = ids_of(lat, x.edges)
                docs.append(d), number.append(s), flat.append(ids), sizes.append(len(ids))
                log.append(x.log), score.append(x.score), inc.append(inclusion(x.log, bound))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(number, pa.int32()), lists, pa.array(log), pa.array(score), pa.array(inc)], schema=OUT)


def sampled(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, sample, ids, log_prob, score, inclusion): k distinct segmentations of every whole text, best score first.

    ``model`` is a sentencepiece file. A text with fewer than k segmentations has a row for each; null
    text is empty and has one, without ids. Rows with the same doc_id and text get the same samples;
    null doc_id draws like 0. inclusion: log of the probability to be among the samples, given the
    first score left out. Columns other than doc_id and text are left out.
    """
    return texts(docs).mapInArrow(lambda it: _sampled(it, model, k, alpha, seed), DDL)


def _decoded(batches, path, alpha):
    v = _vocabulary(path, alpha)
    for batch in sliced(batches):
        ids = batch.column(2)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        text = [v.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary())], names=["doc_id", "sample", "text"])


def decoded(found: DataFrame, model: str) -> DataFrame:
    """(doc_id, sample, text) from (doc_id, sample, ids): the text the ids spell."""
    out = found.select("doc_id", "sample", "ids").mapInArrow(lambda it: _decoded(it, model, 1.0), "doc_id long, sample int, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def _digests(batches, model):
    v = _vocabulary(model, 1.0)
    for batch in sliced(batches):
        ids = batch.column(2)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
        crc = [zlib.crc32(flat[a:b].astype("<i4").tobytes()) for a, b in zip(ends, ends[1:])]
        text = [zlib.crc32(v.decode(flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(text, pa.int64()), *batch.columns[3:]], names=["doc_id", "sample", "n_ids", "ids_crc32", "text_crc32", "log_prob", "score", "inclusion"])


DIGEST = "doc_id long, sample int, n_ids long, ids_crc32 long, text_crc32 long, log_prob double, score double, inclusion double"


def digest(found: DataFrame, model: str) -> DataFrame:
    """A row for each sample with hashes of its ids and of the text they decode to."""
    return found.mapInArrow(lambda it: _digests(it, model), DIGEST)


def sampled_digest(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows of ``digest(sampled(docs, model, k, alpha, seed), model)`` in one pass: no ids leave the worker that draws them."""
    return texts(docs).mapInArrow(lambda it: _digests(_sampled(it, model, k, alpha, seed), model), DIGEST)
