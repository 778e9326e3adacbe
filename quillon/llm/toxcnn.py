"""Toxicity by a convolutional text classifier, trained in numpy.

Words and their first letters are hashed into an embedding table; filters of several widths slide
over the words, each keeps its largest response, and a linear layer over these maxima gives the score.
Two coordinates of a word start, and stay, as the smoothed log-odds of the word and of its first
letters in toxic documents, the lesser of two buckets each, so that one collision makes no toxic word.
Scores are shifted so that 0.5 is the best single cut; thresholds are then calibrated for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod_col, held, rows, sliced, texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: Coordinates of log-odds, and letters of a word's beginning.
ODDS, LETTERS = 2, 4
#: Labelled rows the classifier is fitted on, at most, of each class; those of the smallest hashes of their ids.
SAMPLE = 1500
#: Words a scoring task remembers.
WORDS = 300_000
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(t: bytes) -> list[bytes]:
    return t.lower().translate(_WORD).split()


def places(word: bytes) -> tuple[int, int, int, int]:
    """Two buckets of the word and two of its first letters."""
    a = xxhash.xxh3_64_intdigest(word)
    b = xxhash.xxh3_64_intdigest(b"\0" + word.decode("utf-8", "ignore")[:LETTERS].encode())
    return a & BUCKETS - 1, a >> 24 & BUCKETS - 1, b & BUCKETS - 1, b >> 24 & BUCKETS - 1


class Net:
    """Parameters: log-odds by two hashes, embeddings, filters by width, output weights and bias, the cut's shift."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.odds = np.zeros((2, BUCKETS), np.float32)
        self.embedding = r.normal(0, 0.05, (BUCKETS, DIM - ODDS)).astype(np.float32)
        self.filters = []
        for k in WIDTHS:
            w = r.normal(0, 0.3 / k, (k, DIM, FILTERS)).astype(np.float32)
            w[:, :ODDS] = np.abs(w[:, :ODDS])
            self.filters.append(w)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.05, dtype=np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.shift, self.scale = 0.0, 1.0

    def fixed(self, at) -> tuple[float, float]:
        a, b, c, d = at
        return min(self.odds[0, a], self.odds[1, b]), min(self.odds[0, c], self.odds[1, d])

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer(dict):
    """Scores texts; remembers words as rows of a matrix, row 0 being the padding after each text."""

    def __init__(self, net: Net):
        self.net = net
        self.vectors = np.zeros((WORDS + 1, DIM), np.float32)
        self.weights = np.concatenate([w for f in net.filters for w in f], axis=1).T.copy()

    def __missing__(self, word: bytes) -> int:
        at = places(word)
        row = len(self) + 1
        if row >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[row, :ODDS] = self.net.fixed(at)
        self.vectors[row, ODDS:] = self.net.embedding[at[0]] + self.net.embedding[at[2]]
        self[word] = row
        return row

    def score(self, text: list[bytes]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        pad = [0] * (max(WIDTHS) - 1)
        rows_, sizes = [], []
        for t in text:
            ids = [*map(self.__getitem__, words_of(t)), *pad]
            if len(ids) == len(pad):
                ids.append(0)
            rows_ += ids
            sizes.append(len(ids))
        first = np.cumsum(sizes) - sizes
        z = self.weights @ self.vectors[rows_].T
        n, at, tops = z.shape[1], 0, []
        for k in WIDTHS:
            y = z[at : at + FILTERS, : n - k + 1].copy()
            for j in range(1, k):
                y += z[at + j * FILTERS : at + (j + 1) * FILTERS, j : n - k + 1 + j]
            at += k * FILTERS
            tops.append(np.maximum.reduceat(y, first, axis=1))
        net = self.net
        raw = np.tanh(np.concatenate(tops).T / 4) @ net.out * 4 + net.bias[0]
        x = (raw.astype(float) - net.shift) * net.scale
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(sample: list[tuple[bytes, int]], ratio: float = 1.0, epochs: int = 5, rate: float = 0.01, seed: int = 11) -> Net:
    """Adam on cross-entropy; the gradient of a maximum goes to the words that gave it.

    ratio: how many times as frequent the other class is, against toxic, as in the sample; the cut is set for that.
    """
    net = Net(seed)
    if not sample or len({y for _, y in sample}) < 2:
        net.bias[0] = -4 if not sample or not sample[0][1] else 4
        return net
    y = np.array([v for _, v in sample], dtype=float)
    cut = len(sample) // 4  # the first quarter calibrates the cut
    texts_, known = [words_of(t) for t, _ in sample], {}
    for ws in texts_:
        for w in ws:
            if w not in known:
                known[w] = len(known)
    at = np.array([places(w) for w in known] or [(0, 0, 0, 0)])
    coded = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in texts_]
    learn = np.array([i for i in range(cut, len(sample)) if len(coded[i]) >= max(WIDTHS)])
    hit = np.zeros((2, 2, BUCKETS))
    for i in learn:
        own = at[np.unique(coded[i])]
        for h in (0, 1):
            hit[h, int(y[i]), np.unique(own[:, [h, 2 + h]])] += 1
    n1, n0 = max(1, y[learn].sum()), max(1, (1 - y[learn]).sum())
    net.odds = np.clip(np.log((hit[:, 1] / n1 + 2 / n1) / (hit[:, 0] / n0 + 2 / n1)), -3, 5).astype(np.float32)
    fixed = np.array([net.fixed(x) for x in at], np.float32)
    params = [*net.filters, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    turn, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for i in turn.permutation(learn):
            ids = coded[i]
            e = np.concatenate([fixed[ids], net.embedding[at[ids, 0]] + net.embedding[at[ids, 2]]], axis=1)
            tops, pooled = [], []
            for k, w in zip(WIDTHS, net.filters):
                r = sum(e[j : len(e) - k + 1 + j] @ w[j] for j in range(k))
                top = r.argmax(0)
                tops.append(top)
                pooled.append(r[top, np.arange(FILTERS)])
            p = np.tanh(np.concatenate(pooled) / 4)
            z = p @ net.out * 4 + net.bias[0]
            d = float(1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            back = d * net.out * (1 - p * p)
            grads = []
            for f, (k, top) in enumerate(zip(WIDTHS, tops)):
                g = back[f * FILTERS : (f + 1) * FILTERS]
                near = top[:, None] + np.arange(k)  # filter, place in it
                grads.append(np.einsum("fkd,f->kdf", e[near], g))
                move = -rate * 0.5 * np.einsum("kdf,f->fkd", net.filters[f][:, ODDS:], g).reshape(-1, DIM - ODDS)
                for c in (0, 2):
                    np.add.at(net.embedding, at[ids[near.ravel()], c], move)
            grads += [d * p * 4, np.array([d], dtype=np.float32)]
            step += 1
            for q, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    if 0 < y[:cut].sum() < cut:
        s = net.scorer()
        raw = np.concatenate([s.score([t]) for t, _ in sample[:cut]])
        raw = np.log(raw / (1 - raw))
        net.shift, net.scale = best_cut(raw, y[:cut], np.where(y[:cut] > 0, 1.0, ratio)), 2 / max(0.5, float(np.std(raw)))
    return net


def best_cut(values: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of the best weighted F1 of ``values >= cut``, in the middle of the gap below it."""
    order = np.argsort(-values, kind="stable")
    v = values[order]
    t, n = np.cumsum(y[order] * weight[order]), np.cumsum(weight[order])
    f1 = 2 * t / (n + (y * weight).sum())
    last = np.append(v[1:] != v[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k] - 1e-6)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> tuple[list[tuple[bytes, int, str]], float]:
    """(text, toxic, lang) of at most ``sample`` labelled rows of each class outside the held-out fold, mixed by hash; and
    how many times as frequent the other class is among all such labels as in the sample."""
    lab = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and l is not null")
    lab = lab.where(crc_mod_col("l", fold) != 0).groupBy("l").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(3), "l"))
    sizes = dict(lab.groupBy("toxic").count().collect())
    some = lab.where("toxic = 1").orderBy("h").limit(sample).union(lab.where("toxic = 0").orderBy("h").limit(sample))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), lang.alias("lang"))
    found = d.join(F.broadcast(some), d["k"] == some["l"]).select("h", "text", "toxic", "lang")  # at most 2 * sample small rows
    rows_ = [(bytes(r.text), int(r.toxic), r.lang) for r in sorted(found.toLocalIterator(), key=lambda r: (r.h, r.text))]
    got = sum(y for _, y, _ in rows_)
    ratio = sizes.get(0, 0) / max(1, sizes.get(1, 0)) / (max(1, len(rows_) - got) / max(1, got))
    return rows_, max(ratio, 1e-3)


class Classifier:
    def __init__(self, net: Net, thresholds: dict[str | None, float]):
        self.net, self.thresholds = net, thresholds

    def rejects(self, score: float, lang: str | None) -> bool:
        return score >= self.thresholds.get(lang, 0.5)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5, least: int = 60) -> Classifier:
    """Fits the net, then a threshold for each language with ``least`` calibration rows of both classes together (else 0.5)."""
    rows_, ratio = labelled_sample(docs, labels, sample, fold)
    net = train([(t, y) for t, y, _ in rows_], ratio)
    cut = rows_[: len(rows_) // 4]
    thresholds: dict[str | None, float] = {}
    if cut:
        s = net.scorer()
        scores = np.concatenate([s.score([t]) for t, _, _ in cut])
        for lang in {x for _, _, x in cut}:
            at = np.array([i for i, (_, _, x) in enumerate(cut) if x == lang])
            y = np.array([cut[i][1] for i in at], dtype=float)
            if len(at) >= least and 10 <= y.sum() <= len(at) - 10:
                thresholds[lang] = float(np.clip(best_cut(scores[at], y, np.where(y > 0, 1.0, ratio)), 0.3, 0.7))
    return Classifier(net, thresholds)


def _scored(batches, sent):
    held(None, None)
    s = sent.value.net.scorer()
    for ids, text in rows(batches, most_rows=200, most_bytes=500_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.score(text))], names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Only texts of labelled rows outside the held-out fold are learned from, ``sample`` of each class at
    most; labels, lang, source and doc_id are no inputs of a score. Null text is empty and scored;
    repeated rows are each scored; without both labels every row gets one constant score near 0 or 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, fold))
    out = texts(docs).mapInArrow(lambda it: _scored(it, sent), "doc_id long, score double")
    return out.select("doc_id", (crc_mod_col("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(batches, sent):
    held(None, None)
    c, s = sent.value, sent.value.net.scorer()
    for batch in sliced(batches, 200):
        text = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        at = batch.schema.get_field_index("lang")
        lang = batch.column(at).to_pylist() if at >= 0 else [None] * len(text)
        keep = [not c.rejects(p, x) for p, x in zip(s.score(text), lang)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score stays below their language's threshold, unchanged, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return docs.mapInArrow(lambda it: _kept(it, sent), docs.schema)
