"""Quality classifier without gold labels.

Overlapping heuristics each vote good, bad or nothing on a document. Expectation-maximisation over
the counts of all vote patterns estimates how accurate each heuristic is, and so how likely a
document is good; these posterior labels train a linear scorer over hashed words and word shapes.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Function words of the four languages, by which running text is told from lists and noise (fixed values).
FUNCTION_WORDS = frozenset("the of and to in is that it for was on with as at by an be this are from der die und den das von zu mit sich auf ist im ein eine nicht le la les de des et un une que en est pour qui dans du au sur el los las y del se por con para su una".encode().split())
BUCKETS = 1 << 16
#: Documents the linear scorer is fitted on: those of the smallest hashes of their ids.
SAMPLE = 4000

_SYMBOLS = b"*%$#&!@^~=<>{}\\"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = b".,;:!?\"'()"
_DOUBLED = [bytes([c, c]) for c in b"!?*%$#&@^~=<>{}\\|-+_"]


def _measures(t: bytes) -> tuple:
    words = t.split()
    n = max(1, len(words))
    lower = t.lower().translate(None, _MARKS).split()
    size, upper = len(t), len(t) - len(t.translate(None, _UPPER))
    letters = max(1, upper + size - len(t.translate(None, _LOWER)))
    lines = [x for x in map(bytes.strip, t.split(b"\n")) if x]
    single = [w for w in words if len(w) == 1]
    return (
        len(words),
        (size - len(t.translate(None, _SYMBOLS))) / n,
        upper / letters,
        sum(not w.isalnum() for w in single) / n,
        sum(map(FUNCTION_WORDS.__contains__, lower)) / n,
        len(set(lines)) / max(1, len(lines)),
        len(set(lower)) / n**0.85,
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        sum(map(t.count, _DOUBLED)) / n,
        size / n,
        repeats(words) / n,
    )


def repeats(words: list[bytes]) -> int:
    """Words that are the same as the one before."""
    return sum(map(operator.eq, words, words[1:]))


#: Each labeller: its measure, and the bounds (low, high) up to which and from which it votes, with the vote there.
LABELLERS = [
    ("symbols", 1, (0.05, 0.3), "10"),
    ("capitals", 2, (0.12, 0.35), "10"),
    ("separators", 3, (0.03, 0.15), "10"),
    ("function_words", 4, (0.04, 0.12), "01"),
    ("new_lines", 5, (0.6, 0.9), "01"),
    ("new_words", 6, (0.3, 0.7), "01"),
    ("sentence_ends", 7, (0.1, 0.5), "01"),
    ("repeated_marks", 8, (0.02, 0.2), "10"),
    ("word_length", 9, (11.0, 16.0), "10"),
    ("length", 0, (8, 30), "01"),
    ("stutter", 10, (0.03, 0.15), "10"),
]


def votes(t: bytes) -> str:
    """A letter for each labeller: 1 good, 0 bad, - no vote."""
    m = _measures(t)
    return "".join(v[0] if m[k] <= low else v[1] if m[k] >= high else "-" for _, k, (low, high), v in LABELLERS)


def fit_labellers(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """Prior of good, and P(vote | class) as an array [class, labeller, vote of 0 1 -], by EM.

    It starts from documents with two complaints or more as bad, with none as good: each labeller sees
    one kind of fault only, so most others find nothing wrong with a bad document. For the same reason
    a complaint about a good document is rare beforehand (pseudo-counts, a twentieth of all documents).
    """
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], dtype=float)
    seen = np.array([["01-".index(x) for x in k] for k in keys])
    hot = np.eye(3)[seen]
    bad = (seen == 0).sum(1)
    post = np.where(bad == 0, 0.98, np.where(bad == 1, 0.6, 0.05))
    before = np.full((2, seen.shape[1], 3), 0.5)
    before[1] += 0.05 * weight.sum() * np.array([0.002, 0.988, 0.01])
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * weight
        prior = share.sum(1) / share.sum()
        table = np.einsum("cp,plv->clv", share, hot) + before
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + np.einsum("plv,clv->cp", hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior[1]), table


def posterior(pattern: str, prior: float, table: np.ndarray) -> float:
    v = ["01-".index(x) for x in pattern]
    logs = np.log(table[:, range(len(v)), v]).sum(1) + np.log([1 - prior, prior])
    return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))


_SHAPE = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1{2,}", re.S)
_REPEAT = xxhash.xxh3_64_intdigest(b"\0repeat") % BUCKETS


def shape(w: bytes) -> bytes:
    """A word with letters, digits and other bytes as classes, runs shortened to two."""
    return _RUN.sub(rb"\1\1", w.translate(_SHAPE))


def _buckets(w: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS, xxhash.xxh3_64_intdigest(b"\0" + shape(w)) % BUCKETS


def _features(t: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words, shapes and repeats, and their shares."""
    words = t.split()
    flat = [x for w in words for x in _buckets(w)] + [_REPEAT] * repeats(words)
    k, c = np.unique(np.array(flat, dtype=np.int64), return_counts=True)
    return k, 4 * c / max(1, len(words))


def fit_scorer(sample: list[tuple[bytes, float]], epochs: int = 6, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on mean hashed features, fitted to posterior labels by Adagrad."""
    feats = [(*_features(t), y) for t, y in sample]
    w, b, g, gb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turn.permutation(len(feats)):
            k, x, y = feats[i]
            d = 1 / (1 + np.exp(-np.clip(w[k] @ x + b, -30, 30))) - y
            step = d * x + 1e-6 * w[k]
            g[k] += step * step
            w[k] -= rate * step / np.sqrt(g[k])
            gb += d * d
            b -= rate * d / gb**0.5
    return w, b


class _Weights(dict):
    def __init__(self, w):
        self.w = w

    def __missing__(self, word):
        a, b = _buckets(word)
        self[word] = x = float(self.w[a] + self.w[b])
        return x


def score(text: bytes, w: _Weights, b: float) -> float:
    words = text.split()
    total = (sum(map(w.__getitem__, words)) + w.w[_REPEAT] * repeats(words)) * 4 / max(1, len(words))
    return float(1 / (1 + np.exp(-np.clip(total + b, -50, 50))))


def _voted(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in batch.slice(at, 1000).column(1).to_pylist()], pa.string())], names=["votes"])


def _scored(batches, sent):
    weights, b, prior, table, known = _Weights(sent.value[0]), *sent.value[1:4], {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            if len(weights) > 400_000:
                weights.clear()
            text = part.column(1).to_pylist()
            found = [votes(t) for t in text]
            for v in set(found) - known.keys():
                known[v] = posterior(v, prior, table)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array([known[v] for v in found], pa.float64()), pa.array([score(t, weights, b) for t in text], pa.float64())], names=["doc_id", "votes", "posterior", "score"])


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of every whole text.

    Vote patterns are counted over all rows (at most 3 ** 11 of them); only the linear scorer is
    fitted on a bounded sample of ``sample`` rows, repeated ones once. Null text is empty; empty texts are scored like any
    other; repeated rows are each scored; an empty table gives an empty result. keep: score >= 0.5.
    """
    spark = docs.sparkSession
    base = texts(docs)
    patterns = {r.votes: r["count"] for r in base.mapInArrow(_voted, "votes string").groupBy("votes").count().collect()} or {"-" * len(LABELLERS): 1}
    prior, table = fit_labellers(patterns)
    # ids and hashes are chosen first; only the chosen texts travel, one for each id and hash
    keyed = base.withColumn("h", F.xxhash64("text"))
    chosen = keyed.select(F.col("doc_id").alias("d"), F.col("h").alias("x")).orderBy(F.xxhash64(F.lit(1), "d"), "d", "x").limit(sample).distinct()
    found = keyed.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")))  # at most ``sample`` rows
    some = found.groupBy("doc_id", "h").agg(F.first("text").alias("text")).orderBy("doc_id", "h").toLocalIterator()
    w, b = fit_scorer([(bytes(r.text), posterior(votes(bytes(r.text)), prior, table)) for r in some])
    sent = spark.sparkContext.broadcast((w, b, prior, table))
    # votes again, not joined: a second reading of the input may number its rows otherwise
    out = base.mapInArrow(lambda it: _scored(it, sent), "doc_id long, votes string, posterior double, score double")
    return out.select("doc_id", "votes", "posterior", "score", (F.col("score") >= 0.5).alias("keep"))
