"""Language-model scores from a weighted backoff automaton.

States are pairs of words, words (with the start of a text among them) and the root. A trigram of the
training texts is an arc from its pair, a bigram an arc from its word, a unigram an arc from the root.
Each state's distribution is its counts and K times the next lower state's, over its count and K, so a
state without an arc for a word fails to the next lower one with weight K / (count + K), and the weights
sum to one everywhere. A text is scored in one traversal from left to right, which carries the state and
adds up log-probabilities; the documents of a unit take their steps side by side.

No n-gram is left out and the automaton is never in one place: documents are a table of units, coded by
vocabularies of their own, which ask for the counts of their n-grams and traverse what comes back. Units send their distinct n-grams, as
sorted 56-bit hashes with their own counts, to buckets of the hash; a bucket adds up and answers each
unit with the totals alone, in the order of its question. So a bucket has of no n-gram more entries than
there are units, and the corpus is summed with one shuffle of its distinct n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, framed, grouped, packed, rows, stored, texts, unframed, unpacked
from .common import held as keep_nothing

ADD = 0.1
#: Weight of the next lower state beside a word's and a pair's own counts.
WORD_K, PAIR_K = 8.0, 2.0
#: Tokens of a unit, and bytes of a bucket.
UNIT_TOKENS, BUCKET_BYTES = 2_000_000, 64 << 20
#: The end of a text as a word; no text holds it, as words have no white space.
END = b" "
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: The hash that stands for the start of a text.
START = np.uint64(0x243F6A8885A308D3)
_8 = np.uint64(8)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C[0] + b + _C[3])


def triple_key(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(pair * _C[0] + c + _C[4])


class Unit:
    """Documents as places in a vocabulary of their own, each with END at its end."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {END: 0}
        self.ids, self.places, self.lengths, self.total = [], [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        put = self.vocabulary.setdefault
        self.places.append(np.fromiter((put(w, len(self.vocabulary)) for w in (*words, END)), dtype=np.uint32, count=len(words) + 1))
        self.ids.append(doc_id), self.lengths.append(len(words) + 1)
        self.total += len(words) + 1

    def close(self) -> Unit:
        self.sizes, self.flat = np.array(self.lengths, dtype=np.int64), np.concatenate(self.places)
        self.hashes = np.fromiter(map(word_hash, self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))
        return self

    def data(self) -> bytes:
        null = bytes(d is None for d in self.ids)
        return framed([np.array([d or 0 for d in self.ids], dtype=np.int64).tobytes(), null, self.sizes.tobytes(), packed(self.flat), packed(self.hashes)])

    @classmethod
    def of(cls, data: bytes) -> Unit:
        self, (ids, null, sizes, flat, hashes) = cls.__new__(cls), unframed(data)
        self.ids = [None if x else d for d, x in zip(np.frombuffer(ids, dtype=np.int64).tolist(), null)]
        self.sizes, self.flat, self.hashes = np.frombuffer(sizes, dtype=np.int64), unpacked(flat, np.uint32), unpacked(hashes)
        return self

    def ngrams(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The hashes of the unigrams, bigrams and trigrams that end at each token, and at which ones a trigram does: not at a text's first."""
        h = self.hashes[self.flat]
        first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[first] = START
        pair = pair_key(before, h)
        triple = np.zeros_like(h)
        triple[1:] = triple_key(pair[:-1], h[1:])
        inner = np.ones(len(h), dtype=bool)
        inner[first] = False
        return [h, pair, triple[inner]], inner


def distinct(keys: np.ndarray, train: np.ndarray | None = None):
    """Sorted distinct keys of 56 bits; with how many of each are ``train``, if that is given."""
    e = (keys >> _8) << _8
    if train is not None:
        e |= train.astype(np.uint64)
    e.sort()
    key = e >> _8
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(e & np.uint64(1), first).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)) if train is not None else None


class Automaton:
    """The part of the automaton that a unit's documents can reach: sorted n-gram keys of each order, and their counts.

    n, v: all training tokens, and different ones; n_texts: training texts, the count of the start state.
    """

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray], n: int, v: int, n_texts: int):
        self.keys, self.counts = keys, [np.append(c, 0).astype(np.float64) for c in counts]  # [-1]: no such arc
        self.n_texts = float(n_texts)
        self.denominator = n + ADD * (v + 1)

    def count(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams; 0 where there is no arc."""
        among, keys = self.keys[order - 1], keys >> _8
        if not len(among):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return self.counts[order - 1][np.where(among[at] == keys, at, -1)]

    def start(self, n: int):
        """The state before the first word of n texts: word hash and count, pair key and count (none yet)."""
        return np.full(n, START), np.full(n, self.n_texts), np.zeros(n, dtype=np.uint64), np.zeros(n)

    def step(self, state, h: np.ndarray, unigrams: np.ndarray):
        """The next states, and the log-weights of the way there: an arc of the pair, or failing to the word's, or to the root's.

        h: the words' hashes; unigrams: their counts.
        """
        word, of_word, pair, of_pair = state
        p = (unigrams + ADD) / self.denominator
        next_pair = pair_key(word, h)
        bigrams = self.count(2, next_pair)
        p = np.where(of_word > 0, (bigrams + WORD_K * p) / (of_word + WORD_K), p)
        deep = np.flatnonzero(of_pair > 0)  # the other pairs are no states
        if len(deep):
            trigrams = self.count(3, triple_key(pair[deep], h[deep]))
            p[deep] = (trigrams + PAIR_K * p[deep]) / (of_pair[deep] + PAIR_K)
        return (h, unigrams, next_pair, bigrams), np.log10(p)

    def traverse(self, unit: Unit) -> np.ndarray:
        """Log-probabilities of the unit's texts; the k-th step of all texts that have one is taken at once."""
        order = np.argsort(-unit.sizes, kind="stable")
        first, sizes = (np.cumsum(unit.sizes) - unit.sizes)[order], unit.sizes[order]
        unigrams = self.count(1, unit.hashes)
        score, state = np.zeros(len(sizes)), self.start(len(sizes))
        left = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # texts longer than k
        for k, live in enumerate(left.tolist()):
            if live < len(state[0]):
                state = tuple(x[:live] for x in state)
            ids = unit.flat[first[:live] + k]
            state, weight = self.step(state, unit.hashes[ids], unigrams[ids])
            score[:live] += weight
        out = np.empty(len(sizes))
        out[order] = score
        return out


ROWS = "bucket long, unit long, data binary"
#: The unit under which a bucket tells its sums of unigrams.
SUMS = -1


def _batch(found):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "unit", "data"])


def _coded(batches, unit_tokens):
    """(unit, data) of the documents."""
    from pyspark import TaskContext

    keep_nothing(None, None)
    number, unit = TaskContext.get().partitionId() << 24, Unit()
    row = lambda: pa.RecordBatch.from_arrays([pa.array([number]), pa.array([unit.close().data()], pa.binary())], names=["unit", "data"])
    for some, text in rows(batches, most_rows=500, most_bytes=4 << 20):
        for d, t in zip(some, text):
            unit.add(d, words_of(t))
            if unit.total >= unit_tokens:
                yield row()
                number, unit = number + 1, Unit()
    if unit.ids:
        yield row()


def _asked(batches, fold, buckets):
    """To each bucket the n-grams of each unit in it, sorted, with the unit's own counts."""
    for _, ((number, data),) in grouped(batches, 1):
        unit = Unit.of(data)
        each = np.repeat(np.array([not fold or crc_mod(d, fold) != 0 for d in unit.ids]), unit.sizes)
        grams, inner = unit.ngrams()
        parts = []
        for keys, mask in zip(grams, (each, each, each[inner])):
            key, count = distinct(keys, mask)
            parts.append((key, count, np.searchsorted(((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(24), np.arange(buckets + 1))))
        found, size = [], 0
        for b in range(buckets):
            cuts = [(key[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]) for key, count, cut in parts]
            if any(len(key) for key, _ in cuts):
                found.append((b, number, framed([x for key, count in cuts for x in (packed(np.diff(key, prepend=np.uint64(0))), packed(count))])))
                size += len(found[-1][2])
            if found and (size > 4 << 20 or b + 1 == buckets):
                yield _batch(found)
                found, size = [], 0
        if found:
            yield _batch(found)


def _answered(batches):
    """Of each bucket, to each unit the totals of its n-grams in the order it asked; and the bucket's own sums of unigrams."""
    for bucket, group in grouped(batches):
        data = [unframed(row[2]) for row in group]
        answers, out = [[] for _ in group], []
        for order in range(3):
            keys = [np.cumsum(unpacked(d[2 * order]), dtype=np.uint64) for d in data]
            counts = np.concatenate([unpacked(d[2 * order + 1], np.uint32) for d in data])
            key = np.concatenate(keys)
            turn = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, key[turn][1:] != key[turn][:-1])) if len(key) else np.zeros(0, np.int64)
            sums = np.add.reduceat(counts[turn].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
            totals = np.empty(len(key), dtype=np.uint64)
            totals[turn] = np.repeat(sums, np.diff(np.append(first, len(key))))
            at = 0
            for answer, k in zip(answers, keys):
                answer.append(packed(totals[at : at + len(k)]))
                at += len(k)
            if order == 0:
                out.append((bucket, SUMS, int(sums.sum()).to_bytes(8, "little") + int((sums > 0).sum()).to_bytes(8, "little")))
        yield _batch(out + [(bucket, row[1], framed(answer)) for row, answer in zip(group, answers)])


def _scored(batches, fold, n, v, n_texts):
    """(unit, bucket, data) sorted by unit in, the unit's own row without bucket; a row for each document out."""
    for _, group in grouped(batches):
        unit = Unit.of(next(row[2] for row in group if row[1] is None))
        answers = [unframed(row[2]) for row in sorted((row for row in group if row[1] is not None), key=lambda row: row[1])]
        counts = [np.concatenate([unpacked(a[order]) for a in answers]) for order in range(3)]
        automaton = Automaton([distinct(keys)[0] for keys in unit.ngrams()[0]], counts, n, v, n_texts)
        score = automaton.traverse(unit)
        unigrams = automaton.count(1, unit.hashes)
        first = np.cumsum(unit.sizes) - unit.sizes
        base = np.add.reduceat(np.log10((unigrams + ADD) / automaton.denominator)[unit.flat], first)
        known = np.add.reduceat((unigrams > 0).astype(np.int64)[unit.flat], first)
        for at in range(0, len(unit.ids), 10_000):
            cut = slice(at, at + 10_000)
            held_out = [fold > 0 and crc_mod(d, fold) == 0 for d in unit.ids[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(unit.ids[cut], pa.int64()), pa.array(held_out, pa.bool_()), pa.array(unit.sizes[cut]), pa.array(known[cut]), pa.array(np.full(len(held_out), n)), pa.array(base[cut]), pa.array(score[cut])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scores(docs: DataFrame, fold: int = 10, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from the rows whose crc32 of doc_id modulo ``fold`` is not 0 (all rows if fold is 0). Null
    text is empty: its end is its one token. Repeated rows count and are scored each; without
    training rows every token is unknown and both scores are those of an empty count table. Columns other
    than doc_id and text are left out. A text of ``unit_tokens`` or more ends its unit; the units change no score.
    """
    spark = docs.sparkSession
    base = texts(docs)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(fold) != 0 if fold else F.lit(True)
    size, n_texts = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(train.cast("long")), F.lit(0))).first()
    # three n-grams of eight bytes and their counts to a word of six letters
    buckets = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * 5 / BUCKET_BYTES)))
    by = lambda df, key: df.repartition(key).sortWithinPartitions(key)
    units = stored(base.mapInArrow(lambda it: _coded(it, unit_tokens), "unit long, data binary"), "coded")
    told = stored(by(units.mapInArrow(lambda it: _asked(it, fold, buckets), ROWS), "bucket").mapInArrow(_answered, ROWS), "told")
    # a row of two numbers for each bucket
    sums = [np.frombuffer(r.data, dtype=np.int64) for r in told.where(F.col("unit") == SUMS).select("data").toLocalIterator()]
    n, v = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    both = told.where(F.col("unit") != SUMS).select("unit", "bucket", "data").union(units.select("unit", F.lit(None).cast("long"), "data"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by(both, "unit").mapInArrow(lambda it: _scored(it, fold, n, v, n_texts), schema)
