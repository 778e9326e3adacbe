"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items, as word sequences, go into one suffix automaton. A document's words are
streamed through it; the matching length at each word tells which spans also stand in an item.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, sliced, stored, texts

WINDOW = 10
#: Item words in one automaton; a larger benchmark is taken in several blocks, each against all documents.
BLOCK_WORDS = 400_000
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Words of letters a-z, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(_WORD).split()


class SuffixAutomaton:
    """Over the word ids of several items; ``owners`` tells, for each window state, the items it stands in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([min(window, len(ids)) for _, ids in coded], default=window)
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}  # state -> (length, item) of short items ending there
        for name, ids in coded:
            state = length = 0
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= window:
                    self.owners.setdefault(self.cut(state), set()).add(name)
            if len(ids) < window:
                self.short.setdefault(self.cut(state, len(ids)), []).append((len(ids), name))
        self.up = [0] * len(self.link)  # nearest ancestor or self at which a short item ends
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[v] = v if v in self.short else (self.up[self.link[v]] if self.link[v] > 0 else 0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # an item that begins like an earlier one
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def cut(self, state: int, size: int | None = None) -> int:
        """The state of the last ``size`` words of what ``state`` stands for."""
        size = size or self.window
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of covered words (end exclusive, joined), the items that occur, and the longest match (0: none as long as a window or a whole item)."""
        ids = np.fromiter(map(self.vocab.get, words, _zeros()), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        most = 0
        for a, b in edges.reshape(-1, 2):
            if b - a < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), int(a)):
                state, length = self.step(state, length, c)
                if length >= self.window:
                    most = max(most, length)
                    found |= self.owners[self.cut(state)]
                    spans.append((i + 1 - self.window, i + 1))
                s = self.up[state]
                while s > 0:
                    for size, name in self.short.get(s, ()):
                        if size <= length:
                            most = max(most, size)
                            found.add(name)
                            spans.append((i + 1 - size, i + 1))
                    s = self.up[self.link[s]] if self.link[s] > 0 else 0
        return joined(spans), found, most


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from the first to the last byte of each span of words."""
    flat = text.lower().translate(_WORD)
    marks = np.frombuffer(flat, dtype=np.uint8) != 32
    turn = np.flatnonzero(np.diff(np.concatenate(([0], marks, [0])).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : turn[a, 0]])
        at = int(turn[b - 1, 1])
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size; of a benchmark of any size two blocks at most are on the driver."""
    part, total = [], 0
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary"))
    for name, text in items.toLocalIterator():
        part.append((name or "", bytes(text)))
        total += len(item_words(bytes(text)))
        if total >= most_words:
            yield part
            part, total = [], 0
    if part:
        yield part


SPAN = "array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _automaton(sent, key: str, window: int) -> SuffixAutomaton:
    """The block's automaton, which a worker builds once and keeps from task to task."""
    return held(("automaton", key), lambda: SuffixAutomaton([(n, item_words(t)) for n, t in sent.value], window))


def _sent(spark, block):
    return spark.sparkContext.broadcast(block), uuid.uuid4().hex  # bounded by BLOCK_WORDS


def _first_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int | None):
    """The first block, and an iterator over all of them if there are more."""
    blocks = _blocks(benchmark, id_col, text_col, most_words or BLOCK_WORDS)
    first, second = next(blocks, []), next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)


def _found(numbered: DataFrame, blocks, window: int) -> DataFrame:
    """(uid, spans, items, longest) of the documents any block occurs in: a pass over ``numbered`` (uid, text) for each
    block, of which only hits are kept, so that one automaton is alive at a time and all blocks judge the input."""
    spark, schema = numbered.sparkSession, f"uid long, spans {SPAN}, items array<string>, longest int"
    out = None
    for block in blocks:
        sent, key = _sent(spark, block)
        some = stored(numbered.select("uid", "text").mapInArrow(lambda it, sent=sent, key=key: _hits(it, sent, key, window), schema), "spans")
        out = some if out is None else out.union(some)
        sent.unpersist()
    return out.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))


def _hits(batches, sent, key, window):
    automaton = _automaton(sent, key, window)
    for batch in sliced(batches):
        rows = [(u, *automaton.scan(item_words(t))) for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows = [r for r in rows if r[3]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), _span_array(r[1] for r in rows), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int32())], names=["uid", "spans", "items", "longest"])


def _span_array(spans) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", block_words: int | None = None) -> DataFrame:
    """(doc_id, text, n_words, spans, items, longest) of every document.

    spans: covered runs of words as (start, end) arrays; items: ids, as strings, of the test items
    found, sorted; longest: words of the longest match that counts (0: none). Null and empty texts have no words and no spans; an
    item of fewer than ``window`` words counts as one window, an item without words as none; repeated
    items and rows are each counted under their own id; other columns of either table are left out. A benchmark
    beyond ``block_words`` (BLOCK_WORDS) takes a pass for each block, with the same rows.
    """
    spark = docs.sparkSession
    schema = f"doc_id long, text binary, n_words int, spans {SPAN}, items array<string>, longest int"
    first, blocks = _first_blocks(benchmark, item_id, item_text, block_words)
    if blocks is None:
        sent, key = _sent(spark, first)
        return texts(docs).mapInArrow(lambda it: _scan(it, sent, key, window), schema)
    numbered = stored(texts(docs, uid=F.monotonically_increasing_id()), "numbered")
    return numbered.join(_found(numbered, blocks, window), "uid", "left").select("doc_id", "text", "spans", "items", "longest").mapInArrow(_merged, schema)


_NAMES = ["doc_id", "text", "n_words", "spans", "items", "longest"]


def _scan(batches, sent, key, window):
    automaton = _automaton(sent, key, window)
    for batch in sliced(batches):
        words = [item_words(t) for t in batch.column(1).to_pylist()]
        found = [automaton.scan(w) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), pa.array(map(len, words), pa.int32()), _span_array(f[0] for f in found), pa.array([sorted(f[1]) for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.int32())], names=_NAMES)


def _merged(batches):
    for batch in sliced(batches):
        n = [len(item_words(t)) for t in batch.column(1).to_pylist()]
        spans = [joined([(x["a"], x["b"]) for x in s or ()]) for s in batch.column(2).to_pylist()]
        items, longest = [x or [] for x in batch.column(3).to_pylist()], [x or 0 for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), pa.array(n, pa.int32()), _span_array(spans), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())], names=_NAMES)


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, block_words: int | None = None) -> DataFrame:
    """The rows of ``docs``, covered spans cut out of ``text``; a document covered for more than ``most_coverage`` goes.

    The text of a document without hits stays as it is, null and empty ones included; n_chars, where present,
    follows a text that was cut; repeated rows are each cut. Needs the columns doc_id and text; all others pass
    through. All items judge the input, then there is one cut, however many blocks the items make.
    """
    spark, schema = docs.sparkSession, docs.schema
    first, blocks = _first_blocks(benchmark, "item_id", "text", block_words)
    if blocks is None:
        sent, key = _sent(spark, first)
        return docs.mapInArrow(lambda it: _cut(it, _automaton(sent, key, window), most_coverage), schema)
    numbered = stored(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")
    found = _found(numbered.select(F.col("__uid").alias("uid"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), blocks, window)
    marked = numbered.join(found.select(F.col("uid").alias("__uid"), F.col("spans").alias("__spans")), "__uid", "left").drop("__uid")
    return marked.mapInArrow(lambda it: _cut(it, None, most_coverage), schema)


def _cut(batches, automaton, most):
    """Rows cut and kept; spans come from the automaton or stand in the last column."""
    for batch in sliced(batches):
        at = batch.schema.get_field_index("text")
        spans_of = batch.column(batch.num_columns - 1).to_pylist() if automaton is None else None
        keep, new = [], []
        for i, t in enumerate(batch.column(at).to_pylist()):
            raw = (t or "").encode()
            words = item_words(raw)
            spans = automaton.scan(words)[0] if automaton is not None else joined([(x["a"], x["b"]) for x in spans_of[i] or ()])
            covered = sum(b - a for a, b in spans)
            keep.append(not covered or covered <= most * len(words))
            new.append(cut_text(raw, spans).decode() if spans else t)
        fields = list(batch.schema)[: batch.num_columns - (automaton is None)]
        arrays = list(batch.columns)[: len(fields)]
        arrays[at] = pa.array(new, fields[at].type)
        if (n := batch.schema.get_field_index("n_chars")) >= 0:
            old = batch.column(at).to_pylist()
            arrays[n] = pa.array([c if a is b or a == b else len(a) for a, b, c in zip(new, old, batch.column(n).to_pylist())], fields[n].type)
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields)).filter(pa.array(keep, pa.bool_()))
