"""Helpers the corpus operators share: shared storage, safe column selection, words, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder if all of Spark
    is in this process (a local master), else one in the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def lookup(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a stored table of a few numbers a row, to be broadcast in a join if it has at most ``most`` rows; else Spark deals both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(doc_id, text as binary, ``more``); null text is empty. Further columns, whatever their names, are left out."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
        *[col.alias(name) for name, col in more.items()],
    )


def crc_mod(value: int | None, n: int) -> int:
    """crc32 of the number written as text, modulo n (a null counts as the empty text)."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def crc_mod_col(column: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task, ``make()`` the first time; one thing at once, whatever operator asks.

    Workers outlive tasks and run all operators' tasks in turn: what one has gathered goes, back to the
    system too, when another begins. held(None, None) keeps nothing.
    """
    if key not in _held:
        _held.clear()
        trim()
        if key is not None:
            _held[key] = make()
    return _held.get(key)


def trim() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(make):
    """``make``, a function for mapInArrow, in a worker that keeps nothing: what earlier tasks left goes when it begins, its own when it ends.

    A worker outlives its tasks, and what they freed else stays with it, beside all that the next stage takes.
    """

    def task(batches):
        held(None, None)
        yield from make(batches)
        trim()

    return task


def sliced(batches: Iterator[pa.RecordBatch], most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)


def rows(batches: Iterator[pa.RecordBatch], most_rows: int = 2000, most_bytes: int = 24 << 20):
    """(ids, texts) lists of bounded size from (doc_id, text) batches."""
    for batch in batches:
        start = 0
        text = batch.column(1)
        sizes = np.diff(np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + text.offset + 1)[text.offset :]) if len(text) else []
        total = 0
        for i in range(len(text)):
            total += int(sizes[i])
            if i + 1 - start >= most_rows or total >= most_bytes or i + 1 == len(text):
                yield batch.column(0).slice(start, i + 1 - start).to_pylist(), text.slice(start, i + 1 - start).to_pylist()
                start, total = i + 1, 0


def packed(a: np.ndarray) -> bytes:
    """Integers by bytes of equal weight, as the upper ones of sorted or small numbers hardly change, compressed."""
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind=np.uint64) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    raw = pa.decompress(data[8:], decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def framed(parts: list[bytes]) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def grouped(batches: Iterator[pa.RecordBatch], most: int = 200):
    """(key, rows) of the rows with the same first value, from rows sorted by it."""
    held, at = [], None
    for batch in sliced(batches, most):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row)
    if held:
        yield at, held


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal first values, as numpy columns, many runs at a time, from rows sorted by it."""
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        cut = np.searchsorted(cols[0], cols[0][-1], side="left")
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def contracted(batches, most: int = 500_000):
    """Edges in, a forest of their components out: (node, smallest node) of the nodes that differ.

    Whenever ``most`` new edges are held, they are contracted with the forest so far; a task so gives each node once,
    and holds its nodes and ``most`` edges.
    """
    held, n = [], 0

    def forest():
        nodes, place = np.unique(np.concatenate(held), return_inverse=True)
        a, b = place.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:  # hook the larger label to the smaller one, then let labels run down
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[moved], nodes[label[moved]]

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).ravel())
            n += batch.num_rows
        if n >= most:
            u, v = forest()
            held, n = [np.stack([u, v], axis=1).ravel()], 0
    if held:
        u, v = forest()
        for at in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(v[at : at + 100_000])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node whose component has a smaller one: the smallest node it is connected with.

    Each round deals edges by their larger node to tasks, which contract what they hold to a forest
    (small star), and then links every node to the smallest neighbour of its parent (large star).
    A forest has one row for each child, so before either shuffle a node of any degree has a row or a
    minimum for each task at most. Many children of one parent are dealt by the parent in the join only,
    where Spark splits a large partition. It ends when every child has one neighbour. Rounds are tables in
    the shared folder, of which the last stays; no edges reach the driver.
    """
    forest = lambda df: df.mapInArrow(lean(contracted), "u long, v long")
    e, old = forest(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")), ()
    for _ in range(most_rounds):
        s = stored(forest(e.repartition("u")), "cc")
        drop(*old)
        both = s.union(s.select(F.col("v"), F.col("u")))
        m = stored(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("low"), F.max("v").alias("high")), "cc")
        if m.where("low < c and low < high").isEmpty():
            drop(m)
            return s.select(F.col("u").alias("node"), F.col("v").alias("component"))
        e, old = forest(s.join(m, F.col("v") == F.col("c")).select("u", F.least("c", "low").alias("v"))), (s, m)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
