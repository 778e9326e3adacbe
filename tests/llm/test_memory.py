"""What workers take and leave."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import common, rtree
from quillon.llm.common import packed, unpacked


def _asked(units, each, rng):
    """A bucket's rows: for each unit entries of hashes of one document, and of several with their number."""
    rows = []
    for unit in range(units):
        h = np.unique(rng.integers(1 << 40, (1 << 40) + 4 * units * each, each).astype(np.uint64))
        cut = len(h) // 4
        several = np.sort(rng.permutation(len(h))[:cut])
        single = np.delete(h, several)
        rows.append((0, unit, rtree.SINGLE, packed(single << np.uint64(16) | rng.integers(0, 60_000, len(single)).astype(np.uint64))))
        rows.append((0, unit, rtree.MANY, packed(h[several] << np.uint64(16) | rng.integers(2, 400, cut).astype(np.uint64))))
    return rows


def _answers(rows):
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.binary()])], names=["bucket", "unit", "kind", "data"])
    return {(u, k): d for b in rtree._counted(iter([batch])) for _, u, k, d in zip(*(c.to_pylist() for c in b.columns))}


def test_a_bucket_is_counted_right_over_several_ranges():
    rows = _asked(12, 150_000, np.random.default_rng(3))
    h, n = [], []
    for _, _, kind, data in rows:
        e = unpacked(data)
        h.append(e >> np.uint64(16)), n.append((e & np.uint64(0xFFFF)).astype(np.int64) if kind == rtree.MANY else np.ones(len(e), np.int64))
    assert sum(map(len, h)) > 1_000_000
    keys, place = np.unique(np.concatenate(h), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(n)).astype(np.int64)
    found = _answers(rows)
    for _, unit, kind, data in rows:
        e = unpacked(data)
        df = total[np.searchsorted(keys, e >> np.uint64(16))]
        d = found[unit, kind]
        m = int.from_bytes(d[:8], "little")
        assert np.array_equal(unpacked(d[8 + m :]), e[df > 1])
        assert np.array_equal(np.frombuffer(d, np.uint8, m, 8), np.minimum(df[df > 1], rtree.HOT))


def test_counting_a_bucket_takes_little_more_than_its_entries():
    rows = _asked(12, 150_000, np.random.default_rng(4))
    entries = sum(8 * len(unpacked(r[3])) for r in rows)
    _answers(rows[:2])  # what is imported at first use doesn't count
    tracemalloc.start()
    try:
        _answers(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * entries


def test_a_lean_task_keeps_nothing_of_others():
    common.held("table", lambda: [1])
    seen = []

    def task(batches):
        seen.append("table" in common._held)
        yield from batches

    assert list(common.lean(task)(iter([1, 2]))) == [1, 2]
    assert seen == [False] and not common._held
