import os
import random
from collections import Counter, defaultdict

import corpus_pipeline as P
from test_operators import docs, pairs, prose, table  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        after = stage(spark, before, SF)
        if k + 1 < len(P.STAGES):
            assert after.columns == docs.columns, name
            after = P.stored(after, "test")
            assert 0 < after.count() <= before.count()
        before = after
    assert before.where("sample = 1").count() > 0


def test_clean_documents_stay(spark):
    """What is neither toxic, nor a copy, nor contaminated comes through untouched."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.decontamination(spark, P.near_dedup(spark, P.exact_dedup(spark, docs, SF), SF), SF)
    assert out.count() >= 0.5 * docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def shingles(text, size=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_odd_rows(spark, docs, pairs):
    """Null, empty and very long texts, ties, repeated rows and clashing columns, stage by stage."""
    row = lambda r: tuple(r.asDict().values())
    before = Counter(map(row, docs.collect()))

    kept = P.toxicity(spark, docs, SF)
    assert kept.schema == docs.schema
    fate = defaultdict(set)
    after = Counter(map(row, kept.collect()))
    for r, n in before.items():
        assert after[r] in (0, n)
        fate[r[1] or ""].add(after[r] > 0)
    assert after and not after - before and all(len(x) == 1 for x in fate.values())

    kept = P.exact_dedup(spark, docs, SF)
    bare = lambda t: (t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))
    longest = defaultdict(int)
    for _, t in pairs:
        longest[bare(t)] = max(longest[bare(t)], len(t or ""))
    after = Counter(map(row, kept.collect()))
    assert kept.schema == docs.schema and not after - before
    assert sorted((bare(r[1]), len(r[1] or "")) for r in after.elements()) == sorted(longest.items())

    kept = P.near_dedup(spark, docs, SF)
    sets = [(d, shingles(t)) for d, t in pairs if d is not None]
    lead = {d: d for d, _ in sets}

    def top(d):
        while lead[d] != d:
            d = lead[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and (p := top(a)) != (q := top(b)):
                lead[max(p, q)] = min(p, q)
    assert kept.schema == docs.schema
    assert Counter(map(row, kept.collect())) == Counter(r for r in before.elements() if r[0] is None or top(r[0]) == r[0])

    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len((r.text or "").split()) >= 15)
    clean = prose(random.Random(5), 100)
    more = table(spark, [(90, f"{clean} {item}"), (91, item)])
    got = [row(r) for r in P.decontamination(spark, docs.union(more), SF).collect()]
    assert Counter(r for r in got if r[0] not in (90, 91)) == before
    (left,) = [r for r in got if r[0] in (90, 91)]
    assert left[0] == 90 and left[1].rstrip(" .").split() == clean.split() and left[4] == len(left[1])

    got = P.sampled_encoding(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got if r["sample"] == 1) == Counter(d for d, _ in pairs)
    assert all(r.n_ids == 0 for r in got if r.doc_id in (40, 41)) and sum(r.doc_id in (40, 41) for r in got) == 2
