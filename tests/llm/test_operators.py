"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import backoff, common, dac, gumbel, radix, recompress, rtree, suffixauto, toxcnn, urlalias, weaklabel

public = pytest.importorskip("public_tokenizers")

#: Further columns under names the operators use themselves.
EXTRA = "uid string, key int, n int, word string, component long, page long, size int, digest string, kept string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def table(spark, pairs):
    rows = [(d, t, "en", "s", None if t is None else len(t), "u", 1, 2, "w", 3, 4, 5, "d", "k") for d, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def prose(r, n, words=300):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(3)
    base = [prose(r, r.randrange(1, 90)) for _ in range(40)]
    out = list(enumerate(base))
    out += [(40, None), (41, ""), (42, " \t\n"), (43, base[0]), (44, base[0].replace(" ", "\n\n")), (45, base[1] + " tail"), (46, base[2].upper()), (47, "Äß日本 \x0b x"), (48, prose(r, 20000))]
    out += [(49, "a " * 60), (50, "b " + "a " * 47), (51, "one two"), (52, "one two"), (3, base[3]), (None, base[4])]
    near = base[5].split() * 2
    for k in range(53, 60):
        copy = list(near)
        copy[r.randrange(len(copy))] = f"new{k}"
        out.append((k, " ".join(copy)))
    return out


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return table(spark, pairs).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return (t or "").encode()


def crc(d):
    return zlib.crc32(b"" if d is None else str(d).encode())


# -- 1 ---------------------------------------------------------------------------------------------


def test_segments_random_access():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 513, 9000):
        ids = r.zipf(1.2, n).clip(0, 60000).astype(np.uint32)
        s = dac.Segment(dac.encode(ids))
        assert len(s) == n and (s.decode() == ids).all()
        assert all(s[i] == ids[i] for i in range(0, n, 13))
    with pytest.raises(IndexError):
        s[9000]


def test_token_files(spark, docs, pairs, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.encoded(docs, path, by_word=True).collect()))
    start, want = 0, Counter()
    for d, t in sorted(pairs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter(x[1:] for x in got) == want
    order = [x[1] for x in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    for s, _, n, _ in got:
        assert s == start
        start += n
    assert dac.encoded(none, path).count() == 0
    whole = dac.write_tokens(docs, common.new_path(spark, "whole"), path)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.read_digests(spark, whole).collect()) == want
    lists = dac.read_tokens(spark, whole).where("doc_id = 51").first()
    assert lists.ids == tok.encode("one two", add_special_tokens=False).ids + [1]
    flat = {r.start + i: x for r in dac.read_tokens(spark, whole).collect() for i, x in enumerate(r.ids)}
    some = [0, 1, len(flat) - 1, *range(5, len(flat), 97), 5]
    assert sorted(map(tuple, dac.tokens_at(spark, whole, some).collect())) == sorted((i, flat[i]) for i in set(some))
    assert dac.tokens_at(spark, whole, []).count() == 0
    for outside in (-1, len(flat)):
        with pytest.raises(IndexError):
            dac.tokens_at(spark, whole, [0, outside])


def test_words_like_the_library():
    from tokenizers import Tokenizer

    tok, w = Tokenizer.from_file(public.path("word_bpe_49k.json")), dac._Words(public.path("word_bpe_49k.json"))
    for t in ("Don'T stop 'til 3.14%%", "Ünïcode ﬁ é x́ İstanbul ΟΔΟΣ", "<|endoftext|>x a\x1cb\x85c\xa0d", "naïve ÇA ŒUVRE ſ ŉ", "日本語 한국어 👍🏽"):
        words = t.encode().split()
        w.learn([words])
        assert np.frombuffer(w.ids(words), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


# -- 2 ---------------------------------------------------------------------------------------------


def test_labellers_recovered():
    r = np.random.default_rng(2)
    n, accuracy = 20000, [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.9, 0.85, 0.8, 0.7]
    truth = r.random(n) < 0.7
    votes = Counter()
    for y, row in zip(truth, r.random((n, 22))):
        votes["".join("-" if row[11 + k] < 0.2 else str(int(y == (row[k] < a))) for k, a in enumerate(accuracy))] += 1
    prior, table_ = weaklabel.fit_labellers(votes)
    assert abs(prior - 0.7) < 0.02
    for k, a in enumerate(accuracy):
        assert abs(table_[1, k, 1] / (table_[1, k, 0] + table_[1, k, 1]) - a) < 0.05  # pseudo-counts pull it a little


def test_quality(spark, docs, pairs, none):
    got = weaklabel.quality(docs).collect()
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert weaklabel.quality(none).count() == 0
    r = random.Random(4)
    good = [(k, ". ".join("The " + prose(r, 8) + " of the house and it is in the " + prose(r, 3) for _ in range(12)) + ".") for k in range(60)]
    bad = [(100 + k, " ".join(w + "***" for w in prose(r, 80).upper().split())) for k in range(40)]
    out = {x.doc_id: x.score for x in weaklabel.quality(table(spark, good + bad)).collect()}
    assert min(out[k] for k, _ in good) > max(out[k] for k, _ in bad)


def test_quality_as_one_pass(docs, pairs):
    """All rows on one machine: patterns counted, labellers fitted, every distinct row in the scorer's sample."""
    rows = list(dict.fromkeys((d, text_of(t)) for d, t in pairs))
    prior, tables = weaklabel.fit_labellers(dict(Counter(weaklabel.votes(text_of(t)) for _, t in pairs)))
    truth = lambda t: weaklabel.posterior(weaklabel.votes(t), prior, tables)
    w, b = weaklabel.fit_scorer([(t, truth(t)) for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))])
    weights = weaklabel._Weights(w)
    want = sorted((d or -1, weaklabel.votes(t), truth(t), weaklabel.score(t, weights, b)) for d, t in ((d, text_of(t)) for d, t in pairs))
    got = sorted((r.doc_id or -1, r.votes, r.posterior, r.score) for r in weaklabel.quality(docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=1e-6)


# -- 3 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [(None, None), (200, 3)])
def test_exact_groups(docs, pairs, none, limits):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[text_of(t).translate(None, common.SPACES.encode())].append((d, t))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda x: (-len(x[1] or ""), x[0] is not None, x[0] or 0))
        for d, _ in members:
            want[(d, best[0], len(members), hashlib.sha256(norm).hexdigest())] += 1
    got = radix.exact_groups(docs, *limits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert radix.exact_groups(none).count() == 0
    kept = radix.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_split_equal():
    r = random.Random(1)
    items = [bytes(r.choices(b"ab", k=r.randrange(40))) for _ in range(300)] + [b"x" * 1000, b"x" * 1000, b"x" * 1001]
    want = defaultdict(list)
    for k, x in enumerate(items):
        want[x].append(k)
    assert sorted(map(sorted, radix.split_equal(items))) == sorted(want.values())


# -- 4 ---------------------------------------------------------------------------------------------


def test_sampling_without_replacement():
    lat = gumbel.Lattices(gumbel.Vocabulary(public.path("piece_bpe_32k.model"), 0.5))
    first, either, probability, n = Counter(), Counter(), {}, 12000
    for at in range(0, n, 2000):
        for paths, _ in gumbel.sample_batch(lat, list(range(at, at + 2000)), ["the"] * 2000, 2, 9):
            keys = [tuple(gumbel.ids_of(lat, p.edges)) for p in paths]
            assert len(set(keys)) == 2 and paths[0].score >= paths[1].score
            first[keys[0]] += 1
            for k, p in zip(keys, paths):
                either[k] += 1
                probability[k] = math.exp(p.log)
    assert abs(sum(probability.values()) - 1) < 1e-3
    for k, p in probability.items():
        included = p + sum(q * p / (1 - q) for j, q in probability.items() if j != k)
        assert abs(first[k] / n - p) < 0.02 and abs(either[k] / n - included) < 0.02


def test_sampling_all_segmentations_and_bytes():
    lat = gumbel.Lattices(gumbel.Vocabulary(public.path("piece_bpe_32k.model"), 1.0))
    (paths, bound), (empty, _) = gumbel.sample_batch(lat, [1, 2], ["ab", ""], 50, 0)
    assert bound == -np.inf and abs(sum(math.exp(p.log) for p in paths) - 1) < 1e-5
    assert len({tuple(p.edges) for p in paths}) == len(paths) and [p.score for p in paths] == sorted([p.score for p in paths], reverse=True)
    assert len(empty) == 1 and len(empty[0].edges) == 0
    assert gumbel.inclusion(-3.0, -np.inf) == 0.0 and gumbel.inclusion(-3.0, -1.0) == pytest.approx(math.log(1 - math.exp(-math.exp(-2.0))))


def test_sampled_round_trip(docs, pairs, none):
    model = public.path("piece_bpe_32k.model")
    found = gumbel.sampled(docs, model, k=2).cache()
    back = Counter((r.doc_id, r.text) for r in gumbel.decoded(found.where("sample = 1"), model).collect())
    assert back == Counter((d, t or "") for d, t in pairs)
    assert found.where("sample = 2").count() == sum(bool(t) for _, t in pairs)
    again = gumbel.sampled(docs.repartition(7), model, k=2)
    assert found.select("doc_id", "sample", "ids", "score").exceptAll(again.select("doc_id", "sample", "ids", "score")).count() == 0
    assert gumbel.digest(gumbel.sampled(none, model), model).count() == 0
    whole = ["doc_id", "sample", "n_ids", "ids_crc32", "text_crc32"]
    one, two = gumbel.sampled_digest(docs, model, k=2), gumbel.digest(gumbel.sampled(docs, model, k=2), model)
    assert one.schema == two.schema and Counter(one.select(*whole).collect()) == Counter(two.select(*whole).collect())
    assert gumbel.sampled_digest(none, model).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------


def brute_hits(words, items):
    hit, found = set(), set()
    for name, w in items:
        size = min(10, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(name)
    return hit, found


def test_decontamination(spark, docs, pairs, none):
    r = random.Random(6)
    base = dict((d, t) for d, t in pairs if t)
    items = [(1, " ".join(base[6].split()[:14])), (2, "one TWO"), (3, None), (4, "..."), (5, prose(r, 30)), (10, " ".join(base[48].split()[100:140])), (10, "a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    coded = [(str(k), suffixauto.item_words(text_of(t))) for k, t in items]
    got = suffixauto.contamination(docs, bench).collect()
    assert len(got) == len(pairs)
    want = Counter()
    for d, t in pairs:
        words = suffixauto.item_words(text_of(t))
        hit, found = brute_hits(words, coded)
        want[(d, len(words), len(hit), tuple(sorted(found)))] += 1
    assert Counter((x.doc_id, x.n_words, sum(s.b - s.a for s in x.spans), tuple(x["items"])) for x in got) == want
    clean = suffixauto.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    rest = {x.doc_id: x.text for x in clean.collect()}
    assert rest[7] == base[7] and rest[40] is None and 51 not in rest
    assert rest[48] is not None and brute_hits(suffixauto.item_words(rest[48].encode()), coded[5:6])[0] == set()
    for words in (1, 40):  # an automaton for each item, or for a few
        again = suffixauto.contamination(docs, bench, block_words=words).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
        assert sorted(map(repr, suffixauto.decontaminated(docs, bench, block_words=words).collect())) == sorted(map(repr, clean.collect()))
    assert suffixauto.contamination(none, bench).count() == 0
    assert suffixauto.contamination(docs, bench.where("false")).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("words", [None, 1])
def test_items_that_overlap_are_judged_together(spark, words):
    """Two items cover 20 of 35 words between them, each alone fewer than half: the document goes in whatever blocks they come."""
    w = [f"t{k}" for k in range(35)]
    bench = spark.createDataFrame([(1, " ".join(w[:12])), (2, " ".join(w[8:20]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w + [f"u{k}" for k in range(20)]))], "doc_id long, text string")
    assert [tuple(x) for x in suffixauto.decontaminated(docs, bench, block_words=words).collect()] == [(2, " " + " ".join(w[20:] + [f"u{k}" for k in range(20)]))]


def test_automaton_on_random_words():
    r = random.Random(7)
    for _ in range(60):
        items = [(str(k), [bytes([97 + r.randrange(3)]) for _ in range(r.randrange(0, 25))]) for k in range(4)]
        words = [bytes([97 + r.randrange(3)]) for _ in range(60)]
        spans, found, _ = suffixauto.SuffixAutomaton(items).scan(words)
        hit, names = brute_hits(words, items)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == names


# -- 6 ---------------------------------------------------------------------------------------------


def brute_removed(pairs):
    first = {}
    for d, t in pairs:
        w = text_of(t).split()
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = Counter()
    for d, t in pairs:
        w = text_of(t).split()
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out[(d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rounds", [1, 2])
def test_repeated_spans(spark, docs, pairs, none, rounds):
    got = recompress.digest(recompress.repeated_spans(docs, rounds=rounds)).collect()
    assert Counter(map(tuple, got)) == brute_removed(pairs)
    r = random.Random(8)
    stock = [" ".join(r.choice("abc") for _ in range(40)) for _ in range(6)]
    mixed = [(k, " ".join(r.choice([*stock, prose(r, 15), "a " * r.randrange(30)]) for _ in range(4))) for k in range(60)]
    got = recompress.digest(recompress.repeated_spans(table(spark, mixed).repartition(4), rounds=rounds)).collect()
    assert Counter(map(tuple, got)) == brute_removed(mixed)
    assert recompress.repeated_spans(none).count() == 0


def shuffled(spark):
    """Bytes written for shuffles by each stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_shared_windows_travel_packed(spark):
    """A window that is shared costs less in the shuffles than its row of five numbers did, in however many buckets and questions."""
    r = random.Random(12)
    found = [(10 * k + side * (1 if k % 2 else -1), t) for k, t in enumerate([prose(r, 400, 10**9) for _ in range(300)], 1) for side in (0, 1)]
    found += [(-(1 << 63), found[0][1]), ((1 << 63) - 1, found[0][1])]
    before = shuffled(spark)
    got = recompress.digest(recompress.repeated_spans(table(spark, found).repartition(4))).collect()
    assert Counter(map(tuple, got)) == brute_removed(found)
    windows = sum(len(t.split()) - 12 for _, t in found)
    sent = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert 0 < sent / windows < 37


def test_buckets_and_questions_of_windows(spark, pairs, tmp_path, monkeypatch):
    want = brute_removed(pairs)
    for size in (1 << 30, 2000, 100):
        assert Counter(map(tuple, recompress.digest(recompress.repeated_spans(table(spark, pairs).repartition(3), bucket_bytes=size)).collect())) == want
    # a part that asks several times for one window is told its first document once
    monkeypatch.setattr(recompress, "BUFFER", 1)
    monkeypatch.setattr(recompress, "_told", lambda path, p, column: [recompress.pa.chunked_array([recompress.pa.array(names, recompress.pa.int64())])])
    w = prose(r := random.Random(5), 40, 10**9)
    batch = lambda d, t: recompress.pa.RecordBatch.from_pydict({"doc_id": recompress.pa.array([d]), "text": recompress.pa.array([t.encode()])})
    names = np.unique(recompress.anchors(recompress.Batch([w.encode()]))[2]).view(np.int64)
    asked = [b for p, ids in ((0, [7, 9, 8]), (1, [5]), (2, [6])) for b in recompress._asked([batch(d, x) for d in ids for x in (w, prose(r, 20))], p, "", 13, 1, 3)]
    assert len(asked) == 5
    told = Counter()
    for bucket in range(3):
        for b in recompress._earliest([a.filter(recompress.pa.compute.equal(a.column(0), bucket)) for a in asked]):
            for p, data in zip(*b.to_pydict().values()):
                _, _, low = recompress._unpacked(data, np.int32, np.int64)
                told.update((p, int(x)) for x in low)
    assert told == {(0, 5): 28, (2, 5): 28}


def test_windows_of_one_name_are_told_apart():
    names, checks = np.array([3, 5, 5, 5, 9]), np.array([1, 4, 6, 7, 2])
    asked = np.array([[5, 7], [5, 4], [5, 8], [9, 2], [3, 2], [4, 1], [10, 0]]).T
    assert recompress._same(*asked, names, checks).tolist() == [3, 1, -1, 4, -1, -1, -1]
    assert recompress._same(*asked, names[:0], checks[:0]).tolist() == [-1] * 7
    text = [b"a b c a b d", b"", b"b a c a b d"]
    b = recompress.Batch(text)
    at, _ = b.windows(3)
    want = [tuple(t.split()[i : i + 3]) for t in text for i in range(max(0, len(t.split()) - 2))]
    for found in (b.window_names(3, at), b.window_checks(3, at)):
        assert [[x == y for x in found] for y in found] == [[x == y for x in want] for y in want]


# -- 7 ---------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, pairs, none):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        words = prose(r, r.randrange(20, 120), 4000).split()
        if k % 3 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["vile", "Rotten,", "scorn"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 3 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = table(spark, rows)
    got = toxcnn.toxicity(d, lab).collect()
    assert all(r_.held_out == (crc(r_.doc_id) % 5 == 0) for r_ in got)
    held = [(x.predicted, x.doc_id % 3 == 0) for x in got if x.held_out]
    assert sum(bool(p) == y for p, y in held) / len(held) > 0.95
    kept = toxcnn.without_toxic(d, lab)
    assert kept.columns == d.columns
    ids = {x.doc_id for x in kept.collect()}
    assert sum(k % 3 != 0 and k in ids for k in range(900)) > 580 and sum(k % 3 == 0 and k in ids for k in range(900)) < 30
    odd = toxcnn.toxicity(docs, lab).collect()
    assert len(odd) == len(pairs) and all(0 <= x.score <= 1 for x in odd)
    assert toxcnn.toxicity(none, lab).count() == 0
    assert toxcnn.toxicity(d.limit(5), lab.where("false")).where("predicted = 0").count() == 5


# -- 8 ---------------------------------------------------------------------------------------------


def test_url_verdicts(spark):
    link = lambda u: f'<head><link href="{u}" rel=canonical></head>'
    hop = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        (1, "HTTP://Sub.Evil.NET/x?y#z", None),
        (2, "http://a.com/1", link("http://evil.net/q")),
        (3, "http://b.com/2#top", hop("http://a.com/1")),
        (4, "http://example.net/en/5", link("http://evil.net/w")),
        (5, "http://c.com/9", link("http://example.net/en/5")),
        (6, "http://x.example.com/de/1", ""),
        (7, "http://x.example.com/den", "<link rel=canonical href=/fr/2>"),
        (8, "http://notorg/fr/1", ""),
        (9, "http://site.org/fr/", ""),
        (10, None, None),
        (11, "no scheme", ""),
        (12, "http://d.com", ""),
        (6, "http://x.example.com/de/1", ""),
        (13, "https://example.net", hop("//b.com/2")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlalias.url_verdicts(pages).collect()}
    assert got[1] == ("sub.evil.net", "/x", "net/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == ("example.net/en/", "allow")
    assert got[5][2:] == (None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == (None, "allow") and got[9][2:] == ("org/fr/", "allow")
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow") and got[12] == ("d.com", "", None, "allow")
    assert got[13] == ("example.net", "", None, "block")
    assert urlalias.url_verdicts(pages).count() == len(rows) and urlalias.url_verdicts(pages.where("false")).count() == 0


def test_links_resolve(spark):
    """As a browser reads them: against the standard library's resolution."""
    from urllib.parse import urljoin

    page = "http://a.com/x/y/z?k=1"
    links = ["http://b.com/p", "//c.com/q", "/r", "other.html", "../up", "./here/", "../../../far", "?only=q", "a/../b?c=http://evil.net/", "/go?u=http://evil.net/x", "..", "."]
    found = spark.createDataFrame([(x,) for x in links], "l string").select("l", urlalias.resolved(F.lit(page), F.col("l")).alias("u")).collect()
    assert {r.l: r.u for r in found} == {x: urljoin(page, x) for x in links}
    none = spark.createDataFrame([("#top",), ("mailto:a@b.c",), ("javascript:x()",)], "l string").select(urlalias.resolved(F.lit(page), F.col("l")).alias("u")).collect()
    assert [r.u for r in none] == [None] * 3


def test_url_verdicts_over_links(spark):
    """Against union-find in plain Python and the SQL: relative links, several links of a page, longest urls, ties and clashing columns."""
    import duckdb
    from urllib.parse import urldefrag, urljoin

    from quillon.llm import queries

    link = lambda *us: "".join(f"<link rel='canonical' href='{u}'>" for u in us)
    hop = lambda u: f'<META content="3; URL={u}" HTTP-EQUIV="Refresh">'
    spec = [
        (1, "http://a.com/go", ["/go?u=http://evil.net/x"], link), (2, "http://b.com/d/e", ["../f"], link), (3, "http://b.com/f", ["http://bad.net/"], link),
        (4, "http://c.com/1", ["2", "http://d.com/?a=1&amp;b=2"], link), (5, "http://d.com/?a=1&b=2", ["//worse.net/q"], link), (6, "http://c.com/2", [], link),
        (7, "http://h.com/" + "l" * 70_000, ["http://bad.net/"], link), (8, "http://i.com/", ["http://j.org/fr/"], link), (9, "http://k.com/", ["http://i.com/"], link), (10, "http://k.com/x", ["http://bad.net/"], link), (8, "http://i.com/", ["http://j.org/fr/"], link), (11, None, [], link), (12, "nowhere", ["http://bad.net/"], link),
        (13, "http://m.com/a/b", ["../c"], lambda *us: "".join(map(hop, us))), (14, "http://m.com/c", ["http://bad.net/"], lambda *us: "".join(map(hop, us))),
    ]
    rows = [(k, u, make(*to), "n", "h", 1) for k, u, to, make in spec]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node string, host string, component int")
    node = lambda u: urldefrag(u)[0].split("://", 1)[1]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, u, to, _ in spec:
        for t in to:
            if u and "://" in u:
                up[find(node(urljoin(u, t.replace("&amp;", "&"))))] = find(node(u))
    blocked, allowed = {find(x) for x in list(up) if x.split("/")[0].endswith(".net")}, {find(x) for x in list(up) if x.startswith("j.org/fr/")}
    want = {k: "block" if u and "://" in u and find(node(u)) in blocked - allowed else "allow" for k, u, _, _ in spec}
    got = urlalias.url_verdicts(pages)
    assert {r.page_id: r.verdict for r in got.collect()} == want and got.count() == len(rows)
    d = duckdb.connect()
    frame = pages.select("page_id", "url", "html").toPandas()  # noqa: F841
    d.sql("create table pages as select * from frame")
    assert dict((r[0], r[4]) for r in d.sql(queries.SQL["op8_url_filter"]).fetchall()) == want


def test_components(spark):
    r = random.Random(10)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(80)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in {y for e in edges for y in e}}
    assert {x: want[x] for x in got} == got and all(x in got or want[x] == x for x in want)


# -- 9 ---------------------------------------------------------------------------------------------


def brute_components(pairs, size, num, den):
    sets = defaultdict(set)
    each = []
    for d, t in pairs:
        w = text_of(t).lower().split()
        s = {tuple(w[i : i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set()
        each.append((d, s))
    up = {d: d for d, _ in each if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(each):
        for e, t in each[:i]:
            if d is not None and e is not None and s and t and den * len(s & t) >= num * len(s | t):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return Counter((d, len(s), None if d is None else find(d)) for d, s in each), sets


@pytest.mark.parametrize("size, num, limits, frequent", [(3, 90, (1000, 600_000), 255), (5, 80, (1000, 600_000), 255), (3, 80, (4, 2000), 3), (3, 60, (3, 800), 2), (3, 60, (3, 800), 20)])
def test_jaccard(spark, docs, pairs, none, size, num, limits, frequent):
    r = random.Random(size * num)
    more = list(pairs)
    family = prose(r, 60).split()
    for k in range(100, 140):  # a chain: each from the one before
        family[r.randrange(60)] = f"c{k}"
        more.append((k, " ".join(family)))
    for k in range(200, 230):
        w = prose(r, r.randrange(8, 14), 12).split()
        more.append((k, " ".join(w[: r.randrange(3, 14)])))
    found = table(spark, more).repartition(4)
    want, _ = brute_components(more, size, num, 100)
    sets, links = rtree.jaccard_links(found, size, num, 100, limits, frequent)
    comps = {x.node: x.component for x in common.components(links).collect()}
    got = Counter((x.doc_id, x.n, comps.get(x.doc_id, x.doc_id)) for x in sets.collect())
    assert got == want


def test_jaccard_edges(docs, pairs, none):
    want, _ = brute_components(pairs, 3, 90, 100)
    assert Counter(map(tuple, rtree.near_components(docs, 3, 90, 100).collect())) == want
    assert rtree.near_components(none).count() == 0
    kept = rtree.without_near(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for (d, _, c), n in want.items() if d is None or d == c)


def test_cells_meet():
    """Sets at the least admissible similarity share a cell, whatever is frequent, and their points' bound allows the link."""
    r = np.random.default_rng(3)
    for num in (80, 90):
        for n in (1, 2, 3, 5, 9, 10, 11, 19, 25, 40, 90, 97, 300):
            for _ in range(10):
                a = np.unique(r.integers(0, 2**48, n).astype(np.uint64))
                for gone in range(n + 1):
                    b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**48, r.integers(0, 3)).astype(np.uint64)]))
                    if not len(b) or not rtree.linked(a, b, num, 100):
                        continue
                    df = dict(zip(np.union1d(a, b).tolist(), r.integers(2, 9, 400).tolist()))
                    both = np.intersect1d(a, b)  # no others are in several documents
                    cells = [set(rtree._prefix(both, np.array([df[x] for x in both.tolist()]), len(s), num, 100)[0].tolist()) for s in (a, b)]
                    assert cells[0] & cells[1]
                    v = []
                    for s in (a, b):
                        c = rtree.vector(both, 4 * rtree.groups_of(len(s)))
                        v.append((c[::2] | c[1::2] << 4).astype(np.uint8).tobytes())
                    assert len(rtree._fit(v, np.array([len(a), len(b)]), np.array([0]), np.array([1]), num, 100)) == 1


def test_tree_prunes_and_loses_nothing():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**48, 200).astype(np.uint64)) for _ in range(40)]
    sets = [np.sort(np.concatenate([r.permutation(s)[r.integers(0, 12) :], r.integers(0, 2**48, 5).astype(np.uint64)])) for s in base for _ in range(6)]
    sizes = np.array([len(s) for s in sets])
    vectors = np.stack([rtree.vector(s, 64) for s in sets])
    tree, passed = rtree.RTree(vectors, sizes), 0
    for i, s in enumerate(sets):
        found = set(tree.search(vectors[i], sizes[i], 90, 100)[0].tolist())
        passed += len(found)
        assert {j for j, t in enumerate(sets) if rtree.linked(s, t, 90, 100)} <= found
    assert passed < 10 * len(sets)


# -- 10 --------------------------------------------------------------------------------------------


def test_lm_scores(spark, docs, pairs, none):
    got = backoff.scores(docs).collect()
    words = lambda t: text_of(t).lower().split() + [backoff.END]
    c = Counter()
    for d, t in pairs:
        if crc(d) % 10:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in pairs:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(d, crc(d) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(x.score < 0 for x in got)
    assert backoff.scores(none).count() == 0


def brute_lm(texts_):
    """log10 p(word | words before) by plain counts of whole word tuples, orders one to three."""
    c = [Counter(), Counter(), Counter()]
    for w in texts_:
        past = [None, *w]
        c[1][(None,)] += 1
        for i in range(1, len(past)):
            c[0][past[i]] += 1
            c[1][(past[i],)] += 1
            c[2][tuple(past[i - 1 : i + 1])] += 1
            if i > 1:
                c[2][tuple(past[i - 2 : i + 1])] += 1
    n, v = sum(c[0].values()), len(c[0])

    def p(past, w):
        x = (c[0][w] + backoff.ADD) / (n + backoff.ADD * (v + 1))
        for k, weight in ((1, backoff.WORD_K), (2, backoff.PAIR_K)):
            h = tuple(past[-k:])
            of = c[k][h] if k == 1 else c[2][h]
            if len(h) == k and of:
                x = (c[2][(*h, w)] + weight * x) / (of + weight)
        return x

    return p


@pytest.mark.parametrize("unit_tokens", [backoff.UNIT_TOKENS, 300])
def test_lm_scores_of_all_ngrams(docs, pairs, unit_tokens):
    """The scores are those of a model with every n-gram of the training texts, whatever the units."""
    words = lambda t: text_of(t).lower().split() + [backoff.END]
    p = brute_lm([words(t) for d, t in pairs if crc(d) % 10])
    want = Counter()
    for d, t in pairs:
        past = [None, *words(t)]
        want[(d, round(sum(math.log10(p(past[:i], past[i])) for i in range(1, len(past))), 5))] += 1
    got = backoff.scores(docs, unit_tokens=unit_tokens).collect()
    assert Counter((x.doc_id, round(x.score, 5)) for x in got) == want


def test_automaton_is_a_distribution():
    """From every state the weights of all words, one unknown among them, sum to one."""
    r = random.Random(4)
    unit = backoff.Unit()
    for n in (200, 0, 3, 40):
        unit.add(n, [b"abc"[k : k + 1] for k in r.choices(range(3), k=n)])
    unit = backoff.Unit.of(unit.close().data())
    grams, inner = unit.ngrams()
    keys, counts = zip(*(backoff.distinct(g, np.ones(len(g), bool)) for g in grams))
    a = backoff.Automaton(list(keys), list(counts), len(unit.flat), len(unit.hashes), 4)
    every = np.append(unit.hashes, np.uint64(7))  # and an unknown word
    uni = a.count(1, every)
    assert (uni > 0).sum() == 4
    for before in ([], [1], [1, 2], [2, 2], [1, 2, 3], [4], [1, 4], [4, 1], [4, 4]):
        state = a.start(len(every))
        for w in before:
            state, _ = a.step(state, np.full(len(every), every[w]), np.full(len(every), uni[w]))
        assert abs((10 ** a.step(state, every, uni)[1]).sum() - 1) < 1e-9


# -- inputs that are split otherwise from job to job -------------------------------------------------


def test_other_splits_between_jobs(spark, pairs, tmp_path):
    """As when executors join or go: the jobs read the same files in other partitions."""
    found = pairs * 3
    table(spark, found).repartition(16).write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    few = {"spark.sql.files.minPartitionNum": "2", "spark.sql.files.openCostInBytes": "64m"}
    try:
        whole = [recompress.repeated_spans(docs), radix.without_copies(docs), weaklabel.quality(docs)]
        before = docs.rdd.getNumPartitions()
        for k, v in few.items():
            spark.conf.set(k, v)
        assert spark.read.parquet(path).rdd.getNumPartitions() != before
        assert Counter(map(tuple, recompress.digest(whole[0]).collect())) == brute_removed(found)
        norm = lambda t: text_of(t).translate(None, common.SPACES.encode())
        assert Counter(norm(r.text) for r in whole[1].collect()) == Counter({norm(t) for _, t in found})
        assert Counter((r.doc_id, r.votes) for r in whole[2].collect()) == Counter((d, weaklabel.votes(text_of(t))) for d, t in found)
    finally:
        for k in few:
            spark.conf.unset(k)
