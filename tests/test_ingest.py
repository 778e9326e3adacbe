"""Ingestion on the rows of FIXTURES.md, section 4, and the sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import expand
from quillon.plans.query import Parameters
from quillon.plans.session import Index
from quillon.sources import ingest, records, sinks


def words(spark, row, **options):
    df = spark.createDataFrame([(1, *row.values())], ["doc_id", *row])
    return [(r.word, r.position, r.score) for r in ingest.postings(df, ingest.Options(sign="!", **options)).orderBy("position", "word").collect()]


def test_full_text(spark):
    got = words(spark, {"f": "amicus5 certus in re incerta cernitur"}, full_text=["f"])
    assert got == [(w, k, 1) for k, w in enumerate("amicus5 certus in re incerta cernitur".split(), 1)]


def test_scores_and_positions(spark):
    got = words(spark, {"f1": "festina lente", "f2": "animam debet"}, full_text=["f1", "f2"], scores={"f1": 10, "f2": 5})
    assert got == [("festina", 1, 10), ("lente", 2, 10), ("animam", 3, 5), ("debet", 4, 5)]


@pytest.mark.parametrize(
    "options, row, want",
    [
        ({"phrases": ["f"]}, "omnia vincit amor", ["omnia!omnia_vincit_amor", "vincit!omnia_vincit_amor", "amor!omnia_vincit_amor"]),
        ({"facets": ["f"]}, "x box", ["!facet!f!x_box"]),
        ({"facet_ids": ["f"]}, "x box", ["!facetid!f!x_box"]),
        ({"filters": ["f"]}, "cras legam", ["!filter!f!cras", "!filter!f!legam"]),
        ({"filters_plus": ["f"]}, "cras legam", ["!filter!f!cras!cras_legam", "!filter!f!legam!cras_legam"]),
        ({"orderings": {"f": "f:2.8"}}, "1.12345678", ["!ordering!f!0112345678"]),
        ({"orderings": {"f": "date"}}, "22-01-2010", ["!ordering!f!20100122"]),
        ({"orderings": {"f": "literal"}}, "A305", ["!ordering!f!A305"]),
        ({"full_text": ["f"], "index_words": ["med."]}, "c med.", ["c", "med."]),
        ({"facets": ["f"], "multiple": ["f"]}, "item1#item2#*item3", ["!facet!f!item1", "!facet!f!item2", "!facet!f!item3"]),
    ],
)
def test_roles(spark, options, row, want):
    assert [w for w, _, _ in words(spark, {"f": row}, **options)] == want


def test_normalised_words_share_positions(spark):
    assert words(spark, {"f": "Müller à"}, full_text=["f"], normalise=True) == [("müller", 1, 1), ("norm!mueller!müller", 1, 1), ("norm!a!à", 2, 1), ("à", 2, 1)]


def test_store(spark, tmp_path):
    """A page of documents comes back whole, by a filter that reaches the reader; long lists are refused."""
    at = str(tmp_path / "store")
    sinks.write_store(spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string"), at)
    got = sinks.stored_documents(spark, at, [3, 40, 99])
    assert sorted((r.doc_id, len(r.text)) for r in got.collect()) == [(3, 3), (40, 40)]
    assert "In(doc_id, [3,40,99])" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="more than 2"):
        sinks.stored_documents(spark, at, [1, 2, 3], most=2)


def test_shown_items(spark):
    df = spark.createDataFrame([(1, "item1#item2#*item3#item4")], "doc_id long, f string")
    d = ingest.documents(df, ingest.Options(show=["f"], multiple=["f"])).first()
    assert json.loads(d.info) == {"f": ["item1", "item2", "item4"]}


def test_delimited_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("title\tyear\nfirst\t1990\nbroken\nthird\t1992\n")
    got = records.read_delimited(spark, str(tmp_path / "a.tsv")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "first", "1990"), (3, "third", "1992")]


def test_items(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(records.split_items(F.lit("a#b#"), "#").alias("x"), records.split_items(F.lit("#a#b"), "#").alias("y")).first()
    assert (got.x, got.y) == (["a", "b", ""], ["#a", "b"])


def test_words_and_docs_files(spark, tmp_path):
    (tmp_path / "w").write_text("#head\naal\t1\t300\t2\naal\t1\t5\t4\nbad line\nbaum\t2\t-4\t1\n")
    got = records.read_words(spark, str(tmp_path / "w")).orderBy("word", "position").collect()
    assert [tuple(r) for r in got] == [(1, "aal", 2, 255), (1, "aal", 4, 5), (2, "baum", 1, 0)]
    assert records.read_words(spark, str(tmp_path / "w"), dedup=True).count() == 2
    import struct

    (tmp_path / "b").write_bytes(struct.pack("<8I", 7, 1, 3, 2, 9, 70000, 4, 1))
    assert {tuple(r) for r in records.read_words(spark, str(tmp_path / "b"), "binary").collect()} == {(1, "7", 2, 3), (70000, "9", 1, 4)}
    (tmp_path / "d").write_text("5\tu:http://x\tt:Title\tH:Some text\n")
    assert tuple(records.read_docs(spark, str(tmp_path / "d")).first()) == (5, "http://x", "Title", "Some text")


def test_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><article id='1'><title>A</title></article><article id='2'><title>B</title></article></r>")
    got = records.read_xml(spark, str(tmp_path / "x.xml"), "article").orderBy("title").collect()
    assert [(r["_id"], r.title) for r in got] == [(1, "A"), (2, "B")]


def test_headed_text(spark):
    df = spark.createDataFrame([(1, 1, "1 Intro\nsome text\ngoes on\n\n1.1 More\nlast")], "doc_id long, page int, text string")
    got = [(r.kind, r.heading, r.text) for r in records.headed_text(df).orderBy("place").collect()]
    assert got == [("H0", "1 Intro", "1 Intro"), ("P", "1 Intro", "some text goes on"), ("H1", "1.1 More", "1.1 More"), ("P", "1.1 More", "last")]


def test_index_round_trip_and_response(spark, tmp_path):
    df = spark.createDataFrame([(1, "red car"), (2, "red boat"), (3, "blue car")], "doc_id long, title string")
    o = ingest.Options(full_text=["title"], facets=["title"], show=["title"], title="title", excerpts=["title"])
    sinks.write_index(ingest.postings(df, o), str(tmp_path / "index"))
    sinks.write_words(ingest.postings(df, o), str(tmp_path / "words"))
    assert records.read_words(spark, str(tmp_path / "words")).count() == 9
    i = Index(spark, sinks.read_index(spark, str(tmp_path / "index")), ingest.documents(df, o))
    assert "PushedFilters: [IsNotNull(word), StringStartsWith(word,re)]" in i.query("re*").postings._jdf.queryExecution().executedPlan().toString()
    a = i.answer(Parameters(query="red c*|b*"))
    assert [h["doc_id"] for h in a["hits"]] == [1, 2] and a["n_hits"] == 2
    assert "<hl>red</hl>" in a["hits"][0]["excerpts"][0]
    assert json.loads(sinks.response(a, "json"))["result"]["n_hits"] == 2
    assert sinks.response(a, "jsonp", "f").startswith("f(") and sinks.response(a).startswith("<?xml")
    assert i.answer(Parameters(query=""))["n_hits"] == 3


def test_stream(spark, tmp_path):
    from quillon.streaming.ingest import append_postings

    df = spark.createDataFrame([(1, "red car"), (2, "red boat")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_postings(s, ingest.Options(full_text=["text"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_query_list_is_never_cut(spark, tmp_path):
    path = tmp_path / "queries"
    path.write_text("# comment\n" + "".join(f"q{k}\n" for k in range(10_000)))
    assert len(records.read_query_list(spark, str(path))) == 10_000
    path.write_text(path.read_text() + "one more\n")
    with pytest.raises(ValueError):
        records.read_query_list(spark, str(path))


def test_index_ranges_follow_the_table(spark, tmp_path, monkeypatch):
    """Ranges are more for a larger table, whatever the session's number of shuffle partitions; the blocks stay out of the shuffle and the sort."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = ingest.text_postings(docs)
    monkeypatch.setattr(sinks, "RANGE_BYTES", 10_000)
    assert sinks.ranges(p) > spark.sparkContext.defaultParallelism and sinks.ranges(p) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sinks.ranges(spark.createDataFrame([(1, "a")], "doc_id long, word string")) is None
    sinks.write_index(p, f"{tmp_path}/i")
    got = spark.read.parquet(f"{tmp_path}/i")
    assert len(got.inputFiles()) > 8 and got.columns == ["doc_id", "word", "position", "score", "block"]
    assert got.drop("block").exceptAll(p).isEmpty() and p.exceptAll(got.drop("block")).isEmpty()
    assert got.where("block <> substring(word, 1, 2)").isEmpty()
    parts = sorted(tuple(r) for r in got.groupBy(F.input_file_name()).agg(F.min(F.struct("word", "doc_id")).alias("a"), F.max(F.struct("word", "doc_id")).alias("b")).select("a", "b").collect())
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_normal_forms_need_no_shuffle(spark):
    """Normal forms stand at the place of their words, whether made with the postings or from an index of them; long words have one without the other."""
    long = "ä" * 300
    df = spark.createDataFrame([(1, f"Die Straße {long} über", "Grün"), (2, None, ""), (3, "x", "Öl am Öl")], "doc_id long, f string, g string")
    o = ingest.Options(full_text=["f", "g"], filters=["g"], normalise=True)
    p = ingest.postings(df, o)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.word, r.position) for r in p.collect()}
    assert {(1, "straße", 2), (1, "norm:strasse:straße", 2), (1, long, 3), (1, "über", 4), (1, "norm:ueber:über", 4), (1, "norm:gruen:grün", 5), (1, ":filter:g:grün", 6)} <= got
    assert not any(w.startswith("norm:ae") for _, w, _ in got) and {at for d, _, at in got if d == 3} == set(range(1, 8))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = ingest.postings(docs, ingest.Options(full_text=["text"], normalise=True))
    plain = ingest.text_postings(docs)
    both = sinks.writable(plain).unionByName(expand.special_postings(plain, ingest.normal_words(plain)))
    assert both.exceptAll(whole).isEmpty() and whole.exceptAll(both).isEmpty()
    plan = ingest.normal_words(plain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("translate(") < plan.index("Aggregate") and plan.rindex("translate(") < plan.index("Aggregate")
