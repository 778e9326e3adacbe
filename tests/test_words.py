"""Scalar functions, fuzzy words, synonyms, partial words, excerpts."""

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import distance as D
from quillon.functions import text as T
from quillon.operators import expand, rank
from quillon.operators.algebra import Matches
from quillon.operators.excerpts import excerpt_column, matcher
from quillon.plans.session import Index


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_distances(spark):
    f = lambda a, b, t=3: value(spark, D.edit_distance(F.lit(a), F.lit(b), t))
    assert (f("algorithm", "alogrithm"), f("algorthm", "algorithm"), f("abc", "xyzabcxyz")) == (2, 1, -1)
    p = lambda a, b, t=2: value(spark, D.prefix_distance(a, F.lit(b), t))
    assert (p("alg", "algorithm"), p("also", "algorithm"), p("lgo", "algorithm"), p("zzzz", "algorithm")) == (0, 1, 1, 3)
    assert [D.threshold(n) for n in (3, 4, 5, 6, 10, 11)] == [0, 1, 1, 2, 2, 3]
    assert D.ruled_distance("fone", "phone", [("f", "ph", 0.25)], 2) == 0.25


def test_fuzzy_forms(spark):
    # forms that have to be these (fixed values)
    want = {"chshysh": "csis", "marjan": "marjan", "qwertrewq": "qwertrewq", "123456789": "123456789", "ckaaashhsue": "kaashsu", "": "", "ueoeaessss": "uoass", "philosophy": "filosofi", "tttt": "tt", "letter": "leter", "schule": "shule"}
    assert {w: D.fuzzy_form(w) for w in want} == want
    found = spark.createDataFrame([(w,) for w in want], "w string").select("w", D.fuzzy_form_col(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in found} == want


def test_similar_words(spark):
    words = "algorithm algorthm algorithms alogrithm logarithm database query".split()
    v = spark.createDataFrame([(w, 1, 1) for w in words], "word string, doc_freq long, occ_freq long")
    found = {r.word: r.distance for r in expand.similar_words(v, "algorithm").collect()}
    assert found == {"algorithm": 0, "algorthm": 1, "algorithms": 1, "alogrithm": 2}
    assert expand.similar_words(v, "unknown").count() == 0
    pairs = {(r.word, r.other) for r in expand.similar_pairs(v, 1, prefix=20).collect()}
    assert pairs == {("algorithm", "algorthm"), ("algorithm", "algorithms")}


def test_synonyms(spark):
    lines = spark.createDataFrame([(1, "VW Volkswagen *Beatle *Kaefer Passat"), (2, ""), (3, "Kaefer Marienkaefer")], "line_no int, value string")
    g = expand.synonym_groups(lines)
    assert {(r.group_id, r.starred) for r in g.where("word = 'Kaefer'").collect()} == {(2, True), (6, False)}
    assert {r.word for r in expand.synonyms_of(g, "VW").collect()} == {"VW", "Volkswagen", "Beatle", "Kaefer", "Passat"}
    assert {r.word for r in expand.synonyms_of(g, "Kaefer").collect()} == {"Kaefer", "Marienkaefer"}


def test_partial_words(spark):
    v = spark.createDataFrame([("bahnhof",), ("hauptbahnhof",), ("hauptbahnhofs",), ("bahnhofs",)], "word string")
    found = {(r.inner, r.outer) for r in expand.partial_words(v, 6).collect()}
    assert found == {("bahnhof", "hauptbahnhof"), ("bahnhofs", "hauptbahnhofs")}


def test_partial_words_of_any_length(spark):
    """The registered query against brute force, words beyond the bound of the SQL's vocabulary included."""
    sf = "/root/testdata/sf0.001"
    v = {r.word for r in queries.postings(spark, sf).select("word").distinct().collect()}
    want = set()
    for outer in v:
        for at in range(1, len(outer) - 5):
            inner = next((outer[at:end] for end in range(len(outer), at + 5, -1) if outer[at:end] in v), None)
            if inner:
                want.add((inner, outer))
    assert any(len(outer) > 12 for _, outer in want)
    assert {(r.inner, r.outer) for r in queries.QUERIES["partial_words"](spark, sf).collect()} == want


def test_suggestions(spark):
    p = spark.createDataFrame([(1, "idiot", 1, 1), (1, "clown", 2, 1), (2, "idiot", 1, 1), (2, "clown", 9, 1)], "doc_id long, word string, position int, score long")
    like = lambda w: spark.createDataFrame([(w, 0)], "word string, distance int")
    assert [tuple(r) for r in expand.suggestions(p, [like("idiot"), like("clown")], [False]).collect()] == [("idiot clown", 2)]
    assert [tuple(r) for r in expand.suggestions(p, [like("idiot"), like("clown")], [True]).collect()] == [("idiot clown", 1)]


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(T.convert_date(lit("7.1.2010"))) == "07-01-2010" and v(T.convert_date(lit("2010-1-22"))) == "22-01-2010" and v(T.convert_date(lit("31-31-2010"))) == ""
    assert v(T.date_token(lit("22-01-2010"))) == "20100122"
    assert v(T.number_token(lit("1.12345678"), 2, 8)) == "0112345678" and v(T.number_token(lit("12345678.9"), 8, 2)) == "1234567890"
    assert v(T.number_token(lit("1.234,5"), 2, 4)) == "012345" and v(T.number_token(lit("3,25"), 2, 2)) == "0325" and v(T.number_token(lit("17"), 4, 1)) == "00170"
    with pytest.raises(Exception, match="more than 4 digits"):
        v(T.number_token(lit("12345.67"), 4, 2))
    assert v(T.tokens(lit("c+ c++"), ["c++"])) == ["c", "c++"]
    assert v(T.tokens(lit("yahoo? +yahoo!."), ["yahoo!"])) == ["yahoo", "yahoo!"]
    assert v(T.normalise(lit("Müller Café"))) == "mueller cafe"
    assert v(T.escape_xml(lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert v(T.unmask(T.mask(lit("a.b c"), ". "))) == "a.b c"
    assert len(T.ACCENTED) == len(T.PLAIN)


def test_excerpts(spark):
    text = "One two three four five six seven eight nine ten eleven twelve"
    cut = lambda words, prefixes, r, n=5: value(spark, excerpt_column(F.lit(text), matcher(words, prefixes), r, n))
    assert cut(["three"], [], 1) == ["...two <hl>three</hl> four..."]
    assert cut(["one", "three"], [], 1) == ["<hl>One</hl> two <hl>three</hl> four..."]
    assert cut([], ["elev"], 1) == ["...ten <hl>eleven</hl> twelve"]
    assert len(cut(["one", "six", "twelve"], [], 1, 2)) == 2


def test_words_of_parts(spark):
    def found(words, prefixes, word):
        return value(spark, matcher(words, prefixes)(F.lit(word)))

    assert all(found([w], [], "^flug^hafen") for w in ("flughafen", "hafen")) and found(["flug"], [], "flug")
    assert not any(found([w], [], "^flug^hafen") for w in ("flug", "flughafe", "hafe", "ughafen"))
    assert all(found([], [p], "^flug^hafen") for p in ("fl", "flug", "flughaf", "haf"))
    assert not any(found([], [p], "^flug^hafen") for p in ("ug", "afen", "flughaxe"))
    assert found(["flug"], [], "^flug^^hafen") and not found(["flughafen"], ["flugh"], "^flug^^hafen")


def test_similar_pairs_of_any_length(spark):
    """Deletion forms of beginnings, by the default, against all pairs: errors before, at and beyond their end."""
    words = [w[:n] + x + w[n + cut :] for w in ("abcdefghij", "zyxw", "q") for n in range(len(w)) for x in ("", "m") for cut in (0, 1)]
    v = sorted(set(words) - {""})
    df = spark.createDataFrame([(w,) for w in v], "word string")
    all_pairs = df.crossJoin(df.withColumnRenamed("word", "other")).where("word < other").where(F.levenshtein("word", "other") <= 1)
    assert {(r.word, r.other) for r in expand.similar_pairs(df).collect()} == {(r.word, r.other) for r in all_pairs.collect()}


def test_ranking_modes(spark):
    p = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 2, 1), (2, "b", 1, 9), (3, "norm:x:a", 1, 2)], "doc_id long, word string, position int, score long")
    m = Matches(p)
    assert {(r.word, r.score, r.doc_count) for r in rank.completions(m).collect()} == {("a", 7, 2), ("b", 10, 2)}
    assert {(r.doc_id, r.score) for r in rank.hits_by_completion(m, k=1).collect()} == {(1, 11), (2, 10), (3, 1)}
    like = spark.createDataFrame([("b", 50)], "word string, likeness int")
    assert {(r.doc_id, r.score) for r in rank.hits_by_likeness(m, like).collect()} == {(1, 1), (2, 4), (3, 1)}
    assert rank.capped_blocks(p, 1, 1).count() == 3


def test_ruled_words(spark):
    """Against the plain table of each word; the comparison stays above the grouping of words, so that a word is asked for once."""
    rules = [("t", "th", 0.2), ("s", "ss", 0.2), ("ou", "u", 0.5), ("e", "", 0.25), ("", "x", 0.1)]
    words = ["wortles", "worthless", "worthles", "wort", "", "w", "wurtles", "worthlessnessless", "\U0001d400ortles", "weirdest", "wortls", "vrtles", "thththth"]
    for cutoff in (0.0, 1.5, 3.0):
        for query in ("wortles", "woutless", "t", ""):
            want = [D.ruled_distance(query, w, rules, cutoff) for w in words]
            assert D.ruled_distances(query, words, rules, cutoff).tolist() == want
            if cutoff == 3.0 and query:
                v = spark.createDataFrame([(w,) for w in words + words[:4]], "word string")
                found = sorted((r.word, r.distance) for r in expand.ruled_words(v, query, rules, cutoff).collect())
                assert found == sorted((w, x) for w, x in zip(words, want) if x <= cutoff)
    some = spark.createDataFrame([(w,) for w in [*words, None]], "word string").select("word", D.ruled_distance_col("wortles", rules, 3.0)("word").alias("d")).collect()
    assert {r.word: r.d for r in some} == {None: None, **{w: D.ruled_distance("wortles", w, rules, 3.0) for w in words}}
    plan = queries.QUERIES["ruled_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("levenshtein") < plan.index("Aggregate")


def test_similar_pairs_of_a_common_beginning(spark):
    """Candidates of many words that begin alike are no more than the pairs of words with a deletion form in common."""
    words = [f"abcdefghij{k:04d}" for k in range(1000)]
    v = spark.createDataFrame([(w,) for w in words], "word string")
    forms = expand.deletions(v, 1, None)
    assert forms.groupBy("form").count().agg(F.max("count")).first()[0] <= 40  # ten digits at four places
    pairs = expand.similar_pairs(v)
    assert pairs.count() == sum(sum(x != y for x, y in zip(a, b)) == 1 for a in words for b in words if a < b)
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in expand.similar_pairs(v, 1, 7).collect()}


def test_special_words(spark):
    """An index with special words answers as one that has them in its postings; looked up, no posting is shuffled."""
    rows = [(1, "hauptbahnhof", 1, 2), (1, "bahnhof", 2, 1), (2, "hauptbahnhof", 4, 3), (2, "am", 5, 1), (3, "bahnhofshalle", 1, 1)]
    p = spark.createDataFrame(rows, "doc_id long, word string, position int, score long")
    partial = spark.createDataFrame([("bahnhof", "hauptbahnhof"), ("shalle", "bahnhofshalle")], "inner string, outer string")
    want = {(1, "bahnhof:hauptbahnhof", 1, 2), (2, "bahnhof:hauptbahnhof", 4, 3), (3, "shalle:bahnhofshalle", 1, 1)}
    specials = expand.partial_specials(partial)
    for most in (2, 1):
        found = expand.special_postings(p, specials, most)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert most == 1 or "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    whole = expand.with_partial_words(p, partial)
    assert sorted(map(tuple, whole.collect())) == sorted([*rows, *want])
    one, two = Index(spark, p, specials=specials), Index(spark, whole)
    for q in ("bahnhof:*", "bahnhof*", "bahnhof:hauptbahnhof", "am bahnhof:*", "bahnhof--bahnhofs", "bahnhof--bahnhof:*", "am--shalle", "s--zz", "am", "none*"):
        assert sorted(map(tuple, rank.scored_docs(one.query(q)).collect())) == sorted(map(tuple, rank.scored_docs(two.query(q)).collect())), q
        assert sorted(map(repr, one.query(q).with_carry().collect())) == sorted(map(repr, two.query(q).with_carry().collect())), q
