"""XML to JSON by its rules, and running lists of queries."""

import json

import pytest

from quillon.functions.xmljson import xml_to_json, xml_to_json_col
from quillon.plans import batch
from quillon.plans.session import Index


def turned(xml, *lists):
    return json.loads(xml_to_json(xml, lists))


def test_elements_nest_and_keep_their_order():
    got = turned("<book><title>Ferns</title><year>1911</year><place><city>Jena</city></place></book>")
    assert got == {"book": {"title": "Ferns", "year": "1911", "place": {"city": "Jena"}}}
    assert list(got["book"]) == ["title", "year", "place"]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_repeats_become_a_list(n):
    names = [f"name {k}" for k in range(n)]
    assert turned("<o>" + "".join(f"<who>{x}</who>" for x in names) + "</o>") == {"o": {"who": names}}


def test_attributes_stand_beside_text_and_children():
    assert turned('<river length="865" unit="km">Elbe</river>') == {"river": {"@length": "865", "@unit": "km", "text": "Elbe"}}
    assert turned('<river length="865"><mouth>Cuxhaven</mouth></river>') == {"river": {"@length": "865", "mouth": "Cuxhaven"}}
    assert turned('<river length="865"/>') == {"river": {"@length": "865"}}


def test_nothing_inside_is_the_empty_string():
    assert turned("<lake/>") == turned("<lake></lake>") == {"lake": ""}


def test_cdata_is_taken_as_it_stands():
    assert turned("<code><![CDATA[if (x < 3 && y > 4) { z(); }]]></code>") == {"code": "if (x < 3 && y > 4) { z(); }"}
    assert turned('<code lang="c"><![CDATA[]]></code>') == {"code": {"@lang": "c", "text": ""}}


def test_escaped_quotes_and_backslashes_are_not_escaped_again():
    assert turned(r"<path>C:\\tmp\\\"new\"</path>") == {"path": 'C:\\tmp\\"new"'}
    assert turned('<path>say "aye"</path>') == {"path": 'say "aye"'}


def test_forced_lists():
    assert turned("<team><player>Ada</player></team>", "player") == {"team": {"player": ["Ada"]}}
    assert turned("<team><player></player></team>", "player") == {"team": {"player": []}}
    assert turned('<player no="7">Ada</player>', "player") == {"player": [{"@no": "7", "text": "Ada"}]}


def test_column(spark):
    df = spark.createDataFrame([("<n>41</n>",), (None,)], "x string")
    assert [r.j for r in df.select(xml_to_json_col(df.x).alias("j")).collect()] == ['{"n":"41"}', None]


def test_batch(spark):
    rows = [(1, "red", 1, 1), (1, "rest", 2, 1), (2, "red", 1, 1), (2, "blue", 2, 1)]
    i = Index(spark, spark.createDataFrame(rows, "doc_id long, word string, position int, score long"))
    runs = batch.answer_queries(i, ["re*", "red blue", "*"])
    assert [(r.n_hits, bool(r.error)) for r in runs] == [(2, False), (1, False), (0, True)]
    assert batch.statistics(runs)["errors"] == 1
    p = spark.createDataFrame([("re",), ("r",), ("x",)], "prefix string")
    assert {tuple(r) for r in batch.prefix_volumes(i, p).collect()} == {("re", 3), ("r", 3), ("x", 0)}
    assert batch.queries_by_volume(i, p, 1, 3).count() == 2
