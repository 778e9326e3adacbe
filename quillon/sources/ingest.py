"""From records to postings, documents and vocabulary.

Every field plays roles; the words of a document are numbered across its fields in the order of the
fields and, within an item, of the writers below, so that positions tell neighbours and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import searchable, shown, split_items
from .sinks import writable


@dataclass
class Options:
    """Which fields play which role; names as in the records."""

    full_text: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    filters_plus: list[str] = field(default_factory=list)
    facets: list[str] = field(default_factory=list)
    facet_ids: list[str] = field(default_factory=list)
    orderings: dict[str, str] = field(default_factory=dict)
    show: list[str] = field(default_factory=list)
    excerpts: list[str] = field(default_factory=list)
    title: str | None = None
    url: str | None = None
    multiple: list[str] = field(default_factory=list)
    scores: dict[str, int] = field(default_factory=dict)
    item_separator: str = "#"
    no_show: str = "*"
    sign: str = ":"
    index_words: list[str] = field(default_factory=list)
    normalise: bool = False
    excerpt_separator: str = ". "


def _items(o: Options, name: str) -> Column:
    c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return searchable(split_items(c, o.item_separator), o.no_show) if name in o.multiple else F.array(c)


def _writers(o: Options, name: str, item: Column) -> Column:
    """Arrays of (word, normal) of one item, each at a position of its own; a normal word's normal form shares it."""
    s, words = o.sign, T.tokens(item, o.index_words)
    entry = lambda w, normal=False: F.struct(w.alias("word"), F.lit(normal).alias("normal"))
    whole = T.underscored(F.lower(item))
    out = []
    if name in o.full_text:
        out.append(F.transform(words, lambda w: entry(w, o.normalise)))
    if name in o.phrases:
        out.append(F.when(item.contains(" "), F.transform(words, lambda w: entry(F.concat(w, F.lit(s), whole)))).otherwise(F.array().cast("array<struct<word:string,normal:boolean>>")))
    if name in o.filters:
        out.append(F.transform(words, lambda w: entry(F.concat(F.lit(f"{s}filter{s}{name}{s}"), w))))
    if name in o.filters_plus:
        out.append(F.transform(words, lambda w: entry(F.concat(F.lit(f"{s}filter{s}{name}{s}"), w, F.lit(s), T.underscored(item)))))
    filled = lambda words: F.when(item != "", words).otherwise(F.array().cast("array<struct<word:string,normal:boolean>>"))  # noqa: E731  an empty field writes nothing
    for kind, fields in (("facet", o.facets), ("facetid", o.facet_ids)):
        if name in fields:
            out.append(filled(F.array(entry(F.concat(F.lit(f"{s}{kind}{s}{name}{s}"), T.underscored(item))))))
    if name in o.orderings:
        out.append(filled(F.array(entry(F.concat(F.lit(f"{s}ordering{s}{name}{s}"), T.ordering_token(item, o.orderings[name]))))))
    return F.concat(*out) if out else F.array().cast("array<struct<word:string,normal:boolean>>")


def _field(o: Options, name: str) -> Column:
    """All a field writes for a document, in order."""
    written = F.flatten(F.transform(_items(o, name), lambda item: _writers(o, name, item)))
    score = F.lit(o.scores.get(name, 1)).cast("long").alias("score")
    return F.transform(written, lambda x: F.struct(x["word"].alias("word"), x["normal"].alias("normal"), score))


def _roles(o: Options) -> list[str]:
    names = [*o.full_text, *o.phrases, *o.filters, *o.filters_plus, *o.facets, *o.facet_ids, *o.orderings]
    return list(dict.fromkeys(names))


def postings(records: DataFrame, o: Options) -> DataFrame:
    """(doc_id, word, position, score); words longer than 1000 bytes, empty or with a space are left out but keep their position."""
    names = [n for n in records.columns if n in _roles(o)]
    fields = [_field(o, n) for n in names]
    every = F.concat(*fields) if fields else F.array().cast("array<struct<word:string,normal:boolean,score:bigint>>")
    one = records.select(F.col("doc_id").cast("long").alias("doc_id"), every.alias("w")).select("doc_id", F.posexplode("w").alias("k", "x"))
    out = one.select("doc_id", "x.word", (F.col("k") + 1).alias("position"), "x.score", "x.normal")
    if o.normalise:
        both = F.explode(F.array("word", F.when(F.col("normal"), normal_word(F.col("word"), o.sign)))).alias("word")
        out = out.select("doc_id", both, "position", "score")
    return writable(out.select("doc_id", "word", "position", "score"))


def normal_word(word: Column, sign: str = ":") -> Column:
    """The special word by which a word's normal form finds it."""
    return F.concat(F.lit(f"norm{sign}"), T.normalise(word), F.lit(sign), word)


def normal_words(vocab: DataFrame, sign: str = ":") -> DataFrame:
    """(word, plain): for each word the special word of its normal form, as ``normalise`` adds it wherever the word stands.

    Words may repeat. Forms name the count of their word, so that the optimiser can't push the condition on them below the grouping.
    """
    known = vocab.groupBy("word").agg(F.count("*").alias("n"))
    return writable(known.select(F.when(F.col("n") > 0, normal_word(F.col("word"), sign)).alias("word"), F.col("word").alias("plain")))


def info_words(o: Options, encoding: str = "utf-8", date: str = "") -> list[str]:
    """Words under document 0 that tell a front end how the index was built."""
    s = o.sign
    return [f"{s}info{s}encoding{s}{encoding}", *([f"{s}info{s}date{s}{date}"] if date else []), *[f"{s}info{s}facet{s}{n}" for n in o.facets], *[f"{s}info{s}ordering{s}{n}" for n in o.orderings]]


def with_info(p: DataFrame, words: list[str]) -> DataFrame:
    rows = p.sparkSession.createDataFrame([(0, w, 0, 0) for w in words], "doc_id long, word string, position int, score long")
    return p.unionByName(rows)


def documents(records: DataFrame, o: Options) -> DataFrame:
    """(doc_id, url, title, info, text): shown fields as JSON without no-show items, excerpt fields as text."""
    col = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))
    field_of = lambda n: shown(split_items(col(n), o.item_separator), o.no_show) if n in o.multiple else col(n)
    text = F.array_join(F.flatten(F.array(*[F.filter(_items(o, n), lambda x: x != "") for n in o.excerpts])), o.excerpt_separator) if o.excerpts else F.lit("")
    return records.select(F.col("doc_id").cast("long").alias("doc_id"), (col(o.url) if o.url else F.lit("")).alias("url"), (col(o.title) if o.title else F.lit("")).alias("title"), (T.info_json({n: field_of(n) for n in o.show}) if o.show else F.lit("{}")).alias("info"), text.alias("text"))


def facet_table(p: DataFrame, sign: str = ":") -> DataFrame:
    """(doc_id, facet, value) of the facet words among postings."""
    q = "\\" + sign
    rx = rf"^{q}facet{q}([^{q}]*){q}(.*)$"
    return p.where(F.col("word").startswith(f"{sign}facet{sign}")).select("doc_id", F.regexp_extract("word", rx, 1).alias("facet"), F.regexp_extract("word", rx, 2).alias("value"))


def text_postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Postings of one text column, score 1: the plain case without roles."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(T.tokens(F.col(text_col))).alias("position", "word")).select("doc_id", "word", (F.col("position") + 1).alias("position"), F.lit(1).cast("long").alias("score"))
