"""Record sources: delimited text, XML, words files, docs files, text trees, small dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """(line_no, value) of one text file from 0 in file order; a file read as one split keeps its lines in order.

    Input of many files should bring its own id column instead: numbering orders all lines of the file.
    """
    lines = spark.read.option("encoding", charset).text(path)
    if charset != "UTF-8":
        lines = spark.read.format("binaryFile").load(path).select(F.explode(F.split(F.decode("content", charset), "\n")).alias("value"))
    at = lines.select("value", F.monotonically_increasing_id().alias("at"))
    sizes = {r.p: r.n for r in at.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each split
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return at.select(F.col("at").alias("line_no"), "value")
    base = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
    return at.select((F.col("at").bitwiseAND((1 << 33) - 1) + base[F.shiftright("at", 33)]).alias("line_no"), "value")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", charset: str = "UTF-8") -> DataFrame:
    """A row for each line after the header with as many fields as it: doc_id (line number from 1) and the header's columns.

    Fields are split raw, without quoting. Lines with another number of fields are left out but use up their number.
    """
    lines = numbered_lines(spark, path, charset)
    head = lines.where("line_no = 0").select("value").first()
    names = head[0].rstrip("\r").split(sep) if head else []
    split = F.split(F.regexp_replace("value", "\r$", ""), re.escape(sep), -1)
    rows = lines.where("line_no > 0").select(F.col("line_no").alias("doc_id"), split.alias("f")).where(F.size("f") == len(names))
    return rows.select("doc_id", *[F.col("f")[k].alias(n) for k, n in enumerate(names)])


def split_items(field: Column, sep: str) -> Column:
    """The items of a multi-valued field; a separator that begins the field stays in its first item."""
    rest = F.split(F.substring(field, len(sep) + 1, 1 << 30), re.escape(sep), -1)
    return F.when(field.startswith(sep), F.transform(rest, lambda x, i: F.when(i == 0, F.concat(F.lit(sep), x)).otherwise(x))).otherwise(F.split(field, re.escape(sep), -1))


def shown(items: Column, no_show: str) -> Column:
    """Items without those that begin with the no-show prefix."""
    return F.filter(items, lambda x: ~x.startswith(no_show))


def searchable(items: Column, no_show: str) -> Column:
    """All items, the no-show prefix taken off."""
    return F.transform(items, lambda x: F.when(x.startswith(no_show), F.substring(x, len(no_show) + 1, 1 << 30)).otherwise(x))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """A row for each ``row_tag`` element; attributes as ``_name``. External entities are not expanded."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_words(spark: SparkSession, path: str, form: str = "htdig", dedup: bool = False, most_bytes: int = 1000) -> DataFrame:
    """Postings of a words file. htdig: word, doc, score, position; short: word, doc, position; binary: four
    little-endian unsigned numbers word id, doc, score, position.

    A first line with # and lines that do not parse or are too long are left out; scores stay within 0 to 255;
    dedup keeps the first of several postings of a word in a document.
    """
    if form == "binary":
        raw = spark.read.format("binaryFile").load(path).select("content")
        at = F.explode(F.sequence(F.lit(0), F.length("content").cast("int") - 16, F.lit(16)))
        cut = raw.where(F.length("content") >= 16).select("content", at.alias("at"))
        byte = lambda k, b: F.conv(F.hex(F.substring(F.col("content"), F.col("at") + 4 * k + b + 1, F.lit(1))), 16, 10).cast("long")
        number = lambda k: byte(k, 0) + byte(k, 1) * 256 + byte(k, 2) * 65536 + byte(k, 3) * 16777216
        out = cut.select(number(1).alias("doc_id"), number(0).cast("string").alias("word"), number(3).cast("int").alias("position"), number(2).alias("score"))
    else:
        f = F.split("value", "\t", -1)
        n = 4 if form == "htdig" else 3
        lines = spark.read.text(path).where((F.octet_length("value") <= most_bytes) & (F.size(f) == n))  # a comment has other fields; words may begin with #
        try_long = lambda c: c.try_cast("long")
        out = lines.select(try_long(f[1]).alias("doc_id"), f[0].alias("word"), try_long(f[n - 1]).cast("int").alias("position"), (try_long(f[2]) if form == "htdig" else F.lit(1).cast("long")).alias("score"))
        out = out.where("word <> '' and doc_id is not null and position is not null and score is not null")
    out = out.withColumn("score", F.least(F.lit(255), F.greatest(F.lit(0), "score")))
    if dedup:
        out = out.groupBy("word", "doc_id").agg(F.min(F.struct("position", "score")).alias("x")).select("doc_id", "word", "x.position", "x.score")
    return out


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, title, text) of a docs file: id, u:, t: and H: fields separated by tabs."""
    line = F.col("value")
    part = lambda p: F.regexp_extract(line, p, 1)
    out = spark.read.text(path).select(part(r"^(\d+)\t").try_cast("long").alias("doc_id"), part(r"\tu:([^\t]*)").alias("url"), part(r"\tt:([^\t]*)").alias("title"), part(r"\tH:(.*)$").alias("text"))
    return out.where("doc_id is not null")


def read_text_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of every file under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, word, starred) of a synonym file, a group for each line."""
    from ..operators.expand import synonym_groups

    return synonym_groups(numbered_lines(spark, path).select((F.col("line_no") + 1).alias("line_no"), "value"))


def read_custom_scores(spark: SparkSession, path: str) -> DataFrame:
    """(word, factor) of lines ``<score> TAB <word>``; # comments."""
    f = F.split("value", "\t", -1)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) == 2))
    return lines.select(f[1].alias("word"), f[0].try_cast("int").alias("factor")).where("factor is not null and word <> ''")


def read_index_words(spark: SparkSession, path: str) -> list[str]:
    """Words such as c++ that count as one, a line each, lower-cased: a hand-written list, refused beyond 100,000 lines."""
    got = [r[0].strip().lower() for r in spark.read.text(path).where("trim(value) <> ''").limit(100_001).collect()]
    if len(got) > 100_000:
        raise ValueError("too many index words for one pattern")
    return sorted(set(got))


def read_query_list(spark: SparkSession, path: str) -> list[str]:
    """Queries to keep in the cache, a line each, # comments: a hand-written list, refused beyond 10,000."""
    got = [r[0].strip() for r in spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").limit(10_001).collect()]
    if len(got) > 10_000:
        raise ValueError("too many queries to keep in the cache")
    return got


def headed_text(pages: DataFrame) -> DataFrame:
    """(doc_id, place, kind, heading, text) of extracted page text: (doc_id, page, text) lines, numbered headings told from paragraphs.

    A line ``1 Title`` or ``1.2 Title`` or ``1.2.3 Title`` is a heading H0, H1 or H2; lines up to a blank one are a paragraph under the last heading.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    number = F.regexp_extract("line", r"^\s*(\d+(?:\.\d+){0,2})\.?\s+\p{Lu}", 1)
    level = F.when(number != "", F.size(F.split(number, r"\.")) - 1)
    w = Window.partitionBy("doc_id").orderBy("page", "no")
    marked = lines.withColumn("level", level).withColumn("new", (F.col("level").isNotNull() | (F.trim("line") == "") | F.lag("level").over(w).isNotNull()).cast("int"))
    run = marked.withColumn("place", F.sum("new").over(w)).withColumn("heading", F.last(F.when(F.col("level").isNotNull(), F.trim("line")), ignorenulls=True).over(w))
    out = run.where("trim(line) <> ''").groupBy("doc_id", "place").agg(F.min("page").alias("page"), F.max("level").alias("level"), F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "no", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"))
    return out.select("doc_id", "place", "page", F.when(F.col("level").isNotNull(), F.concat(F.lit("H"), F.col("level"))).otherwise("P").alias("kind"), "heading", "text")
