"""Sinks: words and docs files, vocabulary, the block-ordered index, and responses."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import block_of, vocabulary


def writable(p: DataFrame) -> DataFrame:
    return p.where(F.octet_length("word").between(1, 1000) & ~F.contains("word", F.lit(" ")))


def write_words(p: DataFrame, path: str) -> None:
    """word, doc, score, position lines, sorted by word, document and position over the files in order."""
    rows = writable(p).repartitionByRange("word", "doc_id", "position").sortWithinPartitions("word", "doc_id", "position")
    rows.select(F.concat_ws("\t", "word", F.col("doc_id").cast("string"), F.col("score").cast("string"), F.col("position").cast("string"))).write.text(path)


def write_docs(docs: DataFrame, path: str) -> None:
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\tu:"), "url", F.lit("\tt:"), "info", F.lit("\tH:"), F.regexp_replace("text", "[\t\n\r]", " "))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line).write.text(path)


def write_vocabulary(p: DataFrame, path: str, by: str = "occ_freq") -> None:
    vocabulary(p).select("word", F.col(by).alias("freq")).write.parquet(path)


#: Bytes of a table's files for each range of the index made from it (fixed value): a range is sorted in memory.
RANGE_BYTES = 8 << 20


def ranges(p: DataFrame) -> int | None:
    """How many ranges of words suit postings made row by row from one table of files; None for others, whose size is not known beforehand."""
    leaves = p._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = int(leaves.apply(0).stats().sizeInBytes()) if leaves.size() == 1 else 1 << 63
    if size >= 1 << 50:
        return None
    return max(p.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))


def write_index(p: DataFrame, path: str, length: int = 2) -> None:
    """Postings in ranges of words, so that a prefix reads few row groups; within a range by word, document and position.

    Ranges grow in number with the table, not in size, so that sorting them does not spill; blocks are told after the shuffle.
    """
    n = ranges(p)
    dealt = p.repartitionByRange(n, "word", "doc_id") if n else p.repartitionByRange("word", "doc_id")
    rows = dealt.sortWithinPartitions("word", "doc_id", "position")
    rows.withColumn("block", block_of(F.col("word"), length)).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_store(docs: DataFrame, path: str) -> None:
    """Whole documents in ranges of doc_id, compressed, in row groups small enough that few ids read little."""
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def stored_documents(spark: SparkSession, path: str, ids: list[int], most: int = 10_000) -> DataFrame:
    """The documents of ``ids``, a page of hits; more than ``most`` are an error, as such a list belongs in a join."""
    if len(ids) > most:
        raise ValueError(f"{len(ids)} ids, more than {most}: join with the store instead")
    return spark.read.parquet(path).where(F.col("doc_id").isin(list(ids)))


def response(result: dict, form: str = "xml", callback: str = "") -> str:
    """A result of session.Index.answer as XML, JSON or, with a callback, JSONP; only ranked rows reach this point."""
    if form in ("json", "jsonp") or callback:
        body = json.dumps({"result": result}, ensure_ascii=False)
        return f"{callback}({body})" if callback else body
    parts = ['<?xml version="1.0" encoding="utf-8"?>', f"<result><query>{escape(result['query'])}</query><status code=\"{result['status']}\"/>"]
    parts.append(f"<completions total={quoteattr(str(result['n_completions']))}>")
    parts += [f"<c dc=\"{c['doc_count']}\" oc=\"{c['occ_count']}\" sc=\"{c['score']}\">{escape(c['word'])}</c>" for c in result["completions"]]
    parts.append(f"</completions><hits total={quoteattr(str(result['n_hits']))} first=\"{result['first']}\">")
    for h in result["hits"]:
        parts.append(f"<hit id=\"{h['doc_id']}\" score=\"{h['score']}\"><title>{escape(h.get('title') or '')}</title><url>{escape(h.get('url') or '')}</url><info>{escape(h.get('info') or '')}</info>")
        parts += [f"<excerpt>{escape(e)}</excerpt>" for e in h.get("excerpts") or []]
        parts.append("</hit>")
    return "".join([*parts, "</hits></result>"])
