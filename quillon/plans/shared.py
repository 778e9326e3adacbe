"""The folder that driver and executors share, and tables built there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import read_index, write_index, write_store

_own: dict[str, str] = {}
_built: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder under a local master, else one in the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def built_index(spark: SparkSession, key: str, postings: Callable[[], DataFrame]) -> DataFrame:
    """The index of ``postings()``, written in ranges of words the first time a session asks for ``key``, and read from then on."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _built:
        path = new_path(spark, "index")
        write_index(postings(), path)
        _built[at] = path
    return read_index(spark, _built[at])


def built_store(spark: SparkSession, key: str, docs: Callable[[], DataFrame]) -> str:
    """Where the store of ``docs()`` is, written the first time a session asks for ``key``."""
    at = (spark.sparkContext.applicationId, f"store {key}")
    if at not in _built:
        path = new_path(spark, "store")
        write_store(docs(), path)
        _built[at] = path
    return _built[at]


def built_specials(spark: SparkSession, key: str, specials: Callable[[], DataFrame]) -> DataFrame:
    """Special words (word, plain) of an index, in ranges of words, written the first time a session asks for ``key``."""
    at = (spark.sparkContext.applicationId, f"specials {key}")
    if at not in _built:
        path = new_path(spark, "specials")
        specials().repartitionByRange("word").sortWithinPartitions("word").write.parquet(path)
        _built[at] = path
    return spark.read.parquet(_built[at])
