"""The token stream of the documents, written once and read by every query with the columns that it needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.plans import stream
from strophe.sources import tables

#: Names of tables by application, path and state of the documents.
_WRITTEN: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; a temporary folder where none is set and all runs on one machine; else none."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    return tempfile.mkdtemp(prefix="strophe-") if one_machine else None


def state(docs: DataFrame) -> tuple:
    """Changes when a file of the table is added, removed or written again; only file footers are read."""
    file = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    return tuple(docs.select(*file).distinct().agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first())


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream`` of all lines. Without a folder that executors share the stream is computed where it is read."""
    key = (spark.sparkContext.applicationId, sf_dir, state(tables.table(spark, sf_dir, "documents")))
    if key not in _WRITTEN:
        folder = shared_folder(spark)
        if folder is None:
            return stream.stream(tables.lines(spark, sf_dir))
        name = f"tokens_{uuid.uuid4().hex}"
        # whole songs in a file, so that counts within songs are summed up before they move; few bytes make many tokens, so the number of tasks is not left to bytes
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lines = tables.lines(spark, sf_dir).repartition(parts, "song_id")
        # as buckets, so that windows and counts within songs or their lines move no tokens
        stream.stream(lines).write.format("parquet").option("path", f"{folder}/{name}").bucketBy(parts, "song_id").saveAsTable(name)
        _WRITTEN[key] = f"{spark.catalog.currentDatabase()}.{name}"
    return spark.table(_WRITTEN[key])
