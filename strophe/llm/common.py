"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is set.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strophe-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from its checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def once(df: DataFrame, **values) -> DataFrame:
    """``df`` with a column for each of ``values``, computed once for a row however many expressions read it later on."""
    (name,) = free_names(df, "once")
    out = df.select("*", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(name))
    return out.withColumns({k: F.col(name)[k] for k in values}).drop(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unsigned_crc32(column) -> F.Column:
    return F.crc32(column).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating star contractions.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Returns ``node, root`` for every node
    that has an edge to another node; ``root`` is the smallest node of its component. Each round links
    every neighbour to the smallest one it can see; large stars first, then small stars, until the set of
    edges stands still. State lives in checkpoints, only two numbers a round reach the driver, and the
    large groups at hubs are never collected: each star is a pre-aggregated minimum and a join.
    Self-loops and null ends are ignored; an empty graph gives an empty result.
    """
    found = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        found = cut(small.where("a <> b").distinct())
        seen = found.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
