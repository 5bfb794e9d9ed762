"""Steps of work that goes on in rounds, each on what the one before left."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from its checkpoint below ``spark.checkpoint.dir``; where that is unset and all runs on
    one machine, below a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="strophe-")
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once, however many expressions read it later on."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(F.struct(value.alias(name)))).alias("_once")).withColumn(name, F.col("_once")[name]).drop("_once")
