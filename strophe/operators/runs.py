"""Snapshots of a corpus, archived analysis runs, and what differs between two of them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "run_id string, kind string, params string, scope string, snapshot string, result string, result_hash string"


def snapshot(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row that changes when the corpus does: songs, lines, tokens, largest song and line number, and an order-free hash of all lines."""
    a = lines.agg(F.count_distinct("song_id").alias("songs"), F.count("*").alias("lines"), F.max("song_id").alias("last_song"), F.max("line_idx").alias("last_line"), F.bit_xor(F.xxhash64("song_id", "line_idx", "text")).alias("fingerprint"))
    return a.join(F.broadcast(tokens.agg(F.count("*").alias("tokens"))))  # one row each


def archive(result: DataFrame, kind: str, params: dict, scope: str, snap: DataFrame) -> DataFrame:
    """An archived run as one row of RUNS. ``result`` is a bounded table (a top-k), as what an analysis shows."""
    rows = [r.asDict(recursive=True) for r in result.collect()]  # bounded by the analysis' own limit
    body = json.dumps(rows, sort_keys=True, default=str)
    snap_json = json.dumps(snap.first().asDict(), sort_keys=True, default=str)
    key = hashlib.sha256(json.dumps([kind, params, scope, snap_json], sort_keys=True).encode()).hexdigest()
    return result.sparkSession.createDataFrame([(key, kind, json.dumps(params, sort_keys=True), scope, snap_json, body, hashlib.sha256(body.encode()).hexdigest())], RUNS)


def compare_words(left: DataFrame, right: DataFrame, limit: int = 200) -> DataFrame:
    """lemma, pos, left_freq, right_freq and difference of two frequency tables; the largest differences first."""
    a = left.select("lemma", "pos", F.col("freq").alias("left_freq"))
    b = right.select("lemma", "pos", F.col("freq").alias("right_freq"))
    out = a.join(b, ["lemma", "pos"], "full").fillna(0, ["left_freq", "right_freq"]).withColumn("difference", F.col("right_freq") - F.col("left_freq")).where("difference <> 0")
    return out.orderBy(F.desc(F.abs("difference")), "lemma", "pos").limit(limit)


def scope_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side (left or right) and song_id of songs that only one scope holds."""
    a, b = left.select("song_id").distinct(), right.select("song_id").distinct()
    only = lambda x, y, side: x.join(y, "song_id", "left_anti").select(F.lit(side).alias("side"), "song_id")
    return only(a, b, "left").unionByName(only(b, a, "right"))
