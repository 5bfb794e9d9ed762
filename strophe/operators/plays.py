"""Listening statistics over play events, and listening sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def most_played(plays: DataFrame, least_sec: float = 30.0, limit: int | None = 20) -> DataFrame:
    """Songs by plays of at least ``least_sec``: plays, listened_sec, last_played; position and completion come from the last of
    all plays, also shorter ones."""
    last = F.struct("played_at", "id")
    per = plays.groupBy("song_id").agg(
        F.count_if(F.col("listened_sec") >= least_sec).alias("plays"),
        F.round(F.sum(F.when(F.col("listened_sec") >= least_sec, F.col("listened_sec"))), 4).alias("listened_sec"),
        F.max(F.when(F.col("listened_sec") >= least_sec, F.col("played_at"))).alias("last_played"),
        F.max_by("listened_sec", last).alias("last_position"), F.max_by("completed", last).alias("last_completed"),
    ).where("plays > 0")
    return per.orderBy(F.desc("plays"), F.desc("last_played"), "song_id").limit(limit) if limit else per


def recent(plays: DataFrame, limit: int | None = 20) -> DataFrame:
    """Songs by their last play."""
    per = plays.groupBy("song_id").agg(F.max("played_at").alias("last_played"), F.count("*").alias("plays"), F.max_by("listened_sec", F.struct("played_at", "id")).alias("last_position"))
    return per.orderBy(F.desc("last_played"), "song_id").limit(limit) if limit else per


def daily(plays: DataFrame, hours: int = 0) -> DataFrame:
    """day, listened_sec, songs and plays of each local day, ``hours`` from UTC."""
    day = F.to_date(F.col("played_at") + F.make_dt_interval(hours=F.lit(hours)))
    return plays.groupBy(day.alias("day")).agg(F.round(F.sum("listened_sec"), 4).alias("listened_sec"), F.count_distinct("song_id").alias("songs"), F.count("*").alias("plays"))


def streaks(plays: DataFrame, key: str = "song_id", hours: int = 0) -> DataFrame:
    """Runs of days in a row with a play, of each key: first_day, last_day, days."""
    day = F.to_date(F.col("played_at") + F.make_dt_interval(hours=F.lit(hours)))
    days = plays.select(F.col(key).alias("key"), day.alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("key").orderBy("day")))
    return days.withColumn("island", island).groupBy("key", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


def streak(days: list[int], today: int) -> int:
    """Days in a row up to today, or up to yesterday if there is none today yet."""
    have, at = set(days), today if today in set(days) else today - 1
    n = 0
    while at in have:
        n, at = n + 1, at - 1
    return n


def reach(plays: DataFrame, tokens: DataFrame, least_sec: float = 30.0) -> DataFrame:
    """One row: heard and total different content lemmas; heard ones stand in songs played for ``least_sec`` in all."""
    heard = plays.groupBy("song_id").agg(F.sum("listened_sec").alias("s")).where(F.col("s") >= least_sec).select("song_id", F.lit(True).alias("heard"))
    words = tokens.where(~F.col("pos").isin("PUNCT", "SYM", "ADP", "AUX", "SCONJ", "CCONJ", "PART", "DET")).select("song_id", "lemma").distinct().join(heard, "song_id", "left")
    return words.groupBy("lemma").agg(F.max(F.coalesce("heard", F.lit(False))).alias("h")).agg(F.count_if("h").alias("heard"), F.count("*").alias("total"))


def lines_heard(plays: DataFrame, lines: DataFrame) -> DataFrame:
    """song_id and lines heard over all plays: those whose time lies between position - listened and position, ends included.

    A play meets its song's times as one array and counts in its own row, so plays and lines never multiply to rows.
    """
    times = lines.where("time_sec IS NOT NULL").groupBy("song_id").agg(F.collect_list("time_sec").alias("_times"))  # one song's lines
    rows = plays.join(times, "song_id")
    heard = F.size(F.filter("_times", lambda t: (t >= F.col("position_sec") - F.col("listened_sec")) & (t <= F.col("position_sec"))))
    return rows.groupBy("song_id").agg(F.sum(heard.cast("long")).alias("lines_heard")).where("lines_heard > 0")


def line_at(plays: DataFrame, lines: DataFrame) -> DataFrame:
    """id and the line sung at the play's position: the last one that starts at or before it, in line order of equal times."""
    starts = lines.where("time_sec IS NOT NULL").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("time_sec", "line_idx"))).alias("_starts"))  # one song's lines
    at = F.get(F.filter("_starts", lambda s: s["time_sec"] <= F.col("position_sec")), F.size(F.filter("_starts", lambda s: s["time_sec"] <= F.col("position_sec"))) - 1)
    rows = plays.join(starts, "song_id").select("id", "song_id", at["time_sec"].alias("time_sec"), at["line_idx"].alias("line_idx")).where("line_idx IS NOT NULL")
    said = lines.select("song_id", "line_idx", "time_sec", "text")
    return rows.join(said, ["song_id", "line_idx", "time_sec"]).groupBy("id").agg(F.max("line_idx").alias("line_idx"), F.max("text").alias("text"))


def sessions(plays: DataFrame, gap_sec: int = 1800) -> DataFrame:
    """Listening sessions of each key: plays with no more than ``gap_sec`` between them: started, ended, plays, listened_sec."""
    order = Window.partitionBy("song_id").orderBy("played_at", "id")
    far = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("played_at").over(order), F.col("played_at")) > gap_sec * 1_000_000, F.lit(True))
    rows = plays.withColumn("_far", far.cast("int"))
    rows = rows.withColumn("session", F.sum("_far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("song_id", "session").agg(F.min("played_at").alias("started"), F.max("played_at").alias("ended"), F.count("*").alias("plays"), F.round(F.sum("listened_sec"), 4).alias("listened_sec"))
