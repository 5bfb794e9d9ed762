"""The play tracker as a stream: samples of a player's state become play events.

Time counts by the clock while a song plays; gaps of over two seconds between samples do not. A play ends with another song,
with stop or end; plays under five seconds are dropped; one that reached 95 % of the song is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MIN_LISTENED, COMPLETE, MAX_GAP = 5.0, 0.95, 2.0
EVENTS = "user_id long, song_id long, started timestamp, listened_sec double, position_sec double, completed boolean"
STATE = "song_id long, started timestamp, listened double, position double, furthest double, duration double, last timestamp"


def plays_of(samples: DataFrame) -> DataFrame:
    """Batch form over samples (user_id, at, song_id, state, position_sec, duration_sec): the same events by windows."""
    order = Window.partitionBy("user_id").orderBy("at", "song_id")
    rows = samples.withColumns({"_song": F.lag("song_id").over(order), "_state": F.lag("state").over(order), "_at": F.lag("at").over(order)})
    new = F.col("_song").isNull() | (F.col("_song") != F.col("song_id")) | F.col("_state").isin("ended", "empty")
    gap = (F.unix_micros("at") - F.unix_micros("_at")) / 1e6
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_play", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_sec", F.when((F.col("_new") == 0) & (F.col("_state") == "playing") & (gap <= MAX_GAP), gap).otherwise(0.0))
    last = F.struct("at", "song_id")
    per = rows.groupBy("user_id", "_play").agg(F.first("song_id").alias("song_id"), F.min("at").alias("started"), F.sum("_sec").alias("listened_sec"), F.max_by("position_sec", last).alias("position_sec"), F.max("position_sec").alias("_far"), F.max("duration_sec").alias("_d"))
    done = F.coalesce((F.col("_d") > 0) & (F.col("_far") >= F.col("_d") * COMPLETE), F.lit(False))
    return per.where(F.col("listened_sec") >= MIN_LISTENED).select("user_id", "song_id", "started", "listened_sec", "position_sec", done.alias("completed"))


def _event(user: int, s: tuple) -> dict:
    song, started, listened, position, furthest, duration, _ = s
    return {"user_id": user, "song_id": song, "started": started, "listened_sec": listened, "position_sec": position, "completed": bool(duration and furthest >= duration * COMPLETE)}


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else None
    out = []
    for batch in batches:
        for r in batch.sort_values(["at", "song_id"]).itertuples():
            if now is not None and now[0] != r.song_id:
                out += [_event(key[0], now)] if now[2] >= MIN_LISTENED else []
                now = None
            if now is None:
                now = (r.song_id, r.at, 0.0, r.position_sec, r.position_sec, r.duration_sec, r.at)
                playing = r.state
            gap = (r.at - now[6]).total_seconds()
            add = gap if 0 < gap <= MAX_GAP and playing == "playing" else 0.0
            now = (now[0], now[1], now[2] + add, r.position_sec, max(now[4], r.position_sec), r.duration_sec, r.at)
            playing = r.state
            if r.state in ("ended", "empty"):
                out += [_event(key[0], now)] if now[2] >= MIN_LISTENED else []
                now = None
    if now is None:
        state.remove() if state.exists else None
    else:
        state.update(now)
    if out:
        yield pd.DataFrame(out)


def track(samples: DataFrame) -> DataFrame:
    """Streaming form: plays as they end, a state of one row for each user."""
    return samples.groupBy("user_id").applyInPandasWithState(_track, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(plays: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Plays by time window behind a watermark; ours, the model itself has no windows."""
    return plays.withWatermark("played_at", late).groupBy(F.window("played_at", size).alias("w")).agg(F.count("*").alias("plays"), F.sum("listened_sec").alias("listened_sec")).select("w.start", "w.end", "plays", "listened_sec")
