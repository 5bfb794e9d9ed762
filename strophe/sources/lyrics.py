"""Lyric files as lines: LRC by Spark expressions, SRT cues, format by content, other encodings of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STAMP = r"\[(\d+):(\d{1,2}(?:\.\d+)?)\]"
CREDITS = r"^(?:作詞|作词|作曲|編曲|编曲|Lyrics by|Composed by|Arranged by)\s*[:：]"


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: by a UTF-16 mark, else UTF-8, CP932 or GBK, whichever first fits."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return b.decode("utf-16", "replace")
        for name in ("utf-8-sig", "cp932", "gbk"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("utf-8", "replace")

    return content.map(one)


def format_of(text: Column) -> Column:
    """ttml, word_timed, lrc, srt or text, by content in this order."""
    return (
        F.when(text.rlike(r"<tt[\s>]"), "ttml")
        .when(text.rlike(r"(?m)^\[\d+,\d+\]"), "word_timed")
        .when(text.rlike(r"(?m)^\s*" + STAMP), "lrc")
        .when(text.rlike(r"(?m)^\d+:\d\d:\d\d[,.]\d+ --> "), "srt")
        .otherwise("text")
    )


def seconds(minutes: Column, rest: Column) -> Column:
    return minutes.try_cast("double") * 60 + rest.try_cast("double")


def lrc_lines(files: DataFrame) -> DataFrame:
    """song_id, line_idx, time_sec, text of LRC files (song_id, text).

    A line with several stamps is a line for each; ``[offset:ms]`` moves all times earlier, not below 0; tags and credit lines
    are no lines; untimed lines come last in their order.
    """
    offset = F.coalesce(F.regexp_extract("text", r"\[offset:\s*([+-]?\d+)\s*\]", 1).try_cast("double") / 1000, F.lit(0.0))
    rows = files.select("song_id", offset.alias("o"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    rows = rows.withColumn("raw", F.trim("raw")).where(~F.col("raw").rlike(r"^\[[a-zA-Z#]+:[^\]]*\]$"))
    stamps = F.regexp_extract_all(F.regexp_extract("raw", r"^((?:\[[\d:.]+\]\s*)*)", 1), F.lit(STAMP), F.lit(0))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^(?:\[[\d:.]+\]\s*)+", ""), r"<\d+:\d+(?:\.\d+)?>", ""))
    rows = rows.select("song_id", "o", "n", body.alias("text"), stamps.alias("stamps")).where((F.col("text") != "") & ~F.col("text").rlike(CREDITS))
    rows = rows.select("song_id", "o", "n", "text", F.explode_outer("stamps").alias("s"))
    time = seconds(F.regexp_extract("s", STAMP, 1), F.regexp_extract("s", STAMP, 2)) - F.col("o")
    rows = rows.withColumn("time_sec", F.when(F.col("s").isNotNull(), F.greatest(F.lit(0.0), time)))
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(F.col("time_sec").asc_nulls_last(), "n")) - 1
    return rows.select("song_id", place.cast("long").alias("line_idx"), "time_sec", "text")


def srt_lines(files: DataFrame) -> DataFrame:
    """song_id, line_idx, time_sec, end_sec, text of SRT files."""
    stamp = r"(\d+):(\d\d):(\d\d)[,.](\d+)"
    blocks = files.select("song_id", F.posexplode(F.split("text", r"(?:\r?\n){2,}")).alias("n", "b"))
    line = F.regexp_extract("b", rf"{stamp} --> {stamp}", 0)
    at = lambda k: F.regexp_extract(line, rf"{stamp} --> {stamp}", k)
    sec = lambda k: at(k).try_cast("double") * 3600 + at(k + 1).try_cast("double") * 60 + at(k + 2).try_cast("double") + F.concat(F.lit("0."), at(k + 3)).try_cast("double")
    text = F.regexp_replace(F.regexp_replace("b", r"(?s)^.*? --> [^\n]*\n?", ""), r"<[^>]*>|^\s+|\s+$", "")
    rows = blocks.select("song_id", "n", sec(1).alias("time_sec"), sec(5).alias("end_sec"), text.alias("text"), line.alias("l")).where("l <> '' AND text <> ''")
    place = F.row_number().over(Window.partitionBy("song_id").orderBy("time_sec", "n")) - 1
    return rows.select("song_id", place.cast("long").alias("line_idx"), "time_sec", "end_sec", "text")


def word_timings(files: DataFrame) -> DataFrame:
    """song_id, line_idx, word_idx, start_ms, end_ms, word of files with ``[start,length]word(start,length)...`` lines."""
    rows = files.select("song_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).where(F.col("raw").rlike(r"^\[\d+,\d+\]"))
    rows = rows.withColumn("line_idx", F.row_number().over(Window.partitionBy("song_id").orderBy("n")).cast("long") - 1)
    word = r"([^()]*)\((\d+),(\d+)\)"
    rows = rows.select("song_id", "line_idx", F.posexplode(F.regexp_extract_all(F.regexp_replace("raw", r"^\[\d+,\d+\]", ""), F.lit(word), F.lit(0))).alias("word_idx", "w"))
    start, length = F.regexp_extract("w", word, 2).cast("long"), F.regexp_extract("w", word, 3).cast("long")
    return rows.select("song_id", "line_idx", F.col("word_idx").cast("long").alias("word_idx"), start.alias("start_ms"), (start + length).alias("end_ms"), F.regexp_extract("w", word, 1).alias("word"))
