"""Sound patterns over lines whose readings are given as vowels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.kana import rhyme_tail


def vowel_counts(lines: DataFrame) -> DataFrame:
    """vowel, morae, share over all lines; ``lines`` has vowels: array of a, i, u, e, o, N, Q."""
    rows = lines.select(F.explode("vowels").alias("vowel")).groupBy("vowel").agg(F.count("*").alias("morae"))
    total = rows.agg(F.sum("morae").alias("_n"))  # at most seven rows
    return rows.join(F.broadcast(total)).select("vowel", "morae", (F.col("morae") / F.col("_n")).alias("share"))


def pattern(lines: DataFrame, vowels: str, where: str = "end") -> DataFrame:
    """Lines whose vowels begin with, end with or hold a pattern."""
    line = F.array_join("vowels", "")
    test = {"end": line.endswith(vowels), "start": line.startswith(vowels), "any": line.contains(vowels)}[where]
    return lines.where(test)


def adjacent_rates(lines: DataFrame, longest: int = 5) -> DataFrame:
    """k, pairs, rhymes, rate, baseline and lift: how often lines next to each other end in the same k vowels, against any two lines
    of a song. Equal texts next to each other are left out. The baseline counts pairs by algebra, not by making them."""
    song = Window.partitionBy("song_id").orderBy("line_idx")
    rows = lines.withColumn("_x", F.lead("text").over(song)).select("song_id", "line_idx", "text", "_x", "vowels", F.lead("vowels").over(song).alias("_v"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")
    near = rows.where("_x IS NOT NULL AND _x <> text").select("*", ks)
    tail = lambda c: F.when(F.size(c) >= F.col("k"), F.array_join(F.slice(c, F.size(c) - F.col("k") + 1, F.col("k")), ""))
    near = near.select("k", tail(F.col("vowels")).alias("a"), tail(F.col("_v")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").groupBy("k").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("rhymes"))
    tails = lines.select("song_id", "vowels", ks).select("song_id", "k", tail(F.col("vowels")).alias("t")).where("t IS NOT NULL").groupBy("song_id", "k", "t").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    per_song = tails.groupBy("song_id", "k").agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("n"))
    base = per_song.groupBy("k").agg(F.sum("same").alias("same"), F.sum(pairs(F.col("n"))).alias("all"))
    out = near.join(base, "k")
    rate, baseline = F.col("rhymes") / F.col("pairs"), F.try_divide(F.col("same"), F.col("all"))
    return out.select("k", "pairs", "rhymes", rate.alias("rate"), baseline.alias("baseline"), F.try_divide(rate, baseline).alias("lift"))


__all__ = ["adjacent_rates", "pattern", "rhyme_tail", "vowel_counts"]
