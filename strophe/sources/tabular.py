"""CSV, JSON lines and flash-card tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SONGS = "id string, title string, artist string, year string, album string, genre string, audio_path string"
UTTERANCES = "song_id string, line_idx long, time_sec double, text string, tokens array<struct<text:string,lemma:string,pos:string,dep:string,head:long>>"


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SONGS).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def upsert(songs: DataFrame, changed: DataFrame) -> DataFrame:
    """Songs with the rows of ``changed`` in place of those of the same id."""
    return songs.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def read_utterances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines and tokens of utterance JSON lines."""
    rows = spark.read.schema(UTTERANCES).json(path)
    tokens = rows.select("song_id", "line_idx", F.posexplode("tokens").alias("token_idx", "t")).select("song_id", "line_idx", F.col("token_idx").cast("long").alias("token_idx"), F.col("t.text").alias("surface"), "t.lemma", "t.pos")
    return rows.drop("tokens"), tokens


def write_cards(cards: DataFrame, path: str) -> None:
    """Flash cards as tab-separated quoted fields."""
    cards.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').csv(path)


def learning(notes: DataFrame, cards: DataFrame) -> DataFrame:
    """expression, notes, cards, max_reps and studied (any repetition) from a flash-card collection; fields end at \\x1f."""
    n = notes.select(F.col("id").alias("nid"), F.element_at(F.split("flds", "\x1f"), 1).alias("expression"))
    out = n.join(cards.select("nid", "reps"), "nid", "left").groupBy("expression").agg(F.count_distinct("nid").alias("notes"), F.count("reps").alias("cards"), F.coalesce(F.max("reps"), F.lit(0)).alias("max_reps"))
    return out.withColumn("studied", F.col("max_reps") > 0)


def dictionary_terms(banks: DataFrame) -> DataFrame:
    """term, reading, rules, score, sequence of term banks: one row a file with ``value``, its JSON array."""
    row = F.explode(F.from_json("value", "array<array<string>>")).alias("r")
    at = lambda k: F.get("r", F.lit(k))
    return banks.select(row).select(at(0).alias("term"), F.coalesce(F.nullif(at(1), F.lit("")), at(0)).alias("reading"), at(3).alias("rules"), at(4).try_cast("double").alias("score"), at(6).try_cast("long").alias("sequence"))


def dictionary_lookup(words: DataFrame, terms: DataFrame, limit: int = 32) -> DataFrame:
    """Terms of each word whose term or reading is the word or a form it comes from (``forms``: array), best ``limit``: longer
    source forms, terms before readings, score. Two equi-joins instead of a join on either."""
    w = words.select("word", F.posexplode("forms").alias("step", "form"))
    by_term = w.join(terms, w["form"] == terms["term"]).withColumn("by", F.lit(0))
    by_reading = w.join(terms, w["form"] == terms["reading"]).where("term <> reading").withColumn("by", F.lit(1))
    rows = by_term.unionByName(by_reading)
    nth = F.row_number().over(Window.partitionBy("word").orderBy("step", "by", F.desc("score"), "term", "reading", "sequence"))
    return rows.withColumn("nth", nth.cast("long")).where(F.col("nth") <= limit).select("word", "form", "term", "reading", "rules", "score", "nth")


# Endings of inflected forms, endings of the dictionary form, in the order they are tried.
ENDINGS = (
    ("ました", "る"), ("ません", "る"), ("ます", "る"), ("なかった", "る"), ("ない", "る"), ("たい", "る"), ("られる", "る"), ("させる", "る"), ("て", "る"), ("た", "る"), ("よう", "る"),
    ("いた", "く"), ("いで", "ぐ"), ("んだ", "む"), ("んで", "ぶ"), ("った", "う"), ("って", "う"), ("かった", "い"), ("くない", "い"), ("くて", "い"), ("した", "す"), ("して", "す"),
)


def base_forms(word):
    """The word itself, then each form that one ending leads back to."""
    out = [F.array(word)]
    for ending, base in ENDINGS:
        stem = F.substring(word, F.lit(1), F.length(word) - len(ending))
        out.append(F.when(word.endswith(ending) & (F.length(word) > len(ending)), F.array(F.concat(stem, F.lit(base)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))
