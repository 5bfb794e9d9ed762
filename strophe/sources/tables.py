"""The model's tables over the given Parquet tables. The one place that knows their columns.

| model | table |
|---|---|
| songs, lines | documents: one song each, a line for each line of text that is not blank |
| works, credits, people, albums | orders, lineitem (role by l_returnflag), supplier, customer |
| plays | events: one user's play of value seconds |
| turns | conversations |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles by l_returnflag.
ROLES = {"R": "performer", "A": "composer", "N": "lyricist"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("song_id"), F.col("source").alias("artist"), F.col("lang").alias("language"), F.element_at(F.split("text", "\n"), 1).alias("title"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, artist, language, line_idx, text"""
    d = table(spark, sf_dir, "documents")
    split = d.select(F.col("doc_id").alias("song_id"), F.col("source").alias("artist"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    return split.where(F.trim("text") != "").withColumn("line_idx", F.col("line_idx").cast("long"))


def removed_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with a tombstone: documents labelled as of no quality."""
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("song_id"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("song_id"),
        F.col("o_custkey").alias("album_id"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"),
        F.col("o_orderpriority").alias("genre"),
        F.col("o_totalprice").alias("duration_sec"),
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, person_id, role, position; one row for each of the three keys."""
    item = table(spark, sf_dir, "lineitem")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("l_returnflag")]
    return item.select(F.col("l_orderkey").alias("song_id"), F.col("l_suppkey").alias("person_id"), role.alias("role"), F.col("l_linenumber").cast("long").alias("position")).groupBy("song_id", "person_id", "role").agg(F.min("position").alias("position"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("label"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("song_id"), F.col("ts").alias("played_at"), F.col("value").alias("listened_sec"), (F.col("event_type") == "purchase").alias("completed"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed songs: a turn starts after its own length so far, a second for every ten characters."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    before = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return c.select(F.col("conv_id").alias("song_id"), F.col("turn").alias("line_idx"), F.col("role").alias("artist"), "text", (F.coalesce(before, F.lit(0)) / 10.0).alias("time_sec"))


# The same model in SQL, for the comparison queries.
SQL = {
    "lines": """lines AS (SELECT * FROM (SELECT doc_id AS song_id, source AS artist, lang AS language, generate_subscripts(x, 1) - 1 AS line_idx, unnest(x) AS text
        FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS x FROM documents)) WHERE trim(text) <> '')""",
    "works": """works AS (SELECT o_orderkey AS song_id, o_custkey AS album_id, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%Y-%m-%d') AS release_date,
        o_orderpriority AS genre, o_totalprice AS duration_sec FROM orders)""",
    "credits": """credits AS (SELECT l_orderkey AS song_id, l_suppkey AS person_id, CASE l_returnflag WHEN 'R' THEN 'performer' WHEN 'A' THEN 'composer' WHEN 'N' THEN 'lyricist' END AS role,
        min(l_linenumber) AS position FROM lineitem GROUP BY ALL)""",
    "plays": """plays AS (SELECT event_id AS id, user_id AS song_id, ts AS played_at, value AS listened_sec, event_type = 'purchase' AS completed FROM events)""",
    "turns": """turns AS (SELECT conv_id AS song_id, turn AS line_idx, role AS artist, text,
        coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0 AS time_sec FROM conversations)""",
}
