"""The ordered token stream: the scan behind all corpus statistics.

Tokens come from a pattern: runs of letters and digits, and each other sign alone. Lemma is lower case, the part of speech a
rule of form (no tagger is assumed): PUNCT, NUM, ADP (three letters or fewer), NOUN. A table of tagged tokens with the
same columns can stand in for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import text
from strophe.plans.rounds import once
from strophe.plans.scope import DISTINCT_LINES, TOKENS, Scope

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
DROPPED = ("PUNCT", "SYM")
FUNCTION_POS = ("ADP", "AUX", "SCONJ", "CCONJ", "PART", "DET")
#: Songs are put to buckets of so many ids when positions are counted across songs.
BUCKET_BITS = 16


def is_word(token: Column) -> Column:
    """No sign: what has more than one character is a run of letters and digits."""
    return (F.length(token) > 1) | token.rlike(r"^[\p{L}\p{N}]")


def word_pos(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{N}+$"), "NUM").when(F.length(word) <= 3, "ADP").otherwise("NOUN")


def pos_of(surface: Column) -> Column:
    return F.when(is_word(surface), word_pos(surface)).otherwise("PUNCT")


def tokenized(lines: DataFrame) -> DataFrame:
    """``lines`` with tokens: array of surface, lemma, pos, token_idx."""
    surfaces = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    token = lambda s, i: F.struct(s.alias("surface"), F.lower(s).alias("lemma"), pos_of(s).alias("pos"), i.cast("long").alias("token_idx"))
    return once(lines.where(F.col("text").rlike(r"\S")), "tokens", F.transform(surfaces, token))


def marked(lines: DataFrame, jp_only: bool = False) -> DataFrame:
    """Tokenized lines with repeat (the song has an earlier line of the same text) and kept (tokens without marks).

    Lines are dealt out for repeat before they are taken apart, so that texts move and tokens do not; nothing moves where repeat is not read.
    """
    nth = F.row_number().over(Window.partitionBy("song_id", "text").orderBy("line_idx"))
    lines = tokenized(lines.withColumn("repeat", nth > 1))
    keep = lambda t: ~t["pos"].isin(*DROPPED) & (text.is_japanese(t["lemma"]) if jp_only else F.lit(True))
    return once(lines, "kept", F.filter("tokens", keep))


def stream(lines: DataFrame, scope: Scope | None = None) -> DataFrame:
    """A row for each kept token: song_id, line_idx, idx (place among the line's kept tokens), token_idx, surface, lemma,
    pos, repeat, gap_before (dropped tokens lie between it and the one before) and the line's other columns."""
    scope = scope or Scope()
    nth = F.row_number().over(Window.partitionBy("song_id", "text").orderBy("line_idx"))
    rows = lines.where(F.col("text").rlike(r"\S")).withColumn("repeat", nth > 1)
    others = [c for c in rows.columns if c != "text"]
    keep = lambda t: is_word(t) & (text.is_japanese(F.lower(t)) if scope.jp_only else F.lit(True))
    rows = rows.select(*others, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    rows = rows.select(*others, "tokens", F.array_compact(F.transform("tokens", lambda t, i: F.when(keep(t), i))).alias("places"))
    gap = lambda p, i: (i > 0) & F.coalesce(p - F.get(F.col("places"), i - 1) > 1, F.lit(False))
    # a row carries its own token, not its line's; what needs no neighbours is left to rows, as functions of arrays are slow for each entry
    each = F.transform("places", lambda p, i: F.struct(F.get(F.col("tokens"), p).alias("surface"), p.alias("token_idx"), gap(p, i).alias("gap_before")))
    rows = rows.select(*others, F.posexplode(each).alias("idx", "t")).select(*others, "idx", "t.*")
    return rows.select(*others, F.col("idx").cast("long").alias("idx"), "surface", F.lower("surface").alias("lemma"), word_pos(F.col("surface")).alias("pos"), F.col("token_idx").cast("long").alias("token_idx"), "gap_before")


def counted(tokens: DataFrame, unit: str) -> DataFrame:
    return tokens.where(~F.col("repeat")) if unit == DISTINCT_LINES else tokens


def song_sizes(tokens: DataFrame) -> DataFrame:
    """song_id, bucket, size and start: how many counted tokens songs before it have, in the order of song ids.

    Sums run within a bucket of ids and over the buckets' totals, so no task sees all songs.
    """
    sizes = tokens.groupBy("song_id").agg(F.count("*").alias("size")).withColumn("bucket", F.shiftright(F.col("song_id").cast("long"), BUCKET_BITS))
    totals = sizes.groupBy("bucket").agg(F.sum("size").alias("n"))
    # one row for each 65,536 ids
    totals = totals.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.sum("size").over(Window.partitionBy("bucket").orderBy("song_id")) - F.col("size")
    return sizes.withColumn("within", within).join(totals, "bucket").select("song_id", "bucket", "size", (F.col("base") + F.col("within")).alias("start"))


def positions(tokens: DataFrame) -> DataFrame:
    """Tokens (already the counted ones) with at: the place among all of them, from 0, in the order of songs, lines and tokens."""
    in_song = F.row_number().over(Window.partitionBy("song_id").orderBy("line_idx", "idx")) - 1
    return tokens.withColumn("_in", in_song).join(song_sizes(tokens).select("song_id", "bucket", "size", "start"), "song_id").withColumn("at", F.col("start") + F.col("_in")).drop("_in", "start")


TOKEN_SQL = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"
POS_SQL = r"CASE WHEN NOT regexp_matches(surface, '^[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(surface, '^\p{N}+$') THEN 'NUM' WHEN length(surface) <= 3 THEN 'ADP' ELSE 'NOUN' END"
SQL = {
    "tokens": f"""tokens AS MATERIALIZED (SELECT *, lower(surface) AS lemma, {POS_SQL} AS pos FROM (SELECT song_id, artist, language, line_idx, text, repeat, generate_subscripts(x, 1) - 1 AS token_idx, unnest(x) AS surface
        FROM (SELECT *, regexp_extract_all(text, {TOKEN_SQL}) AS x, row_number() OVER (PARTITION BY song_id, text ORDER BY line_idx) > 1 AS repeat FROM lines)))""",
    "kept": """kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY song_id, line_idx ORDER BY token_idx) - 1 AS idx,
        coalesce(token_idx - lag(token_idx) OVER (PARTITION BY song_id, line_idx ORDER BY token_idx) > 1, false) AS gap_before FROM tokens WHERE pos NOT IN ('PUNCT', 'SYM'))""",
}
__all__ = ["DISTINCT_LINES", "TOKENS", "counted", "marked", "positions", "song_sizes", "stream", "tokenized"]
