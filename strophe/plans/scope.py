"""Which songs and lines a query counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS, DISTINCT_LINES = "tokens", "distinct_lines"


@dataclass(frozen=True)
class Subcorpus:
    """Conditions that all have to hold; within one, any value will do. Empty conditions say nothing."""

    artists: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    albums: tuple[int, ...] = ()
    song_ids: tuple = ()
    year_from: int | None = None
    year_to: int | None = None
    min_completeness: float | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for name, values in (("artist", self.artists), ("language", self.languages), ("album_id", self.albums), ("song_id", self.song_ids)):
            if values:
                out &= F.col(name).isin(*values)
        if self.genres:
            out &= F.lower(F.trim("genre")).isin(*[g.strip().lower() for g in self.genres])
        if self.year_from is not None:
            out &= year_of() >= self.year_from
        if self.year_to is not None:
            out &= (year_of() <= self.year_to) & (year_of() > 0)
        if self.min_completeness is not None:
            out &= F.col("completeness") >= self.min_completeness
        return out

    def describe(self) -> str:
        said = [f"{k} in {', '.join(map(str, v))}" for k, v in vars(self).items() if isinstance(v, tuple) and v]
        return "; ".join(said + [f"{k} {v}" for k, v in vars(self).items() if v is not None and not isinstance(v, tuple)]) or "everything"


def year_of() -> Column:
    """The leading digits of the release date, else of the year; 0 where there are none."""
    text = F.coalesce(F.nullif(F.substring("release_date", 1, 4), F.lit("")), F.col("year"))
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(0))


@dataclass(frozen=True)
class Scope:
    subcorpus: Subcorpus = field(default_factory=Subcorpus)
    unit: str = TOKENS
    jp_only: bool = False


def live(songs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose song has no tombstone; rows without a song stay."""
    gone = removed.select(F.col("song_id").alias("_gone")).distinct()
    return songs.join(gone, songs["song_id"] == gone["_gone"], "left_anti")


def in_scope(rows: DataFrame, songs: DataFrame, subcorpus: Subcorpus) -> DataFrame:
    """Rows (lines, plays, ...) whose song the sub-corpus holds."""
    return rows.join(songs.where(subcorpus.condition()).select("song_id").distinct(), "song_id", "left_semi")


def first_of_equal_lines(lines: DataFrame, by: str = "line_idx") -> DataFrame:
    """Of lines with the same text in a song the one of the smallest ``by``."""
    nth = F.row_number().over(Window.partitionBy("song_id", "text").orderBy(by))
    return lines.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def facets(songs: DataFrame, column: str) -> DataFrame:
    """Values of a column with their number of songs; spellings that differ in case or outer blanks are one."""
    key = F.lower(F.trim(column))
    return songs.where(key != "").groupBy(key.alias("key")).agg(F.min(column).alias("value"), F.count("*").alias("songs"))
