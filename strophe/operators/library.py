"""Library navigation and counts: works, albums, people, credits, collaboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.plans.scope import year_of

ROLE_ORDER = ("performer", "composer", "lyricist", "arranger")


def overview(works: DataFrame, credits: DataFrame) -> DataFrame:
    """One row: tracks, albums, people, people by role, total duration."""
    w = works.agg(F.count("*").alias("tracks"), F.count_distinct("album_id").alias("albums"), F.round(F.sum("duration_sec"), 2).alias("duration_sec"))
    c = credits.agg(F.count_distinct("person_id").alias("people"), *[F.count_distinct(F.when(F.col("role") == r, F.col("person_id"))).alias(f"{r}s") for r in ROLE_ORDER[:3]])
    return w.join(F.broadcast(c))  # one row each


def timeline(works: DataFrame) -> DataFrame:
    """Songs and albums of each year that is not blank."""
    return works.where(F.trim("year") != "").groupBy("year").agg(F.count_distinct("song_id").alias("songs"), F.count_distinct("album_id").alias("albums"))


def genres(works: DataFrame) -> DataFrame:
    """Songs and duration of each genre; blank ones together."""
    name = F.coalesce(F.nullif(F.trim("genre"), F.lit("")), F.lit("(none)"))
    return works.groupBy(name.alias("genre")).agg(F.count("*").alias("songs"), F.round(F.sum("duration_sec"), 2).alias("duration_sec"))


def decades(works: DataFrame) -> DataFrame:
    name = F.when(F.length("year") >= 3, F.concat(F.substring("year", 1, 3), F.lit("0s"))).otherwise(F.lit("(none)"))
    return works.groupBy(name.alias("decade")).agg(F.count("*").alias("songs"), F.round(F.sum("duration_sec"), 2).alias("duration_sec"))


def albums(albums_: DataFrame, works: DataFrame) -> DataFrame:
    """Each album with its tracks, duration and first year; albums without tracks too."""
    per = works.groupBy("album_id").agg(F.count("*").alias("tracks"), F.sum("duration_sec").alias("duration_sec"), F.min("year").alias("first_year"))
    out = albums_.join(per, "album_id", "left")
    return out.select("album_id", "title", F.coalesce("tracks", F.lit(0)).alias("tracks"), F.round(F.coalesce("duration_sec", F.lit(0.0)), 2).alias("duration_sec"), "first_year")


def people_by_role(people: DataFrame, credits: DataFrame, role: str) -> DataFrame:
    """People with the role and their number of songs."""
    per = credits.where(F.col("role") == role).groupBy("person_id").agg(F.count_distinct("song_id").alias("songs"))
    return people.join(per, "person_id")


def people_directory(people: DataFrame, credits: DataFrame, works: DataFrame) -> DataFrame:
    """Each person's songs by role, in all, and years."""
    rows = credits.join(works.select("song_id", "year"), "song_id", "left")
    per = rows.groupBy("person_id").agg(*[F.count_distinct(F.when(F.col("role") == r, F.col("song_id"))).alias(r) for r in ROLE_ORDER[:3]], F.count_distinct("song_id").alias("songs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return people.join(per, "person_id", "left").fillna(0, [*ROLE_ORDER[:3], "songs"])


def collaboration_edges(credits: DataFrame) -> DataFrame:
    """a < b and the number of songs both have a credit on. Pairs are made within a song, from its own list of people."""
    songs = credits.groupBy("song_id").agg(F.sort_array(F.collect_set("person_id")).alias("p")).where(F.size("p") > 1)  # a song's people
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return songs.select(F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("songs"))


def collaborators(credits: DataFrame, person) -> DataFrame:
    """Who shares songs with a person: person_id, songs, roles (theirs on those songs)."""
    mine = credits.where(F.col("person_id") == person).select("song_id").distinct()
    rows = credits.join(mine, "song_id", "left_semi").where(F.col("person_id") != person)
    return rows.groupBy("person_id").agg(F.count_distinct("song_id").alias("songs"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def ego_graph(edges: DataFrame, person, depth: int = 2, least: int = 1) -> DataFrame:
    """People within ``depth`` steps over edges of at least ``least`` songs: person_id, steps."""
    both = edges.where(F.col("songs") >= least)
    both = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.sparkSession.createDataFrame([(person, 0)], "person_id long, steps int")
    for k in range(1, depth + 1):
        step = found.where(F.col("steps") == k - 1).join(both, found["person_id"] == both["a"]).select(F.col("b").alias("person_id"), F.lit(k).alias("steps"))
        found = found.unionByName(step).groupBy("person_id").agg(F.min("steps").alias("steps"))
    return found


def release_timeline(works: DataFrame, credits: DataFrame) -> DataFrame:
    """Each performer's releases: album, or the song itself without one, its earliest date and tracks."""
    release = F.coalesce(F.concat(F.lit("album:"), F.col("album_id").cast("string")), F.concat(F.lit("song:"), F.col("song_id").cast("string")))
    performers = credits.where("role = 'performer'").select("song_id", "person_id").distinct()
    return works.withColumn("release", release).join(performers, "song_id").groupBy("person_id", "release").agg(F.min("release_date").alias("first_date"), F.count("*").alias("tracks"))


def member_suggestions(credits: DataFrame, members: DataFrame | None = None, least: int = 2, share: float = 0.5) -> DataFrame:
    """Writers most of whose songs are one performer's: performer, writer, shared, written, share.

    At least ``least`` shared songs and ``share`` of all the writer's; pairs in ``members`` (also rejected ones) and writers who perform
    themselves on the songs of that performer are left out.
    """
    performers = credits.where("role = 'performer'").select("song_id", F.col("person_id").alias("performer")).distinct()
    writers = credits.where("role IN ('composer', 'lyricist', 'arranger')").select("song_id", F.col("person_id").alias("writer")).distinct()
    written = writers.groupBy("writer").agg(F.count("*").alias("written"))
    both = writers.join(performers, "song_id").where("writer <> performer").groupBy("performer", "writer").agg(F.count("*").alias("shared"))
    out = both.join(written, "writer").withColumn("share", F.col("shared") / F.col("written")).where((F.col("shared") >= least) & (F.col("share") >= share))
    if members is not None:
        out = out.join(members.select(F.col("band").alias("performer"), F.col("person").alias("writer")), ["performer", "writer"], "left_anti")
    return out.select("performer", "writer", "shared", "written", "share")


def main_role(credits: DataFrame) -> DataFrame:
    """Each person's most frequent role; ties in the order of roles."""
    per = credits.groupBy("person_id", "role").agg(F.count("*").alias("n"))
    return per.groupBy("person_id").agg(F.max_by("role", F.struct("n", -role_rank())).alias("role"), F.max("n").alias("credits"))


def role_rank():
    out = F
    for k, r in enumerate(ROLE_ORDER):
        out = out.when(F.col("role") == r, F.lit(k))
    return out.otherwise(F.lit(len(ROLE_ORDER)))


def credits_of_songs(credits: DataFrame, people: DataFrame) -> DataFrame:
    """Credits in their order within each song: by role, position, name."""
    rows = credits.join(people, "person_id")
    nth = F.row_number().over(Window.partitionBy("song_id").orderBy(role_rank(), "position", "name", "person_id"))
    return rows.select("song_id", nth.cast("long").alias("nth"), "role", "name")


def person_works(credits: DataFrame, members: DataFrame, person) -> DataFrame:
    """Songs of a person's own credits and of bands they belong to, each once."""
    own = credits.where(F.col("person_id") == person).select("song_id")
    bands = members.where(F.col("person") == person).select(F.col("band").alias("person_id"))
    theirs = credits.join(bands, "person_id", "left_semi").select("song_id")
    return own.union(theirs).distinct()


def completeness(works: DataFrame, credits: DataFrame) -> DataFrame:
    """kind, done, total: how many songs have each kind of metadata."""
    has = {r: credits.where(F.col("role") == r).select("song_id").distinct().withColumn(f"_{r}", F.lit(True)) for r in ROLE_ORDER[:3]}
    rows = works
    for h in has.values():
        rows = rows.join(h, "song_id", "left")
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    kinds = {"album": filled("album_id"), "year": year_of() > 0, "genre": filled("genre"), "duration": F.coalesce(F.col("duration_sec") > 0, F.lit(False))} | {r: F.coalesce(F.col(f"_{r}"), F.lit(False)) for r in has}
    sums = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("done")) for k in kinds])).alias("x")
    return sums.select(each, "total").select("x.kind", "x.done", "total")


def tracks(songs: DataFrame, lines: DataFrame) -> DataFrame:
    """Songs with their number of lines, songs without lines too."""
    per = lines.groupBy("song_id").agg(F.count("*").alias("line_count"))
    return songs.select("song_id", "artist").join(per, "song_id", "left").fillna(0, ["line_count"])


def source_counts(songs: DataFrame, removed: DataFrame, by: str) -> DataFrame:
    """Songs in the library and removed ones for each value of a column."""
    gone = removed.select("song_id").distinct().withColumn("_gone", F.lit(True))
    return songs.join(gone, "song_id", "left").groupBy(by).agg(F.count_if(F.col("_gone").isNull()).alias("in_library"), F.count_if(F.col("_gone")).alias("removed"))


def roster(songs: DataFrame, separator: str = "/") -> DataFrame:
    """Names in a list-valued artist field and the number of tracks that name each."""
    each = F.explode(F.array_distinct(F.split("artist", separator))).alias("name")
    return songs.select("song_id", each).where("name <> ''").groupBy("name").agg(F.count("*").alias("tracks"))
