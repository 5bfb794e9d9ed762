"""What a scan of files means for a library: an action for each file, and for each song whose file is gone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import names
from strophe.plans.rounds import settled

#: Seconds up to which two recordings may be one, and by which two times of a file may differ.
SAME_SECONDS, SAME_STAMP = 3.0, 2.0
# What marks another version, in Latin letters as whole words and in Japanese anywhere.
MARKERS = {
    "Live": (("live", "live ver", "live version", "unplugged"), ("ライブ", "ライヴ")),
    "Remix": (("remix", "rmx", "re-mix", "remixed"), ("リミックス",)),
    "Acoustic": (("acoustic",), ("アコースティック",)),
    "Instrumental": (("instrumental", "inst", "off vocal", "karaoke", "backing track"), ("インスト", "オフボーカル", "カラオケ")),
    "Cover": (("cover", "covers", "self cover"), ("カバー", "カヴァー")),
    "Remaster": (("remaster", "remastered", "remastering"), ("リマスター",)),
    "TV size": (("tv size", "tv ver", "tv version", "tv edit", "anime size"), ("tvサイズ", "tvsize")),
    "Edit": (("radio edit", "single edit", "edit", "short ver", "short version"), ("ショートver", "ショートバージョン")),
    "Demo": (("demo",), ("デモ",)),
    "Arrangement": (("orchestra", "orchestral", "symphonic", "piano ver", "piano version", "strings ver", "ballad ver"), ("オーケストラ", "ピアノver")),
}
FACTS = ["isrc", "mbid", "markers", "seconds"]


def markers(title: Column, album: Column) -> Column:
    """Marks of versions in a title or an album, in one text."""
    said = F.lower(names.nfkc(F.concat(F.coalesce(title, F.lit("")), F.lit(" / "), F.coalesce(album, F.lit("")))))
    close = F.regexp_replace(said, r"(?U)\s+", "")
    found = []
    for mark, (words, japanese) in MARKERS.items():
        either = "|".join(w.replace(" ", r"\s*") for w in words)
        held = said.rlike(rf"(?:^|[^a-z0-9])(?:{either})(?:$|[^a-z0-9])")
        for word in japanese:
            held |= close.contains(word)
        found.append(F.when(held, mark))
    return F.array_join(F.array_compact(F.array(*found)), "/")


def path_key(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def prepared(rows: DataFrame) -> DataFrame:
    """Keys and facts of tracks (path, title, artist, album, isrc, mbid, duration_sec): path_key, identity (null where title or artist is blank), and FACTS, blank
    or null where not known."""
    artist, title = names.key_of(F.coalesce("artist", F.lit(""))), names.key_of(F.coalesce("title", F.lit("")))
    rows = rows.withColumns({"_artist": artist, "_title": title, "_marks": markers(F.col("title"), F.col("album"))})
    identity = F.when((F.col("_artist") != "") & (F.col("_title") != ""), F.concat("_artist", F.lit("\x1f"), "_title"))
    facts = {"isrc": F.regexp_replace(F.upper(F.coalesce("isrc", F.lit(""))), "[^A-Z0-9]", ""), "mbid": F.lower(F.trim(F.coalesce("mbid", F.lit("")))), "markers": F.col("_marks"), "seconds": F.when(F.col("duration_sec") > 0, F.col("duration_sec").cast("double"))}
    return rows.withColumns({"path_key": path_key(F.col("path")), "identity": identity} | facts).drop("_artist", "_title", "_marks")


def difference(a: str, b: str) -> Column:
    """Why two tracks of one identity are different versions: their codes, their marks, their time; null if they are one. Facts that one side lacks say nothing."""
    x, y = (lambda f: F.col(f"{a}{f}")), (lambda f: F.col(f"{b}{f}"))
    other = lambda f: (x(f) != "") & (y(f) != "") & (x(f) != y(f))
    return F.when(other("isrc"), "code").when(other("mbid"), "recording").when(x("markers") != y("markers"), "version").when(F.abs(x("seconds") - y("seconds")) > SAME_SECONDS, "duration")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For facts sorted by identity and the place where they first come: ``of``, the place of the identity's earlier ones that they are the same version as, or
    their own. Only an identity's versions are held, by their marks."""
    identity, versions = None, {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("identity", *FACTS, "first")]
        of = []
        for name, isrc, mbid, marks, seconds, first in zip(*columns, strict=True):
            if name != identity:
                identity, versions = name, {}
            kept = versions.setdefault(marks, [])
            same = next((k[3] for k in kept if not (isrc and k[0] and isrc != k[0] or mbid and k[1] and mbid != k[1] or seconds is not None and k[2] is not None and abs(seconds - k[2]) > SAME_SECONDS)), None)
            if same is None:
                kept.append((isrc, mbid, seconds, first))
            of.append(first if same is None else same)
        yield batch.append_column("of", pa.array(of, pa.int64()))


def import_plan(scanned: DataFrame, library: DataFrame) -> DataFrame:
    """place, path, action, song_id, reason and first_path of each scanned file.

    ``scanned``: place (each file its own number, the order of the scan), path, title, artist, album, isrc, mbid, duration_sec, size, mtime, unsupported (why, else null).
    ``library``: id, path, title, artist, album, isrc, mbid, duration_sec, size, mtime; ids in the order of songs.
    The first that holds decides: the library has the path ("have"; reason "changed" if size or time differ, "unrecorded" if they aren't known); it can't be read or has no title
    ("skip"); an earlier new file has the path ("batch"); a song has its code or recording, or its identity and no difference ("duplicate", with the song); an earlier new file has its
    identity and no difference ("batch", with its path); else "new", with the first song of its identity, if any, as what it is a version of.

    Facts are compared as distinct ones: an identity's files of equal facts are one row. Files of one path are taken
    to have the same tags.
    """
    files, songs = settled(prepared(scanned)), settled(prepared(library))
    by_path = songs.where("path_key <> ''").groupBy("path_key").agg(F.max_by(F.struct("id", F.col("size").alias("size0"), F.col("mtime").alias("mtime0")), "id").alias("p"))
    code = lambda c, name: songs.where(f"{c} <> ''").groupBy(c).agg(F.min("id").alias(name))
    rows = files.join(by_path, "path_key", "left").join(code("isrc", "of_isrc"), "isrc", "left").join(code("mbid", "of_mbid"), "mbid", "left")
    kinds = songs.where("identity IS NOT NULL").groupBy("identity", *FACTS).agg(F.min("id").alias("song"))
    asked = files.where("identity IS NOT NULL").select("identity", *FACTS).distinct().withColumn("fact", F.struct(*FACTS))
    pairs = asked.join(kinds.select("identity", "song", *[F.col(f).alias(f"s_{f}") for f in FACTS]), "identity").withColumn("why", difference("s_", ""))
    of_identity = pairs.groupBy("identity", "fact").agg(F.min(F.when(F.col("why").isNull(), F.col("song"))).alias("same_song"), F.min("song").alias("first_song"), F.min_by("why", "song").alias("first_why"))
    rows = rows.withColumn("fact", F.struct(*FACTS)).join(of_identity, ["identity", "fact"], "left")
    stamped = (F.col("p.size0") == F.col("size")) & (F.abs(F.col("p.mtime0") - F.col("mtime")) < SAME_STAMP)
    changed = F.col("p.size0").isNotNull() & F.col("size").isNotNull() & ~F.coalesce(stamped, F.lit(False))
    same_code = F.coalesce("of_isrc", "of_mbid")
    action = (
        F.when(F.col("p").isNotNull(), "have").when(F.col("unsupported").isNotNull() | (F.coalesce(F.trim("title"), F.lit("")) == ""), "skip")
        .when(same_code.isNotNull() | F.col("same_song").isNotNull(), "duplicate").otherwise("new")
    )
    reason = F.when(F.col("p").isNotNull(), F.when(changed, "changed").when(F.col("p.size0").isNull(), "unrecorded").otherwise("unchanged"))
    reason = reason.when(F.col("unsupported").isNotNull(), F.col("unsupported")).when(action == "skip", "no title").when(F.col("of_isrc").isNotNull(), "same code").when(F.col("of_mbid").isNotNull(), "same recording").when(F.col("same_song").isNotNull(), "same version").otherwise(F.col("first_why"))
    song = F.when(F.col("p").isNotNull(), F.col("p.id")).when(action == "skip", F.lit(None)).otherwise(F.coalesce(same_code, "same_song", "first_song"))
    rows = settled(rows.select("place", "path", "path_key", "identity", *FACTS, action.alias("action"), song.alias("song_id"), reason.alias("reason")))

    # new files among themselves: the first of each version, then the first of each path. A path is taken only by a file that stays new, and versions count only those, so files that repeat a path go first.
    new = rows.where("action = 'new'")
    first_of_path = new.groupBy("path_key").agg(F.min("place").alias("taken"))
    new = new.join(first_of_path, "path_key")
    alone = new.where("place = taken")
    facts = alone.where("identity IS NOT NULL").groupBy("identity", *FACTS).agg(F.min("place").alias("first"))
    schema = facts.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",of:bigint"
    firsts = facts.repartition("identity").sortWithinPartitions("identity", "first").mapInArrow(_firsts, schema).select("identity", F.struct(*FACTS).alias("fact"), "of")
    alone = alone.withColumn("fact", F.struct(*FACTS)).join(firsts, ["identity", "fact"], "left").select("place", "taken", F.coalesce("of", "place").alias("of"))
    again = new.where("place > taken").join(alone.select("taken", F.col("of").alias("same")), "taken").select("place", "taken", F.coalesce("same", "taken").alias("of"))
    decided = alone.unionByName(again).where("of <> place").join(new.select(F.col("place").alias("of"), F.col("path").alias("first_path")), "of").select("place", "first_path")
    out = rows.join(decided, "place", "left").withColumn("batch", F.col("first_path").isNotNull())
    return out.select("place", "path", F.when(F.col("batch"), "batch").otherwise(F.col("action")).alias("action"), F.when(~F.col("batch"), F.col("song_id")).alias("song_id"), F.when(~F.col("batch"), F.col("reason")).alias("reason"), "first_path")


def sync_plan(scanned: DataFrame, library: DataFrame, members: DataFrame) -> DataFrame:
    """bucket, place, path, song_id and from_path: what a scan of one folder changes.

    ``members``: id, path, removed of the songs that belong to the folder; ``scanned`` and ``library`` as ``import_plan`` takes them. Files: "returned" (its song was removed), "changed", "unrecorded",
    "unchanged", "moved" (it is a missing song's file at another place; of several, the first in the scan, so no song is claimed twice), "to_review" (all else). Songs: "gone" (in the
    library, file missing, not claimed).
    """
    plan = import_plan(scanned, library)
    seen = plan.select(path_key(F.col("path")).alias("key")).distinct()
    m = members.select(F.col("id").alias("m_id"), F.col("path").alias("from_path"), F.coalesce("removed", F.lit(False)).alias("removed"))
    missing = m.where("from_path <> ''").withColumn("key", path_key(F.col("from_path"))).join(seen, "key", "left_anti").select("m_id", "from_path", "removed", F.lit(True).alias("missing"))
    known = settled(m.join(missing.select("m_id", "missing"), "m_id", "left"))
    rows = settled(plan.join(known, F.col("song_id") == F.col("m_id"), "left"))
    claims = rows.where("action = 'duplicate' AND missing").groupBy("song_id").agg(F.min("place").alias("claim"))
    rows = rows.join(claims, "song_id", "left")
    moved = F.coalesce((F.col("action") == "duplicate") & F.col("missing") & (F.col("place") == F.col("claim")), F.lit(False))
    bucket = F.when((F.col("action") == "have") & F.coalesce("removed", F.lit(False)), "returned").when(F.col("action") == "have", F.col("reason")).when(moved, "moved").otherwise("to_review")
    files = rows.select(bucket.alias("bucket"), "place", "path", "song_id", F.when(bucket == "moved", F.col("from_path")).alias("from_path"))
    gone = known.where("missing AND NOT removed").join(claims, F.col("m_id") == F.col("song_id"), "left_anti")
    return files.unionByName(gone.select(F.lit("gone").alias("bucket"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("path"), F.col("m_id").alias("song_id"), "from_path"))


# ---- folders to watch ----

#: Levels below a folder that are looked at: its own files; a parent's.
OWN_DEPTH, PARENT_DEPTH, LEAST_CHILDREN = 1, 3, 2


def parent_of(path: Column) -> Column:
    """Without the last part; null for a path of one part."""
    return F.nullif(F.regexp_extract(path, "^(.+)/[^/]+$", 1), F.lit(""))


def watched_folders(files: DataFrame, folders: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """path, depth, reason and songs of the folders to watch for new files.

    ``files``: path of each of the library's files; ``folders``: path of every folder that is there. A folder with files is watched; where two or more children of a folder have files, and they are half of its
    subfolders or more, it takes their place ("parent", with its own files), except where ``excluded`` (path) names it or it has no parent itself. A folder that another one watches as deep is left out.
    """
    there = folders.select("path").where("path <> ''").distinct()
    own = files.select(parent_of(F.col("path")).alias("path")).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("songs")).join(there, "path", "left_semi")
    own = settled(own.withColumn("parent", parent_of(F.col("path"))))
    below = there.select(parent_of(F.col("path")).alias("path")).groupBy("path").agg(F.count("*").alias("subfolders"))
    taken = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"), F.sum("songs").alias("theirs")).where(parent_of(F.col("path")).isNotNull())
    taken = taken.join(below, "path", "left").where((F.col("children") >= LEAST_CHILDREN) & (F.col("children") * 2 >= F.coalesce("subfolders", F.lit(0))))
    out = excluded.select("path").distinct() if excluded is not None else there.where("false")
    taken = settled(taken.join(out, "path", "left_anti").join(own.select("path", "songs"), "path", "left").select("path", (F.col("theirs") + F.coalesce("songs", F.lit(0))).alias("songs")))
    left = own.join(taken.select(F.col("path").alias("parent")), "parent", "left_anti").join(out, "path", "left_anti")
    both = taken.select("path", F.lit(PARENT_DEPTH).alias("depth"), F.lit("parent").alias("reason"), "songs").unionByName(left.select("path", F.lit(OWN_DEPTH).alias("depth"), F.lit("audio").alias("reason"), "songs"))
    both = settled(both)
    # a folder above covers what lies as deep as it is watched; the same folder as parent covers itself as one with files
    inner = both.withColumn("parts", F.split("path", "/"))
    above = inner.select("path", "depth", F.explode(F.sequence(F.lit(0), F.least(F.lit(PARENT_DEPTH), F.size("parts") - 1))).alias("up"), "parts")
    above = above.select("path", "depth", "up", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("up")), "/").alias("outer"))
    outer = both.select(F.col("path").alias("outer"), F.col("depth").alias("outer_depth"))
    covered = above.join(outer, "outer").where(((F.col("up") == 0) & (F.col("outer_depth") > F.col("depth"))) | ((F.col("up") > 0) & (F.col("outer_depth") >= F.col("up") + F.col("depth")))).select("path", "depth").distinct()
    return both.join(covered, ["path", "depth"], "left_anti").select("path", F.col("depth").cast("long").alias("depth"), "reason", "songs")


# ---- merging two libraries ----

#: Ids of a bucket, within which rows are numbered together.
BUCKET_BITS = 16


def numbered_after(rows: DataFrame, key: str, last: int, name: str) -> DataFrame:
    """``rows`` with ``name``: gapless numbers after ``last`` in the order of ``key`` (a distinct whole number), by buckets of keys and their sums."""
    rows = rows.withColumn("_bucket", F.shiftright(F.col(key).cast("long"), BUCKET_BITS))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"))  # one row for each 65,536 ids
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return rows.withColumn("_nth", nth).join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_nth") + last).drop("_bucket", "_nth", "_start")


def merge_libraries(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The target's tables with the source's rows that it lacks, under new numbers wherever they are named.

    Tables: songs (id, title, artist, album_id, path), albums (id, title, artist), people (id, name), lines (id, song_id, ...), credits (song_id, person_id, role, ...), plays (song_id, ...); either side may lack
    all but songs. People are the same by the key of their name, albums by those of title and artist, songs by those of artist and title (neither blank) or by path; of songs that the source repeats
    the first comes, by key and then by path. A song that comes takes its lines, credits and plays along; one that is there takes nothing. So running it twice adds nothing.
    """

    def keyed(rows: DataFrame, *columns: str) -> DataFrame:
        keys = [names.key_of(F.coalesce(c, F.lit(""))) for c in columns]
        rows = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
        return rows.withColumn("_key", F.concat_ws("\x1f", *[f"_k{i}" for i in range(len(keys))])).drop(*[f"_k{i}" for i in range(len(keys))])

    def last_id(rows: DataFrame) -> int:
        return rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def united(name: str, fresh: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """A table with its new rows, and old and new number of each of the source's rows."""
        mine, theirs = settled(keyed(target[name], *columns)), settled(keyed(fresh, *columns))
        there = mine.groupBy("_key").agg(F.min("id").alias("_there"))
        new = theirs.join(there, "_key", "left_anti").groupBy("_key").agg(F.min("id").alias("_first"))
        new = settled(numbered_after(new, "_first", last_id(mine), "_new"))
        numbers = there.unionByName(new.select("_key", F.col("_new").alias("_there")))
        ids = settled(theirs.select(F.col("id").alias("_old"), "_key").join(numbers, "_key").select("_old", F.col("_there").alias("_new")))
        added = theirs.join(new.select(F.col("_first").alias("id"), "_new"), "id").withColumn("id", F.col("_new"))
        return target[name].unionByName(added.select(*target[name].columns)), ids

    out = dict(target)
    mine, theirs = settled(keyed(target["songs"], "artist", "title")), settled(keyed(source["songs"], "artist", "title"))
    paths = mine.where("path <> ''").select("path").distinct()
    nameless = F.col("_key").startswith("\x1f") | F.col("_key").endswith("\x1f")
    theirs = theirs.withColumn("_key", F.when(nameless, F.concat(F.lit("\x02"), F.col("id").cast("string"))).otherwise(F.col("_key")))
    coming = theirs.join(mine.select("_key").distinct(), "_key", "left_anti").join(paths, "path", "left_anti")
    coming = coming.groupBy("_key").agg(F.min("id").alias("_old"), F.min_by("path", "id").alias("path"))
    coming = coming.groupBy(F.when(F.col("path") != "", F.col("path")).otherwise(F.concat(F.lit("\x02"), "_key")).alias("_path")).agg(F.min("_old").alias("_old"))
    song_ids = settled(numbered_after(coming, "_old", last_id(mine), "_new").select("_old", "_new"))
    songs = source["songs"].join(song_ids, F.col("id") == F.col("_old"))
    if "albums" in target and "albums" in source:
        needed = source["albums"].join(songs.select(F.col("album_id").alias("id")).distinct(), "id", "left_semi")
        out["albums"], album_ids = united("albums", needed, "title", "artist")
        renamed = album_ids.select(F.col("_old").alias("_album"), F.col("_new").alias("_new_album"))
        songs = songs.join(renamed, F.col("album_id") == F.col("_album"), "left").withColumn("album_id", F.col("_new_album"))
    out["songs"] = target["songs"].unionByName(songs.withColumn("id", F.col("_new")).select(*target["songs"].columns))
    along = lambda name: source[name].join(song_ids.withColumnsRenamed({"_old": "_song", "_new": "_new_song"}), F.col("song_id") == F.col("_song")).withColumn("song_id", F.col("_new_song"))
    if "people" in target and "people" in source:
        out["people"], people_ids = united("people", source["people"], "name")
        if "credits" in target and "credits" in source:
            moved = along("credits").join(people_ids, F.col("person_id") == F.col("_old")).withColumn("person_id", F.col("_new"))
            out["credits"] = target["credits"].unionByName(moved.select(*target["credits"].columns).distinct())
    if "lines" in target and "lines" in source:
        lines = numbered_after(along("lines"), "id", last_id(target["lines"]), "_line")
        out["lines"] = target["lines"].unionByName(lines.withColumn("id", F.col("_line")).select(*target["lines"].columns))
    if "plays" in target and "plays" in source:
        out["plays"] = target["plays"].unionByName(along("plays").select(*target["plays"].columns))
    return out
