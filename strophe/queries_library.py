"""Registered queries of importing, syncing, watching and merging: orders are a library's songs, line items the files of a scan, pages a tree of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import importing
from strophe.queries import query
from strophe.sources import tables as T


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"), text("/music/", cust % 50, "/", key, ".flac").alias("path"), text("Song ", cust % 400).alias("title"), text("Artist ", key % 40).alias("artist"),
        F.when(F.col("o_orderstatus") == "P", "Live").otherwise("").alias("album"), F.when(key % 3 == 0, text("jp-A", key)).otherwise("").alias("isrc"), F.lit("").alias("mbid"), (100.0 + cust % 5 * 2).alias("duration_sec"), F.when(key % 11 != 0, cust).alias("size"), F.unix_timestamp("o_orderdate").cast("double").alias("mtime"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, songs = T.table(spark, sf_dir, "lineitem"), library(spark, sf_dir).select(F.col("id").alias("l_orderkey"), F.col("path").alias("at"), F.col("isrc").alias("code"), "size", "mtime")
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    new = text("/new/", F.col("l_suppkey") % 50, "/", key, "-", F.floor(line / 2), ".flac")
    title = F.when(line == 4, "").otherwise(text("Song ", F.col("l_partkey") % 400))
    return item.join(songs, "l_orderkey").select(
        (((key * 8 + line) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).cast("long").alias("place"), F.when(line == 1, F.col("at")).otherwise(new).alias("path"), title.alias("title"), text("Artist ", F.col("l_suppkey") % 40).alias("artist"), F.when(F.col("l_returnflag") == "R", "Live").otherwise("").alias("album"),
        F.when(line == 2, F.col("code")).otherwise("").alias("isrc"), F.lit("").alias("mbid"), (100.0 + F.col("l_partkey") % 7 * 2).alias("duration_sec"), (F.col("size") + F.when(F.col("l_returnflag") == "A", 0).otherwise(1)).alias("size"), "mtime", F.when(line == 6, "codec").alias("unsupported"),
    )


PLAN_SQL = """
WITH lib AS (SELECT o_orderkey AS id, '/music/' || (o_custkey % 50) || '/' || o_orderkey || '.flac' AS path, (o_custkey % 400) AS song, o_orderstatus = 'P' AS live, o_orderkey % 40 AS artist, CASE WHEN o_orderkey % 3 = 0 THEN 'JPA' || o_orderkey ELSE '' END AS isrc,
    100.0 + o_custkey % 5 * 2 AS sec, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS size FROM orders),
files AS MATERIALIZED (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS place, CASE WHEN l_linenumber = 1 THEN lib.path ELSE '/new/' || (l_suppkey % 50) || '/' || l_orderkey || '-' || (l_linenumber // 2) || '.flac' END AS path,
    l_linenumber AS line, l_partkey % 400 AS song, l_returnflag = 'R' AS live, l_suppkey % 40 AS artist, CASE WHEN l_linenumber = 2 THEN isrc ELSE '' END AS isrc, 100.0 + l_partkey % 7 * 2 AS sec, lib.size + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS size, lib.id AS lib_id, lib.size AS size0 FROM lineitem JOIN lib ON l_orderkey = lib.id),
cand AS (SELECT f.place, min(l.id) AS first_song, arg_min(CASE WHEN f.isrc <> '' AND l.isrc <> '' AND f.isrc <> l.isrc THEN 'code' WHEN f.live <> l.live THEN 'version' WHEN abs(f.sec - l.sec) > 3 THEN 'duration' END, l.id) AS first_why,
    min(CASE WHEN NOT (f.isrc <> '' AND l.isrc <> '' AND f.isrc <> l.isrc) AND f.live = l.live AND abs(f.sec - l.sec) <= 3 THEN l.id END) AS same_song FROM files f JOIN lib l ON f.song = l.song AND f.artist = l.artist GROUP BY f.place),
w AS (SELECT d.first_why AS why0, x.isrc AS of_isrc, f.*, first_song, same_song FROM files f LEFT JOIN cand d USING (place) LEFT JOIN (SELECT DISTINCT isrc FROM lib WHERE isrc <> '') x ON x.isrc = f.isrc),
v AS (SELECT w.*, (SELECT NULL) AS n, CASE WHEN line = 1 THEN 'have' WHEN line IN (4, 6) THEN 'skip' WHEN of_isrc IS NOT NULL OR same_song IS NOT NULL THEN 'duplicate' ELSE 'new' END AS action FROM w),
r AS MATERIALIZED (SELECT *, CASE action WHEN 'have' THEN CASE WHEN size0 IS NULL THEN 'unrecorded' WHEN size <> size0 THEN 'changed' ELSE 'unchanged' END WHEN 'skip' THEN CASE line WHEN 6 THEN 'codec' ELSE 'no title' END WHEN 'duplicate' THEN CASE WHEN of_isrc IS NOT NULL THEN 'same code' ELSE 'same version' END ELSE why0 END AS reason,
    CASE action WHEN 'have' THEN lib_id WHEN 'skip' THEN NULL WHEN 'duplicate' THEN CASE WHEN of_isrc IS NOT NULL THEN lib_id ELSE same_song END ELSE first_song END AS song_id FROM v),
t AS (SELECT *, min(place) OVER (PARTITION BY path) AS taken FROM r WHERE action = 'new'),
q AS (SELECT song, artist, live, list([place::DOUBLE, sec] ORDER BY place) AS x FROM (SELECT song, artist, live, sec, min(place) AS place FROM t WHERE place = taken GROUP BY ALL) GROUP BY ALL),
k AS (SELECT song, artist, live, list_reduce(x, lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: abs(z[2] - y[2]) <= 3)) > 0 THEN acc ELSE list_append(acc, y) END, []::DOUBLE[][]) AS kept FROM q),
o AS (SELECT t.place, t.taken, list_filter(kept, lambda z: abs(z[2] - t.sec) <= 3)[1][1]::BIGINT AS first FROM t JOIN k USING (song, artist, live) WHERE place = taken),
b AS (SELECT t.place, o.first FROM t JOIN o ON o.place = t.taken WHERE o.first <> t.place),
plan AS MATERIALIZED (SELECT r.place, r.path, CASE WHEN b.place IS NULL THEN r.action ELSE 'batch' END AS action, CASE WHEN b.place IS NULL THEN r.song_id END AS song_id, CASE WHEN b.place IS NULL THEN r.reason END AS reason, p.path AS first_path FROM r LEFT JOIN b USING (place) LEFT JOIN r p ON p.place = b.first)"""


@query(PLAN_SQL + " SELECT place::BIGINT AS place, path, action, coalesce(song_id, -1)::BIGINT AS song_id, reason, first_path FROM plan")
def dd_import_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action for each file of the scan."""
    return importing.import_plan(scan(spark, sf_dir), library(spark, sf_dir)).withColumn("song_id", F.coalesce("song_id", F.lit(-1)))


@query(PLAN_SQL + """,
m AS (SELECT id, path, id % 5 = 0 AS removed, path NOT IN (SELECT path FROM files) AS missing FROM lib),
c AS (SELECT song_id, min(place) AS claim FROM plan JOIN m ON m.id = song_id WHERE action = 'duplicate' AND missing GROUP BY song_id)
SELECT CASE WHEN action = 'have' AND removed THEN 'returned' WHEN action = 'have' THEN reason WHEN action = 'duplicate' AND place = claim THEN 'moved' ELSE 'to_review' END AS bucket, place::BIGINT AS place, plan.path AS path, coalesce(plan.song_id, -1)::BIGINT AS song_id,
    CASE WHEN action = 'duplicate' AND place = claim THEN m.path END AS from_path FROM plan LEFT JOIN m ON m.id = plan.song_id LEFT JOIN c ON c.song_id = plan.song_id
UNION ALL SELECT 'gone', -1, NULL, id, path FROM m WHERE missing AND NOT removed AND id NOT IN (SELECT song_id FROM c)""")
def dd_sync_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan changes, for each file and each missing song; a fifth of the songs were removed before."""
    songs = library(spark, sf_dir)
    out = importing.sync_plan(scan(spark, sf_dir), songs, songs.select("id", "path", (F.col("id") % 5 == 0).alias("removed")))
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("place", "song_id")})


@query(r"""
WITH p AS (SELECT '/' || array_to_string(list_reverse(string_split(regexp_extract(url, '^\w+://([^/]+)', 1), '.')), '/') || '/' || regexp_extract(html, '<html lang="([a-z]+)"', 1) AS dir, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages),
chain AS (WITH RECURSIVE up AS (SELECT dir AS path FROM p UNION SELECT regexp_extract(path, '^(.+)/[^/]+$', 1) FROM up WHERE path <> '') SELECT path FROM up WHERE path <> ''),
par AS (SELECT path, nullif(regexp_extract(path, '^(.+)/[^/]+$', 1), '') AS parent FROM chain),
own AS (SELECT dir AS path, count(*) AS songs, nullif(regexp_extract(dir, '^(.+)/[^/]+$', 1), '') AS parent FROM p WHERE lang <> 'de' GROUP BY dir),
sub AS (SELECT parent AS path, count(*) AS n FROM par GROUP BY parent),
taken AS (SELECT o.parent AS path, sum(o.songs) + coalesce(any_value(self.songs), 0) AS songs FROM own o LEFT JOIN own self ON self.path = o.parent LEFT JOIN sub ON sub.path = o.parent JOIN par ON par.path = o.parent AND par.parent IS NOT NULL
    GROUP BY o.parent HAVING count(*) >= 2 AND count(*) * 2 >= any_value(n)),
alls AS (SELECT path, 3 AS depth, 'parent' AS reason, songs FROM taken UNION ALL SELECT path, 1, 'audio', songs FROM own WHERE parent IS NULL OR parent NOT IN (SELECT path FROM taken))
SELECT path, depth::BIGINT AS depth, reason, songs::BIGINT AS songs FROM alls i WHERE NOT EXISTS (SELECT 1 FROM alls o WHERE (o.path = i.path AND o.depth > i.depth)
    OR (starts_with(i.path, o.path || '/') AND o.depth >= len(string_split(substr(i.path, length(o.path) + 2), '/')) + i.depth))""")
def dd_watch_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders to watch in the tree of hosts and languages, where pages that aren't German are the library's."""
    p = T.table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", r"^\w+://([^/]+)", 1), r"\.")), "/")
    dirs = p.select(F.concat(F.lit("/"), host, F.lit("/"), lang).alias("dir"), lang.alias("lang"), F.col("page_id").cast("string").alias("name"))
    parts = F.split("dir", "/")
    folders = dirs.select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    return importing.watched_folders(dirs.where("lang <> 'de'").select(F.concat_ws("/", "dir", "name").alias("path")), folders)


MERGE_SQL = """
WITH s AS (SELECT o_orderkey AS id, 'Song ' || (o_custkey % 400) AS title, 'Artist ' || (o_orderkey % 40) AS artist, o_custkey AS album_id, '/f/' || (o_orderkey % 9000) AS path, o_orderstatus <> 'O' AS mine FROM orders),
t AS (SELECT * FROM s WHERE mine), x AS (SELECT * FROM s WHERE NOT mine),
y AS (SELECT * FROM x WHERE (title, artist) NOT IN (SELECT (title, artist) FROM t) AND path NOT IN (SELECT path FROM t) QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY id) = 1),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY path ORDER BY id) = 1),
m AS (SELECT *, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id) AS new_id FROM z),
alb AS (SELECT c_custkey AS id, 'Album ' || (c_custkey % 700) AS title, 'Of ' || c_nationkey AS artist, c_acctbal < 4000 AS mine FROM customer),
na AS (SELECT title, artist, min(id) AS first FROM alb WHERE NOT mine AND id IN (SELECT album_id FROM m) AND (title, artist) NOT IN (SELECT (title, artist) FROM alb WHERE mine) GROUP BY ALL),
aid AS (SELECT title, artist, min(id) AS id FROM alb WHERE mine GROUP BY ALL UNION ALL SELECT title, artist, (SELECT max(id) FROM alb WHERE mine) + row_number() OVER (ORDER BY first) FROM na),
per AS (SELECT s_suppkey AS id, 'Person ' || (s_suppkey % 60) AS name, s_acctbal < 4000 AS mine FROM supplier),
np AS (SELECT name, min(id) AS first FROM per WHERE NOT mine AND name NOT IN (SELECT name FROM per WHERE mine) GROUP BY name),
pid AS (SELECT name, min(id) AS id FROM per WHERE mine GROUP BY name UNION ALL SELECT name, (SELECT max(id) FROM per WHERE mine) + row_number() OVER (ORDER BY first) FROM np),
cr AS (SELECT DISTINCT l_orderkey AS song_id, l_suppkey AS person_id, l_returnflag AS role FROM lineitem),
ln AS (SELECT min(l_partkey) AS part, l_orderkey * 8 + l_linenumber AS id, l_orderkey AS song_id FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT 'songs' AS kind, id::BIGINT AS id, coalesce(album_id, -1)::BIGINT AS ref, title || '|' || artist AS said FROM t UNION ALL SELECT 'songs', new_id, coalesce(aid.id, -1), m.title || '|' || m.artist FROM m LEFT JOIN alb ON alb.id = m.album_id AND NOT alb.mine LEFT JOIN aid ON aid.title = alb.title AND aid.artist = alb.artist
UNION ALL SELECT 'albums', id, -1, title || '|' || artist FROM alb WHERE mine UNION ALL SELECT 'albums', aid.id, -1, title || '|' || artist FROM aid SEMI JOIN na ON na.title = aid.title AND na.artist = aid.artist
UNION ALL SELECT 'people', id, -1, name FROM per WHERE mine UNION ALL SELECT 'people', pid.id, -1, name FROM pid SEMI JOIN np ON np.name = pid.name
UNION ALL SELECT 'credits', song_id, person_id, role FROM cr WHERE song_id IN (SELECT id FROM t) AND person_id IN (SELECT id FROM per WHERE mine)
UNION ALL SELECT DISTINCT 'credits', m.new_id, pid.id, role FROM cr JOIN m ON m.id = cr.song_id JOIN per ON per.id = person_id AND NOT per.mine JOIN pid ON pid.name = per.name
UNION ALL SELECT 'lines', id, song_id, part::VARCHAR FROM ln WHERE song_id IN (SELECT id FROM t)
UNION ALL SELECT 'lines', (SELECT max(id) FROM ln WHERE song_id IN (SELECT id FROM t)) + row_number() OVER (ORDER BY ln.id), m.new_id, part::VARCHAR FROM ln JOIN m ON m.id = ln.song_id"""


def two_libraries(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Orders that are done and those that are open, with their customers as albums, suppliers as people and line items as lines and credits."""
    table = lambda name: T.table(spark, sf_dir, name)
    key = F.col("o_orderkey")
    songs = table("orders").select(key.alias("id"), text("Song ", F.col("o_custkey") % 400).alias("title"), text("Artist ", key % 40).alias("artist"), F.col("o_custkey").alias("album_id"), text("/f/", key % 9000).alias("path"), "o_orderstatus")
    albums = table("customer").select(F.col("c_custkey").alias("id"), text("Album ", F.col("c_custkey") % 700).alias("title"), text("Of ", F.col("c_nationkey")).alias("artist"), "c_acctbal")
    people = table("supplier").select(F.col("s_suppkey").alias("id"), text("Person ", F.col("s_suppkey") % 60).alias("name"), "s_acctbal")
    item = table("lineitem")
    credits = item.select(F.col("l_orderkey").alias("song_id"), F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("role")).distinct()
    lines = item.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("song_id"), "part")
    sides = []
    for mine in (True, False):
        s = songs.where((F.col("o_orderstatus") != "O") == mine).drop("o_orderstatus")
        p = people.where((F.col("s_acctbal") < 4000) == mine).drop("s_acctbal")
        ids = s.select(F.col("id").alias("song_id"))
        sides.append({"songs": s, "albums": albums.where((F.col("c_acctbal") < 4000) == mine).drop("c_acctbal"), "people": p, "credits": credits.join(ids, "song_id", "left_semi").join(p.select(F.col("id").alias("person_id")), "person_id", "left_semi"), "lines": lines.join(ids, "song_id", "left_semi")})
    return sides[0], sides[1]


@query(MERGE_SQL)
def mnt_merge_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two libraries as one, its five tables as rows of kind, number, what it refers to, and what it says."""
    t = importing.merge_libraries(*two_libraries(spark, sf_dir))
    row = lambda kind, id_, ref, said: t[kind].select(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), F.coalesce(ref.cast("long"), F.lit(-1)).alias("ref"), said.cast("string").alias("said"))
    none, both = F.lit(None), F.concat_ws("|", "title", "artist")
    rows = [row("songs", F.col("id"), F.col("album_id"), both), row("albums", F.col("id"), none, both), row("people", F.col("id"), none, F.col("name")), row("credits", F.col("song_id"), F.col("person_id"), F.col("role")), row("lines", F.col("id"), F.col("song_id"), F.col("part"))]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
