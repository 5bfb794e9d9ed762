"""Registered queries of the matching operators: pages are tracks (title of the page, host, language), each looked for among the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import names
from strophe.operators import matching
from strophe.plans.pairs import met_within
from strophe.plans.rounds import settled
from strophe.queries import query
from strophe.sources import tables as T


def page_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, artist (host without its first part), album (language), duration_sec, track_number, year, provider."""
    p = T.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^\w+://([^/]+)", 1)
    return p.select(
        F.col("page_id").alias("id"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("artist"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("album"),
        (F.length("html") / 100.0).alias("duration_sec"), F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1).try_cast("long").alias("track_number"), F.lit("").alias("year"), F.lit(1.0).alias("provider"),
    )


def plain_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")


NAMES_SQL = r"WITH names AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1, 's')), '[^\p{L}\p{N}]+', '', 'g') AS name FROM pages),"


@query(NAMES_SQL + """
g AS (SELECT name, length(name) AS n, unnest(list_transform(range(1, length(name) + 2), lambda i: substr(chr(2) || name || chr(3), i, 2))) AS gram FROM names WHERE name <> ''),
c AS (SELECT name, n, gram, count(*) AS c FROM g GROUP BY ALL),
s AS (SELECT x.name AS a, y.name AS b, x.n AS n, y.n AS m, sum(least(x.c, y.c)) AS shared FROM c x JOIN c y ON x.gram = y.gram AND x.name < y.name GROUP BY ALL)
SELECT a, b, shared::BIGINT AS shared FROM s WHERE shared >= ceil(0.4 * (n + m) - 1e-9) * 3 + 1 - (n + m) AND greatest(n, m) <= floor(1.5 * least(n, m) + 1e-9)""")
def er_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page titles that share as many pairs of letters as a ratio of 0.8 needs."""
    return matching.similar_names(page_tracks(spark, sf_dir).select(plain_key(F.col("title")).alias("name")))


@query(NAMES_SQL + """
w AS (SELECT DISTINCT name FROM names WHERE name <> '' UNION SELECT DISTINCT regexp_replace(lower(string_split(text, '.')[1]), '[^\\p{L}\\p{N}]+', '', 'g') FROM documents)
SELECT s.name AS short, l.name AS long FROM w s JOIN w l ON length(s.name) >= 2 AND length(s.name) < length(l.name) AND contains(l.name, s.name) AND length(s.name) >= 0.3 * length(l.name)""")
def er_contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page titles and first sentences of documents, of which one holds the other."""
    first = T.table(spark, sf_dir, "documents").select(plain_key(F.element_at(F.split("text", r"\."), 1)).alias("name"))
    return matching.contained_names(page_tracks(spark, sf_dir).select(plain_key(F.col("title")).alias("name")).unionByName(first))


@query()
def er_title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles by the ladder of scores, each with itself and with the titles after it; tests compare with all pairs."""
    titles = settled(page_tracks(spark, sf_dir).select("title").distinct())
    keys = settled(names.normalized(titles, "title", "title").select("title_key", "title_base").distinct())
    pairs = matching.title_pairs(keys, keys).where("want_key <= got_key")
    sides = [keys.select(*[F.col(c).alias(f"{s}_{c}") for c in keys.columns]) for s in ("want", "got")]
    met = pairs.join(sides[0], F.col("want_key") == F.col("want_title_key")).join(sides[1], F.col("got_key") == F.col("got_title_key"))
    out = met.select("want_key", "got_key", F.round(matching.title_similarity("want_title", "got_title"), 4).alias("title_score"))
    return out.groupBy("want_key", "got_key").agg(F.max("title_score").alias("title_score"))


@query()
def er_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other pages for each page."""
    tracks = page_tracks(spark, sf_dir)
    return matching.matches(tracks, tracks, 5)


@query()
def er_query_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask for each page, the most precise query first."""
    return matching.search_queries(page_tracks(spark, sf_dir))


@query("""WITH names AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1, 's')), '[^a-z0-9]+', '', 'g') AS name FROM pages)
SELECT x.name AS a, y.name AS b, round(jaro_winkler_similarity(x.name, y.name), 6) AS similarity FROM names x JOIN names y ON x.name < y.name AND left(x.name, 3) = left(y.name, 3) WHERE x.name <> ''""")
def er_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct page titles (plain letters) with the same three first letters."""
    keys = page_tracks(spark, sf_dir).select(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "").alias("name")).where("name <> ''").distinct().withColumn("first", F.left("name", F.lit(3)))
    met = met_within(settled(keys), "first", "name").select(F.col("x_name").alias("a"), F.col("y_name").alias("b"))
    return met.select("a", "b", F.round(matching.jaro_winkler("a", "b"), 6).alias("similarity"))
