"""Registered queries of logs: shipments are versions of songs, events are corrections of lines and entries about members of bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import history
from strophe.queries import query, with_
from strophe.sources import tables as T

VERSIONS_SQL = """
WITH log AS (SELECT l_orderkey AS song_id, l_shipdate AS made, l_linenumber * 1000000 + l_partkey AS id, l_returnflag AS content FROM lineitem),
h AS (SELECT *, row_number() OVER w AS version_no, lead(made) OVER w AS valid_to, lag(content) OVER w AS before FROM log WINDOW w AS (PARTITION BY song_id ORDER BY made, id))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_shipdate").alias("at"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("content"))
    return history.version_history(log)


@query(VERSIONS_SQL + """
SELECT song_id, version_no, id, strftime(made, '%Y-%m-%d') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, content, CASE version_no WHEN 1 THEN 'attached' ELSE 'replaced' END AS kind, version_no > 1 AND content IS DISTINCT FROM before AS changed, version_no = max(version_no) OVER (PARTITION BY song_id) AS is_current FROM h""")
def lin_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of every song with the time in which each held."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return versions(spark, sf_dir).select("song_id", "version_no", "id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to"), "content", "kind", F.coalesce("changed", F.lit(False)).alias("changed"), "is_current")


@query(VERSIONS_SQL + " SELECT song_id, max(version_no)::BIGINT AS version_no, arg_max(content, version_no) AS content FROM h WHERE made <= TIMESTAMP '1998-01-01' GROUP BY song_id")
def lin_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song as it was at the beginning of 1998."""
    return history.as_of(versions(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("song_id", "version_no", "content")


ENTRIES_SQL = """
WITH log AS (SELECT user_id AS band, event_id % 12 AS member, ts AS made, event_id AS id, CASE event_type WHEN 'error' THEN 'reject' ELSE 'put' END AS action, CASE WHEN event_type IN ('error', 'purchase') THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END AS rank FROM events)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = T.table(spark, sf_dir, "events"), F.col("event_type")
    source = F.when(kind.isin("purchase", "error"), "manual").when(kind == "click", "confirmed").otherwise("musicbrainz")
    return e.select(F.col("user_id").alias("band"), (F.col("event_id") % 12).alias("member"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(kind == "error", "reject").otherwise("put").alias("action"), source.alias("source"))


# the state after each entry, one after another: id, rank and refusal of what holds
@query(ENTRIES_SQL + """,
l AS (SELECT band, member, list({'id': id, 'rank': rank, 'no': action = 'reject'} ORDER BY made, id) AS x FROM log GROUP BY ALL),
s AS (SELECT band, member, list_reduce(x, lambda a, b: CASE WHEN b.no OR b.rank = 2 OR (NOT a.no AND b.rank >= a.rank) THEN b ELSE a END) AS held FROM l)
SELECT band, member, held.id AS id, held.rank::BIGINT AS rank FROM s WHERE NOT held.no""")
def mem_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds about each member of each band after all entries."""
    out = history.members(entries(spark, sf_dir), ["band", "member"])
    return out.select("band", "member", "id", F.when(F.col("source") == "manual", 2).when(F.col("source") == "confirmed", 1).otherwise(0).cast("long").alias("rank"))


@query(ENTRIES_SQL + """,
l AS (SELECT band, member, list({'id': id, 'rank': rank, 'no': action = 'reject', 'out': 'inserted'} ORDER BY made, id) AS x FROM log GROUP BY ALL),
s AS (SELECT unnest(list_reduce(list_transform(x, lambda b: [b]), lambda a, c: CASE
    WHEN c[1].no OR c[1].rank = 2 THEN list_append(a, struct_update(c[1], out := 'updated'))
    WHEN list_filter(a, lambda z: z.out IN ('inserted', 'updated'))[-1].no THEN list_append(a, struct_update(c[1], out := 'rejected'))
    WHEN list_filter(a, lambda z: z.out IN ('inserted', 'updated'))[-1].rank > c[1].rank THEN list_append(a, struct_update(c[1], out := 'kept'))
    ELSE list_append(a, struct_update(c[1], out := 'updated')) END)) AS r FROM l)
SELECT r.id AS id, r.out AS outcome FROM s""")
def mem_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each entry when it came."""
    return history.put_outcomes(entries(spark, sf_dir), ["band", "member"]).select("id", "outcome")


CORRECTIONS_SQL = """
WITH c AS (SELECT user_id * 40 + event_id % 40 AS line_id, arg_max({'a': event_type, 'id': event_id, 'v': value}, (ts, event_id)) AS e FROM events WHERE event_type IN ('purchase', 'click', 'error') {when} GROUP BY ALL)
SELECT line_id, e.id AS id, round(e.v, 6) AS value FROM c WHERE e.a <> 'error'"""


def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click', 'error')")
    text = F.col("event_id").cast("string")
    return e.select((F.col("user_id") * 40 + F.col("event_id") % 40).alias("line_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "revert").otherwise("save").alias("action"), F.array(text, F.col("value").cast("string")).alias("tokens"), text.alias("text"), F.lit("").alias("artist"), F.lit("").alias("title"))


@query(CORRECTIONS_SQL.replace("{when}", "AND ts <= TIMESTAMP '2024-01-15'"))
def corr_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections that held in the middle of the month."""
    out = history.corrections_as_of(correction_log(spark, sf_dir), F.lit("2024-01-15").cast("timestamp"))
    return out.select("line_id", F.col("tokens")[0].cast("long").alias("id"), F.round(F.col("tokens")[1].cast("double"), 6).alias("value"))


@query(with_("lines") + """,
old AS (SELECT artist, language, text, song_id * 100000 + line_idx AS id FROM lines WHERE line_idx % 3 = 1),
x AS (SELECT artist, language, text, max(id) AS id FROM old GROUP BY ALL),
f AS (SELECT artist, language, trim(text) AS folded, arg_max(id, (text, id)) AS id FROM old GROUP BY ALL),
n AS (SELECT artist, language, text, line_idx, song_id * 100000 + line_idx + 50000 AS id FROM lines),
m AS (SELECT n.id AS line_id, n.line_idx, coalesce(x.id, f.id) AS old FROM n LEFT JOIN x ON x.artist = n.artist AND x.language = n.language AND x.text = n.text LEFT JOIN f ON f.artist = n.artist AND f.language = n.language AND f.folded = trim(n.text))
SELECT line_id, old AS old_line_id, row_number() OVER (PARTITION BY old ORDER BY line_idx, line_id) = 1 AS moved FROM m WHERE old IS NOT NULL AND old <> line_id""")
def corr_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line's correction, found again by its text after all lines of its source and language came anew."""
    lines = T.lines(spark, sf_dir).select((F.col("song_id") * 100_000 + F.col("line_idx")).alias("line_id"), "line_idx", "text", "artist", F.col("language").alias("title"))
    old = lines.where("line_idx % 3 = 1").withColumn("tokens", F.array("text"))
    return history.restored(old, lines.withColumn("line_id", F.col("line_id") + 50_000)).select("line_id", "old_line_id", "moved")
