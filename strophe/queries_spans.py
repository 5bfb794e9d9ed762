"""Registered queries of alignments within lines: documents' lines in two tokenisations, conversations as timed songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import spans
from strophe.plans import stream
from strophe.queries import query, with_
from strophe.sources import tables as T

BLANK = r"[\x20\x09-\x0D]+"
WORDS_SQL = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
TOKENS_SQL = rf"regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}]')"
# without blanks both tokenisations tile a line, so places among its other characters are sums of lengths
PLACED_SQL = with_("lines") + f""",
a AS (SELECT song_id, line_idx, generate_subscripts(x, 1) - 1 AS idx, unnest(x) AS surface FROM (SELECT *, {WORDS_SQL} AS x FROM lines)),
b AS (SELECT song_id, line_idx, generate_subscripts(x, 1) - 1 AS idx, unnest(x) AS surface FROM (SELECT *, {TOKENS_SQL} AS x FROM lines)),
pa AS MATERIALIZED (SELECT *, sum(length(surface)) OVER (PARTITION BY song_id, line_idx ORDER BY idx) AS stop FROM a),
pb AS MATERIALIZED (SELECT *, sum(length(surface)) OVER (PARTITION BY song_id, line_idx ORDER BY idx) AS stop FROM b)"""


def two_tokenisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words (by blanks) and tokens (runs of letters and digits, and other signs)."""
    lines = T.lines(spark, sf_dir).select("song_id", "line_idx", "text")
    token = stream.TOKEN.replace(r"\s", r"\x20\x09-\x0D")
    return lines.select("*", F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"), F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("tokens"))


@query(PLACED_SQL + """
SELECT pa.song_id, pa.line_idx, pa.idx::BIGINT AS idx, any_value(pa.surface) AS surface, min(pb.idx)::BIGINT AS first, max(pb.idx)::BIGINT AS last
FROM pa JOIN pb ON pa.song_id = pb.song_id AND pa.line_idx = pb.line_idx AND pb.stop - length(pb.surface) < pa.stop AND pb.stop > pa.stop - length(pa.surface) GROUP BY ALL""")
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of each line of the documents with the tokens that it is made of."""
    out = spans.align_tokens(two_tokenisations(spark, sf_dir), ["song_id", "line_idx"], "words", "tokens")
    return out.select("song_id", "line_idx", "idx", "surface", "first", "last")


@query(PLACED_SQL + """,
w AS (SELECT DISTINCT surface FROM pa)
SELECT pb.song_id, count(*) AS tokens, count(pa.idx) AS context, count(*) FILTER (WHERE pa.idx IS NULL AND w.surface IS NOT NULL) AS alone, count(*) FILTER (WHERE pa.idx IS NULL AND w.surface IS NULL) AS unknown
FROM pb LEFT JOIN pa ON pa.song_id = pb.song_id AND pa.line_idx = pb.line_idx AND pa.stop = pb.stop AND pa.surface = pb.surface LEFT JOIN w ON w.surface = pb.surface GROUP BY pb.song_id""")
def mnt_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each document take what is known of a word: of the word at their place, of the same word elsewhere, or nothing."""
    lines = two_tokenisations(spark, sf_dir).withColumn("analysed", F.transform("words", lambda w: F.struct(w.alias("surface"), F.upper(w).alias("morph"))))
    alone = lines.select(F.explode("words").alias("surface")).distinct().withColumn("morph", F.upper("surface"))
    out = spans.annotate(lines, ["song_id", "line_idx"], "tokens", "analysed", alone)
    return out.groupBy("song_id").agg(F.count("*").alias("tokens"), *[F.count_if(F.col("how") == h).alias(h) for h in ("context", "alone", "unknown")])


TIMED_SQL = with_("turns") + """,
raw AS (SELECT song_id, line_idx, text, CASE WHEN line_idx % 7 = 3 THEN -1.0 WHEN line_idx % 9 = 4 THEN NULL ELSE time_sec END AS start_sec, CASE WHEN line_idx % 4 = 0 THEN time_sec - 1 WHEN line_idx % 4 = 1 THEN time_sec + 2.5 END AS end_sec FROM turns WHERE trim(text) <> ''),
dur AS (SELECT song_id, max(time_sec) * 0.8 AS d FROM turns GROUP BY song_id),
s AS (SELECT raw.*, CASE WHEN d > 0 THEN round(d * 1000)::BIGINT END AS dur, CASE WHEN start_sec >= 0 THEN round(start_sec * 1000)::BIGINT END AS s0, round(end_sec * 1000)::BIGINT AS e0 FROM raw LEFT JOIN dur USING (song_id)),
o AS (SELECT *, coalesce(s0 > dur + 2000, false) AS over FROM s),
k AS (SELECT *, CASE WHEN NOT over THEN s0 END AS start_ms FROM o),
n AS (SELECT k.*, (SELECT min(x.start_ms) FROM k x WHERE x.song_id = k.song_id AND x.start_ms > k.start_ms) AS next FROM k),
f AS (SELECT song_id, line_idx, text, start_ms, CASE WHEN start_ms IS NOT NULL THEN CASE WHEN e0 > start_ms THEN e0 ELSE coalesce(next, CASE WHEN dur > start_ms THEN dur END) END END AS end_ms,
    CASE WHEN start_sec IS NOT NULL AND s0 IS NULL THEN 'invalid' WHEN over THEN 'over' WHEN start_ms IS NOT NULL AND e0 <= start_ms THEN 'end' END AS mended FROM n)"""


def timed_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as lines with times, some of them broken, and the songs' lengths."""
    turns = T.turns(spark, sf_dir)
    idx, time = F.col("line_idx"), F.col("time_sec").cast("double")
    start = F.when(idx % 7 == 3, -1.0).when(idx % 9 == 4, F.lit(None)).otherwise(time)
    end = F.when(idx % 4 == 0, time - 1).when(idx % 4 == 1, time + 2.5)
    none = F.lit(None).cast("array<struct<char_start:long,char_end:long,start_sec:double,end_sec:double>>")
    return turns.select("song_id", "line_idx", "text", start.alias("start_sec"), end.alias("end_sec"), none.alias("words")), turns.groupBy("song_id").agg((F.max(time) * 0.8).alias("duration_sec"))


@query(TIMED_SQL + """
SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY start_ms NULLS LAST, line_idx) - 1)::BIGINT AS place, md5(coalesce(start_ms::VARCHAR, '') || chr(31) || text || chr(31) || (row_number() OVER (PARTITION BY song_id, start_ms, text ORDER BY line_idx) - 1)) AS id,
    coalesce(start_ms, -1)::BIGINT AS start_ms, coalesce(end_ms, -1)::BIGINT AS end_ms, text, coalesce(mended, '') AS mended FROM f""")
def ts_timeline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a timeline."""
    out = spans.build_timelines(*timed_lines(spark, sf_dir))
    return out.select("song_id", "place", "id", F.coalesce("start_ms", F.lit(-1)).alias("start_ms"), F.coalesce("end_ms", F.lit(-1)).alias("end_ms"), "text", F.coalesce("mended", F.lit("")).alias("mended"))


@query(TIMED_SQL + """
SELECT song_id, count(*) AS lines, CASE WHEN count(start_ms) > 0 THEN 'line' ELSE 'none' END AS precision, count(*) FILTER (WHERE mended = 'invalid') AS n_invalid, count(*) FILTER (WHERE mended = 'over') AS n_over, count(*) FILTER (WHERE mended = 'end') AS n_end FROM f GROUP BY song_id""")
def ts_timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was mended in each conversation's timeline."""
    return spans.timeline_summary(spans.build_timelines(*timed_lines(spark, sf_dir)))


UNITS_SQL = with_("turns") + r""",
l AS (SELECT song_id, line_idx, text, time_sec::DOUBLE AS t0, time_sec + length(text) / 10.0 AS t1, regexp_split_to_array(text, ' ') AS x FROM turns WHERE text <> ''),
w AS (SELECT *, generate_subscripts(x, 1) AS k, len(x) AS n, unnest(x) AS w FROM l),
p AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY song_id, line_idx ORDER BY k) - length(w) - 1 AS a FROM w),
u AS (SELECT song_id, line_idx, text, t0, t1, k, n, a, CASE WHEN k = n OR line_idx % 3 = 2 THEN a + length(w) ELSE a + length(w) + 1 END AS b FROM p)"""


@query(UNITS_SQL + """
SELECT song_id, line_idx, CASE WHEN bool_and(b > a) AND max(b) FILTER (WHERE k = n) = any_value(length(text)) AND (any_value(n) = 1 OR line_idx % 3 <> 2) AND any_value(t1 > t0) AND line_idx % 5 <> 4 THEN 'karaoke' ELSE 'line' END AS mode,
    CASE WHEN bool_and(b > a) AND (any_value(n) = 1 OR line_idx % 3 <> 2) AND line_idx % 5 <> 4 THEN any_value(n) ELSE 0 END::BIGINT AS units FROM u GROUP BY song_id, line_idx""")
def ts_display_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn can be shown word by word: its words' blanks belong to the word before, but not in every third turn, and in every fifth a word begins too early."""
    turns = T.turns(spark, sf_dir).where("text <> ''").select("song_id", "line_idx", "text", F.col("time_sec").cast("double").alias("time_sec"), (F.col("time_sec") + F.length("text") / 10.0).cast("double").alias("end_sec"))
    words = F.split("text", " ")
    w = turns.select("song_id", "line_idx", "text", "time_sec", F.posexplode(words).alias("k", "w"), F.size(words).alias("n"), words.alias("x"))
    before = F.length(F.array_join(F.slice("x", F.lit(1), F.col("k")), " ")) + F.when(F.col("k") > 0, 1).otherwise(0)
    w = w.withColumn("a", before.cast("long"))
    b = F.col("a") + F.length("w") + F.when((F.col("k") == F.col("n") - 1) | (F.col("line_idx") % 3 == 2), 0).otherwise(1)
    early = F.when((F.col("line_idx") % 5 == 4) & (F.col("k") == F.col("n") - 1), 1.0).otherwise(0.0)
    timing = w.select("song_id", "line_idx", F.col("a").alias("char_start"), b.cast("long").alias("char_end"), (F.col("time_sec") + F.col("a") / 10.0 - early * 1000).cast("double").alias("start_sec"), (F.col("time_sec") + b / 10.0).cast("double").alias("end_sec"), F.lit("lrc").alias("source"))
    out = spans.display_units(turns, timing, ["song_id", "line_idx"])
    return out.select("song_id", "line_idx", "mode", F.coalesce(F.size("units"), F.lit(0)).cast("long").alias("units"))
