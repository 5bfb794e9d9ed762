"""The registered queries of the corpus operators over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import measures, text
from strophe.operators import association, frequency, lexical, library, plays, resolve, runs, search, timeline
from strophe.plans import scope, stream
from strophe.sources import tables as T
from strophe.sources import token_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def with_(*names: str) -> str:
    parts = T.SQL | stream.SQL
    return "WITH " + ",\n".join(parts[n] for n in names)


TOK = with_("lines", "tokens", "kept")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_table(spark, sf_dir)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, integers as long, for comparison."""
    kinds = dict(df.dtypes)
    cast = lambda c: F.round(F.col(c), places).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select(*[cast(c) for c in df.columns])


# ---- frequency and dispersion ----

FREQ_SQL = """,
t AS (SELECT count(*) FILTER (WHERE {unit}) AS total, count(DISTINCT song_id) AS songs FROM kept),
f AS (SELECT lemma, pos, count(*) FILTER (WHERE {unit}) AS freq, count(*) AS raw_freq, count(*) FILTER (WHERE NOT repeat) AS distinct_freq, count(DISTINCT song_id) FILTER (WHERE {unit}) AS songs FROM kept GROUP BY lemma, pos),
g AS (SELECT * FROM f WHERE freq > 0 ORDER BY freq DESC, lemma, pos LIMIT 500),
s AS (SELECT lemma, pos, surface, row_number() OVER (PARTITION BY lemma, pos ORDER BY count(*) DESC, surface) AS nth FROM kept GROUP BY lemma, pos, surface)
SELECT lemma, pos, freq::BIGINT AS freq, round(freq * 10000.0 / t.total, 6) AS per_10k, raw_freq::BIGINT AS raw_freq, distinct_freq::BIGINT AS distinct_freq, round(1 - distinct_freq / raw_freq, 6) AS repeat_share,
       g.songs::BIGINT AS songs, round(g.songs / t.songs, 6) AS range, (SELECT string_agg(surface, ' ' ORDER BY nth) FROM s WHERE s.lemma = g.lemma AND s.pos = g.pos AND nth <= 5) AS surfaces
FROM g, t"""


@query(TOK + FREQ_SQL.format(unit="true"))
def corp_frequency_tokens(spark, sf_dir):
    return rounded(frequency.frequency(tokens(spark, sf_dir)))


@query(TOK + FREQ_SQL.format(unit="NOT repeat"))
def corp_frequency_distinct(spark, sf_dir):
    return rounded(frequency.frequency(tokens(spark, sf_dir), scope.DISTINCT_LINES))


DISPERSION_SQL = """,
p AS (SELECT song_id, lemma, pos, row_number() OVER (ORDER BY song_id, line_idx, idx) - 1 AS place FROM kept),
z AS (SELECT song_id, count(*) AS size FROM kept GROUP BY song_id),
t AS (SELECT sum(size)::DOUBLE AS n, count(*) AS parts, min(size) AS least FROM z),
f AS (SELECT lemma, pos, count(*) AS freq FROM p GROUP BY lemma, pos),
v AS (SELECT lemma, pos, song_id, count(*) AS v FROM p GROUP BY ALL),
d AS (SELECT lemma, pos, sum(abs(v / freq - size / n)) AS off, sum(size / n) AS covered, sum(v / size) AS rel, sum((v / size) * (v / size)) AS rel2 FROM v JOIN z USING (song_id) JOIN f USING (lemma, pos), t GROUP BY lemma, pos),
g AS (SELECT lemma, pos, freq, n, lead(place) OVER w - place AS gap, first_value(place) OVER w + n - place AS around FROM p JOIN f USING (lemma, pos), t WINDOW w AS (PARTITION BY lemma, pos ORDER BY place)),
a AS (SELECT lemma, pos, sum(least(coalesce(gap, around), n / freq) / (n / freq)) AS arf FROM g GROUP BY lemma, pos),
x AS (SELECT *, greatest(0, least(1, 0.5 * (off + greatest(0, 1 - covered)))) AS dp FROM d JOIN f USING (lemma, pos) JOIN a USING (lemma, pos), t)
SELECT lemma, pos, freq::BIGINT AS freq, round(dp, 6) AS dp, round(greatest(0, least(1, dp / (1 - least / n))), 6) AS dp_norm,
       round(greatest(0, least(1, 1 - sqrt(greatest(0, rel2 / parts - (rel / parts) * (rel / parts))) / (rel / parts) / sqrt(parts - 1))), 6) AS juilland_d, round(arf, 6) AS arf FROM x"""


@query(TOK + DISPERSION_SQL)
def corp_dispersion(spark, sf_dir):
    return rounded(frequency.dispersion(tokens(spark, sf_dir), ["lemma", "pos"]))


@query(TOK + """,
h AS (SELECT count(DISTINCT song_id) AS song_count, count(*) AS utterance_count FROM lines),
f AS (SELECT lemma, count(*) AS n FROM kept GROUP BY lemma), s AS (SELECT song_id, count(DISTINCT lemma) AS t FROM kept GROUP BY song_id)
SELECT song_count, utterance_count, sum(n)::BIGINT AS token_count, count(*) AS type_count, round(count(*) / sum(n), 6) AS ttr, count(*) FILTER (WHERE n = 1) AS hapax_count,
       round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS hapax_ratio, round((SELECT avg(t) FROM s), 6) AS avg_types_per_song, round(sum(n) / any_value(utterance_count), 6) AS avg_tokens_per_line
FROM f, h GROUP BY song_count, utterance_count""")
def corp_report_totals(spark, sf_dir):
    return rounded(frequency.report_totals(T.lines(spark, sf_dir), tokens(spark, sf_dir)))


@query(TOK + " SELECT pos, count(*) AS token_count, round(count(*) / (SELECT count(*) FROM kept) * 100, 6) AS token_pct, count(DISTINCT lemma) AS type_count FROM kept GROUP BY pos")
def corp_pos_dist(spark, sf_dir):
    return rounded(frequency.pos_distribution(tokens(spark, sf_dir)))


@query(TOK + """,
f AS (SELECT lemma, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lemma) AS r FROM kept GROUP BY lemma)
SELECT n::BIGINT AS n, round((SELECT sum(f.n) FROM f WHERE r <= c.n) * 100.0 / (SELECT sum(f.n) FROM f), 6) AS pct FROM (VALUES (100), (500), (1000), (2000)) c(n)""")
def corp_coverage(spark, sf_dir):
    return rounded(frequency.coverage(tokens(spark, sf_dir)))


@query(TOK + """,
p AS (SELECT lemma, row_number() OVER (ORDER BY song_id, line_idx, idx) - 1 AS place, count(*) OVER () AS n FROM kept),
c AS (SELECT place // s AS chunk, s, count(*) AS k, count(DISTINCT lemma) AS types FROM (SELECT *, CASE WHEN n >= 5000 THEN 1000 WHEN n >= 1000 THEN 500 END AS s FROM p) GROUP BY ALL HAVING count(*) = s)
SELECT max(s)::BIGINT AS sttr_chunk, round(sum(types) / count(*) / max(s), 6) AS sttr FROM c""")
def corp_sttr(spark, sf_dir):
    return rounded(frequency.sttr(tokens(spark, sf_dir)))


NGRAM_SQL = """,
g AS (SELECT song_id, {words} AS words, {surface} AS surface, {ok} AS ok FROM kept WINDOW w AS (PARTITION BY song_id, line_idx ORDER BY idx)),
t AS (SELECT count(*) AS n, count(DISTINCT song_id) AS songs FROM kept),
f AS (SELECT words, count(*) AS freq, count(DISTINCT song_id) AS songs FROM g WHERE ok GROUP BY words HAVING count(*) >= 2 AND count(DISTINCT song_id) >= 2 ORDER BY freq DESC, songs DESC, words LIMIT 200),
s AS (SELECT words, surface, row_number() OVER (PARTITION BY words ORDER BY count(*) DESC, surface) AS nth FROM g WHERE ok GROUP BY words, surface)
SELECT words, freq, round(freq * 10000.0 / t.n, 6) AS per_10k, f.songs, round(f.songs / t.songs, 6) AS range, surface FROM f JOIN s USING (words), t WHERE nth = 1"""


def ngram_sql(n: int) -> str:
    ahead = lambda c: [c if k == 0 else f"lead({c}, {k}) OVER w" for k in range(n)]
    ok = " AND ".join(f"lead(lemma, {k}) OVER w IS NOT NULL AND NOT lead(gap_before, {k}) OVER w" for k in range(1, n))
    return TOK + NGRAM_SQL.format(words=" || ' ' || ".join(ahead("lemma")), surface=" || ".join(ahead("surface")), ok=ok)


@query(ngram_sql(2))
def corp_ngrams_2(spark, sf_dir):
    return rounded(frequency.ngrams(tokens(spark, sf_dir), 2))


@query(ngram_sql(3))
def corp_ngrams_3(spark, sf_dir):
    return rounded(frequency.ngrams(tokens(spark, sf_dir), 3))


@query(TOK + " SELECT lemma, pos, count(*) AS freq, count(DISTINCT song_id) AS songs FROM kept WHERE pos NOT IN ('PUNCT', 'SYM', 'SPACE', 'X') GROUP BY lemma, pos ORDER BY freq DESC, lemma, pos LIMIT 500")
def agg_word_frequency(spark, sf_dir):
    return frequency.word_frequency(tokens(spark, sf_dir))


@query(TOK + " SELECT lemma, pos, count(*) AS occurrences, count(DISTINCT song_id) AS songs, count(DISTINCT artist) AS artists, min(song_id) AS first_song FROM kept WHERE lemma = 'the' GROUP BY lemma, pos")
def agg_word_in_corpus(spark, sf_dir):
    return frequency.word_in_corpus(tokens(spark, sf_dir), "the")


@query(TOK + """,
f AS (SELECT lemma, pos, count(*) AS freq, count(DISTINCT song_id) AS songs FROM kept GROUP BY lemma, pos)
SELECT lemma, sum(freq)::BIGINT AS freq, max(songs) AS songs, string_agg(pos, ' ' ORDER BY freq DESC, pos) AS pos FROM f GROUP BY lemma""")
def cloud_merge(spark, sf_dir):
    return frequency.merged_by_lemma(frequency.word_frequency(tokens(spark, sf_dir), None))


# ---- association ----

COLLOC_SQL = """,
near AS (SELECT o.lemma, o.pos, o.song_id, sign(o.idx - n.idx) AS side FROM kept n JOIN kept o ON n.song_id = o.song_id AND n.line_idx = o.line_idx AND n.lemma = '{node}' AND o.idx <> n.idx AND o.idx BETWEEN n.idx - 5 AND n.idx + 5),
c AS (SELECT lemma, pos, count(*) FILTER (WHERE side < 0) AS freq_left, count(*) FILTER (WHERE side > 0) AS freq_right, count(*) AS freq, count(DISTINCT song_id) AS songs FROM near GROUP BY lemma, pos),
t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE lemma = '{node}') AS node_freq, (SELECT sum(freq) FROM c)::DOUBLE AS slots FROM kept),
w AS (SELECT lemma, pos, count(*) AS collocate_freq FROM kept GROUP BY lemma, pos),
x AS (SELECT *, freq::DOUBLE AS o, slots * collocate_freq / n AS e, freq::DOUBLE AS a, greatest(slots - freq, 0) AS b, greatest(collocate_freq - freq, 0)::DOUBLE AS cc, greatest(n - slots - greatest(collocate_freq - freq, 0), 0) AS dd
      FROM c JOIN w USING (lemma, pos), t WHERE freq >= 2),
y AS (SELECT lemma, pos, freq, freq_left, freq_right, collocate_freq, songs, 14 + log2(2 * o / (node_freq + collocate_freq)) AS log_dice, log2(o / e) AS mi, {g2} AS log_likelihood, (o - e) / sqrt(o) AS t_score, log2(o * o * o / e) AS mi3,
             (o - e) / sqrt(e) AS z_score, a / (a + b) - cc / (cc + dd) AS delta_p, a / (a + cc) - b / (b + dd) AS delta_p_reverse FROM x)
"""
COLLOC_SQL = COLLOC_SQL.replace("{g2}", measures.g2_sql("a", "b", "cc", "dd"))


@query(TOK + COLLOC_SQL.format(node="the") + """SELECT lemma, pos, freq, freq_left, freq_right, collocate_freq, songs, round(log_dice, 6) AS log_dice, round(mi, 6) AS mi, round(log_likelihood, 6) AS log_likelihood, round(t_score, 6) AS t_score,
    round(mi3, 6) AS mi3, round(z_score, 6) AS z_score, round(delta_p, 6) AS delta_p, round(delta_p_reverse, 6) AS delta_p_reverse FROM y ORDER BY y.log_dice DESC, freq DESC, lemma, pos LIMIT 100""")
def corp_collocations(spark, sf_dir):
    return rounded(association.collocations(tokens(spark, sf_dir), "the"))


@query(TOK + COLLOC_SQL.format(node="the") + """,
best AS (SELECT DISTINCT lemma FROM (SELECT lemma FROM y ORDER BY log_dice DESC, freq DESC, lemma, pos LIMIT 20)),
k AS (SELECT * FROM kept WHERE lemma IN (SELECT lemma FROM best)), f AS (SELECT lemma, count(*) AS f FROM k GROUP BY lemma),
p AS (SELECT least(x.lemma, y.lemma) AS a, greatest(x.lemma, y.lemma) AS b, count(*) AS freq FROM k x JOIN k y ON x.song_id = y.song_id AND x.line_idx = y.line_idx AND y.idx > x.idx AND y.idx - x.idx <= 5 AND x.lemma <> y.lemma GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT p.*, 14 + log2(2.0 * freq / (fa.f + fb.f)) AS log_dice FROM p JOIN f fa ON fa.lemma = a JOIN f fb ON fb.lemma = b),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(log_dice, 9) DESC, a, b) AS rank FROM (SELECT *, unnest([a, b]) AS node FROM e))
SELECT DISTINCT a, b, freq, round(log_dice, 6) AS log_dice FROM r WHERE rank <= 3""")
def corp_network_edges(spark, sf_dir):
    return rounded(association.network(tokens(spark, sf_dir), "the"))


KEY_SQL = """,
ta AS (SELECT lemma, pos, count(*) AS n, count(DISTINCT song_id) AS songs FROM kept WHERE {unit} AND {target} GROUP BY ALL), re AS (SELECT lemma, pos, count(*) AS n FROM kept WHERE {unit} AND NOT ({target}) GROUP BY ALL),
t AS (SELECT greatest(1, count(*) FILTER (WHERE {target}))::DOUBLE AS c, greatest(1, count(*) FILTER (WHERE NOT ({target})))::DOUBLE AS d FROM kept WHERE {unit}),
j AS (SELECT lemma, pos, coalesce(ta.n, 0) AS target_freq, coalesce(re.n, 0) AS reference_freq, coalesce(ta.songs, 0) AS target_songs, coalesce(ta.n, 0)::DOUBLE AS a, coalesce(re.n, 0)::DOUBLE AS b, c, d FROM ta FULL JOIN re USING (lemma, pos), t WHERE coalesce(ta.n, 0) + coalesce(re.n, 0) >= {least}),
l AS (SELECT *, 2 * ({p1} + {p2}) AS ll FROM j),
k AS (SELECT *, CASE WHEN a / c >= b / d THEN ll ELSE -ll END AS log_likelihood, {p} AS p_value FROM l)
""".replace("{p1}", measures.part_sql("a", "(c * ((a + b) / (c + d)))")).replace("{p2}", measures.part_sql("b", "(d * ((a + b) / (c + d)))")).replace("{p}", measures.chi2_p_sql("ll"))


def key_sql(target: str, unit: str, least: int, more: str, limit: int) -> str:
    return TOK + KEY_SQL.format(target=target, unit=unit, least=least) + f""",
s AS (SELECT *, CASE WHEN log_likelihood > 0 THEN 'over' WHEN log_likelihood < 0 THEN 'under' END AS side FROM k WHERE {more}),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(round(log_likelihood, 6)) DESC, lemma, pos) AS rank FROM s WHERE side IS NOT NULL)
SELECT lemma, pos, side, target_freq, reference_freq, target_songs, round(a * 10000.0 / c, 6) AS target_per_10k, round(b * 10000.0 / d, 6) AS reference_per_10k, round(log_likelihood, 5) AS log_likelihood,
       round(log2((greatest(a, 0.5) / c) / (greatest(b, 0.5) / d)), 6) AS log_ratio, round(p_value, 6) AS p_value, round(ll - ln(c + d), 5) AS bic, round(CASE WHEN b > 0 THEN (a / c - b / d) / (b / d) * 100 END, 6) AS percent_diff
FROM r WHERE rank <= {limit}"""


def key_rounded(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.round(c, 5) for c in ("log_likelihood", "bic")}))


@query(key_sql("language = 'en'", "true", 5, "true", 100))
def corp_keyness(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return key_rounded(association.keyness(t.where("language = 'en'"), t.where("language <> 'en'")))


@query(key_sql("artist = 'src0'", "NOT repeat", 5, "p_value <= 0.05", 100))
def corp_keyness_p(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return key_rounded(association.keyness(t.where("artist = 'src0'"), t.where("artist <> 'src0'"), scope.DISTINCT_LINES, max_p=0.05))


@query(TOK + KEY_SQL.format(target="song_id = 0", unit="NOT repeat", least=1) + """,
o AS (SELECT * FROM k WHERE log_likelihood > 0 ORDER BY abs(round(log_likelihood, 6)) DESC, lemma, pos LIMIT 80)
SELECT lemma, pos, target_freq, reference_freq, round(log_likelihood, 5) AS log_likelihood FROM o WHERE pos NOT IN ('ADP', 'AUX', 'SCONJ', 'CCONJ', 'PART', 'DET', 'PRON', 'NUM') ORDER BY round(o.log_likelihood, 6) DESC, lemma, pos LIMIT 20""")
def corp_song_profile(spark, sf_dir):
    out = association.song_profile(tokens(spark, sf_dir), 0)
    return rounded(out.select("lemma", "pos", "target_freq", "reference_freq", F.round("log_likelihood", 5).alias("log_likelihood")))


BREAKDOWN_SQL = """,
g AS (SELECT {by} AS key, count(*) FILTER (WHERE lemma IN ('the', 'la')) AS hits, count(DISTINCT song_id) FILTER (WHERE lemma IN ('the', 'la')) AS songs, count(*) AS tokens FROM kept GROUP BY 1),
w AS (SELECT sum(hits) AS h, sum(tokens) AS n FROM g)
SELECT key, hits, songs, tokens, round(hits * 10000.0 / tokens, 6) AS per_10k, round((hits * 10000.0 / tokens) / (h * 10000.0 / n), 6) AS ratio FROM g, w"""


@query(TOK + BREAKDOWN_SQL.format(by="artist"))
def corp_breakdown_performer(spark, sf_dir):
    return rounded(association.breakdown(tokens(spark, sf_dir), ("the", "la"), "artist"))


@query(TOK + BREAKDOWN_SQL.format(by="language"))
def corp_breakdown_language(spark, sf_dir):
    return rounded(association.breakdown(tokens(spark, sf_dir), ("the", "la"), "language"))


# ---- lexical ----


@query(TOK + """,
f AS (SELECT song_id AS key, lemma, count(*) AS f FROM kept WHERE NOT repeat GROUP BY ALL)
SELECT key, 1::BIGINT AS songs, sum(f)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(f), 6) AS ttr, round(10000.0 * (sum(f * f) - sum(f)) / (sum(f)::DOUBLE * sum(f)), 6) AS yule_k, round(count(*) FILTER (WHERE f = 1) / count(*), 6) AS hapax_ratio FROM f GROUP BY key""")
def corp_lexical_song(spark, sf_dir):
    return rounded(lexical.richness(tokens(spark, sf_dir), "song_id"))


@query(TOK + """,
j AS (SELECT song_id, lemma, row_number() OVER (PARTITION BY song_id ORDER BY line_idx, idx) - 1 AS j, count(*) OVER (PARTITION BY song_id) AS n FROM kept WHERE NOT repeat),
w AS (SELECT a.song_id, a.i, count(DISTINCT b.lemma) AS types FROM (SELECT song_id, j AS i FROM j WHERE j + 50 <= n) a JOIN j b ON a.song_id = b.song_id AND b.j BETWEEN a.i AND a.i + 49 GROUP BY ALL)
SELECT s.song_id AS key, round((SELECT sum(types) / (count(*) * 50.0) FROM w WHERE w.song_id = s.song_id), 6) AS mattr FROM (SELECT DISTINCT song_id FROM j) s""")
def corp_mattr(spark, sf_dir):
    return rounded(lexical.mattr(tokens(spark, sf_dir)))


MTLD_FOLD = """list_reduce(x, lambda a, e: CASE WHEN (a.types + CASE WHEN e < a.start THEN 1 ELSE 0 END) / (a.i - a.start + 1) <= 0.72::DOUBLE
    THEN {'i': a.i + 1, 'start': a.i + 1, 'types': 0.0::DOUBLE, 'done': a.done + 1} ELSE {'i': a.i + 1, 'start': a.start, 'types': a.types + CASE WHEN e < a.start THEN 1 ELSE 0 END, 'done': a.done} END, {'i': 0::BIGINT, 'start': 0::BIGINT, 'types': 0.0::DOUBLE, 'done': 0.0::DOUBLE})"""


# where each word stood last before, in both directions, folded into factors one word after another
@query(TOK + f""",
u AS (SELECT song_id, lemma, row_number() OVER (PARTITION BY song_id ORDER BY line_idx, idx) - 1 AS j, count(*) OVER (PARTITION BY song_id) AS n FROM kept WHERE NOT repeat),
d AS (SELECT song_id, lemma, n, 0 AS way, j FROM u UNION ALL SELECT song_id, lemma, n, 1, n - 1 - j FROM u),
e AS (SELECT song_id, way, n, j, coalesce(lag(j) OVER (PARTITION BY song_id, way, lemma ORDER BY j), -1) AS earlier FROM d),
l AS (SELECT song_id, way, n, list(earlier ORDER BY j) AS x FROM e GROUP BY ALL),
f AS (SELECT song_id, n, {MTLD_FOLD} AS s FROM l),
g AS (SELECT song_id, n, s.done + CASE WHEN s.i > s.start THEN (1 - s.types / (s.i - s.start)) / (1 - 0.72::DOUBLE) ELSE 0 END AS k FROM f)
SELECT song_id::BIGINT AS key, round(CASE WHEN min(k) > 0 THEN avg(n / k) END, 6) AS mtld FROM g GROUP BY song_id""")
def corp_mtld(spark, sf_dir):
    return rounded(lexical.mtld(tokens(spark, sf_dir)))


@query(TOK + """,
c AS (SELECT language AS key, length(surface) AS n, len(regexp_extract_all(surface, '[A-Za-zＡ-Ｚａ-ｚÀ-ÖØ-öø-ɏ]')) AS latin, len(regexp_extract_all(surface, '[々〆〇㐀-䶿一-鿿豈-﫿]')) AS kanji, len(regexp_extract_all(surface, '[ぁ-ゟ]')) AS hiragana, len(regexp_extract_all(surface, '[゠-ヿㇰ-ㇿｦ-ﾟ]')) AS katakana FROM kept WHERE NOT repeat)
SELECT key, sum(n)::BIGINT AS chars, round(sum(kanji) / sum(n), 6) AS kanji, round(sum(hiragana) / sum(n), 6) AS hiragana, round(sum(katakana) / sum(n), 6) AS katakana, round(sum(latin) / sum(n), 6) AS latin, round((sum(n) - sum(kanji) - sum(hiragana) - sum(katakana) - sum(latin)) / sum(n), 6) AS other FROM c GROUP BY key""")
def corp_scripts(spark, sf_dir):
    return rounded(lexical.scripts(tokens(spark, sf_dir), "language"))


@query(TOK + """,
f AS (SELECT lemma, surface, count(*) AS n, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, surface) AS nth FROM kept GROUP BY lemma, surface)
SELECT lemma, count(*) AS variants, sum(n)::BIGINT AS freq, string_agg(surface, ' ' ORDER BY nth) AS forms FROM f GROUP BY lemma HAVING count(*) > 1""")
def corp_orthography(spark, sf_dir):
    return lexical.orthography(tokens(spark, sf_dir))


# ---- search ----

LT = with_("lines", "tokens")
KWIC_SQL = """,
h AS MATERIALIZED (SELECT song_id, artist, line_idx, token_idx, text FROM ({hits})),
c AS MATERIALIZED (SELECT *, pos NOT IN ('PUNCT', 'SYM') AS content FROM tokens WHERE (song_id, line_idx) IN (SELECT (song_id, line_idx) FROM h)),
l AS (SELECT h.song_id, h.line_idx, h.token_idx, string_agg(surface, ' ' ORDER BY r) AS words FROM (SELECT h.song_id, h.line_idx, h.token_idx, c.surface, row_number() OVER (PARTITION BY h.song_id, h.line_idx, h.token_idx ORDER BY c.token_idx DESC) AS r
      FROM h JOIN c ON c.song_id = h.song_id AND c.line_idx = h.line_idx AND c.token_idx < h.token_idx AND content) h WHERE r <= 5 GROUP BY ALL),
g AS (SELECT h.song_id, h.line_idx, h.token_idx, string_agg(surface, ' ' ORDER BY r) AS words FROM (SELECT h.song_id, h.line_idx, h.token_idx, c.surface, row_number() OVER (PARTITION BY h.song_id, h.line_idx, h.token_idx ORDER BY c.token_idx) AS r
      FROM h JOIN c ON c.song_id = h.song_id AND c.line_idx = h.line_idx AND c.token_idx >= h.token_idx + {n} AND content) h WHERE r <= 5 GROUP BY ALL)
SELECT h.song_id, artist, h.line_idx::BIGINT AS line_idx, h.token_idx::BIGINT AS token_idx, coalesce(l.words, '') AS left_words, coalesce(g.words, '') AS right_words FROM h LEFT JOIN l USING (song_id, line_idx, token_idx) LEFT JOIN g USING (song_id, line_idx, token_idx)"""
WORD_HITS = "SELECT * FROM tokens WHERE lemma = 'worthless'"
SEQ_HITS = "SELECT * FROM (SELECT *, lead(lemma) OVER (PARTITION BY song_id, line_idx ORDER BY token_idx) AS after FROM tokens) WHERE lemma = 'of' AND after = 'the'"


def kwic_words(df: DataFrame) -> DataFrame:
    return df.select("song_id", "artist", "line_idx", "token_idx", "left_words", "right_words")


@query(LT + KWIC_SQL.format(hits=WORD_HITS, n=1))
def kwic_word(spark, sf_dir):
    return kwic_words(search.kwic(T.lines(spark, sf_dir), ("worthless",)))


@query(LT + KWIC_SQL.format(hits=SEQ_HITS, n=2))
def kwic_sequence(spark, sf_dir):
    return kwic_words(search.kwic(T.lines(spark, sf_dir), ("of+the",)))


@query(LT + """,
h AS (SELECT *, count(*) OVER (PARTITION BY song_id, text) AS repeat_count, row_number() OVER (PARTITION BY song_id, text ORDER BY line_idx, token_idx) AS nth FROM tokens WHERE lemma = 'of')
SELECT song_id, line_idx::BIGINT AS line_idx, token_idx::BIGINT AS token_idx, repeat_count FROM h WHERE nth = 1""")
def kwic_dedup(spark, sf_dir):
    return search.kwic(T.lines(spark, sf_dir), ("of",), dedup=True).select("song_id", "line_idx", "token_idx", "repeat_count")


@query(LT + """,
k AS (SELECT *, row_number() OVER (PARTITION BY song_id, line_idx ORDER BY token_idx) AS c FROM tokens WHERE pos NOT IN ('PUNCT', 'SYM'))
SELECT DISTINCT a.song_id, a.line_idx::BIGINT AS line_idx, a.token_idx::BIGINT AS token_idx FROM k a JOIN k b ON a.song_id = b.song_id AND a.line_idx = b.line_idx AND b.lemma = 'of' AND b.c <> a.c AND abs(a.c - b.c) <= 3 WHERE a.lemma = 'the'""")
def kwic_near(spark, sf_dir):
    return search.kwic(T.lines(spark, sf_dir), ("the",), near=("of", 3)).select("song_id", "line_idx", "token_idx")


@query(LT + """,
n AS (SELECT a.song_id, a.line_idx, p.text AS b, q.text AS e, a.text FROM lines a LEFT JOIN lines p ON p.song_id = a.song_id AND p.line_idx = a.line_idx - 1 LEFT JOIN lines q ON q.song_id = a.song_id AND q.line_idx = a.line_idx + 1)
SELECT t.song_id, t.line_idx::BIGINT AS line_idx, t.token_idx::BIGINT AS token_idx, n.b IS NOT NULL AS has_before, n.e IS NOT NULL AS has_after, length(concat_ws(' / ', n.b, n.text, n.e))::BIGINT AS chars
FROM tokens t JOIN n ON n.song_id = t.song_id AND n.line_idx = t.line_idx WHERE lemma = 'worthless'""")
def kwic_cross_line(spark, sf_dir):
    """Left, keyword and right together are the line again, with its neighbours."""
    hits = search.kwic(T.lines(spark, sf_dir), ("worthless",), cross_line=True)
    plain = search.kwic(T.lines(spark, sf_dir), ("worthless",)).select("song_id", "line_idx", "token_idx", F.length("left").alias("l"), F.length("right").alias("r"))
    rows = hits.join(plain, ["song_id", "line_idx", "token_idx"])
    return rows.select("song_id", "line_idx", "token_idx", (F.length("left") > F.col("l")).alias("has_before"), (F.length("right") > F.col("r")).alias("has_after"), (F.length("left") + F.length("keyword") + F.length("right")).cast("long").alias("chars"))


@query(LT + """,
s AS (SELECT *, lead(surface) OVER w AS after, lead(pos) OVER w AS p2 FROM tokens WINDOW w AS (PARTITION BY song_id, line_idx ORDER BY token_idx))
SELECT song_id, artist, line_idx::BIGINT AS line_idx, token_idx::BIGINT AS start, 2::BIGINT AS length, surface || ' ' || after AS matched FROM s WHERE lemma = 'worthless' AND p2 = 'NOUN'""")
def cql_two_token(spark, sf_dir):
    return search.pattern_search(T.lines(spark, sf_dir), [search.word("worthless"), search.Item(lambda t: t["pos"] == "NOUN")], overlap=True)


# in SQL tokens are letters: o the word of, which is ADP too, a other ADP, t other words in th-, x the rest
CQL_ITEMS = [search.Item(lambda t: t["pos"] == "ADP", 2, None), search.Item(lambda t: search.like("th.*")(t) & (t["pos"] != "ADP")), search.ANY, search.word("of")]


@query(LT + """,
e AS (SELECT song_id, artist, line_idx, list(surface ORDER BY token_idx) AS w, string_agg(CASE WHEN lemma = 'of' THEN 'o' WHEN pos = 'ADP' THEN 'a' WHEN starts_with(lemma, 'th') THEN 't' ELSE 'x' END, '' ORDER BY token_idx) AS s FROM tokens GROUP BY ALL),
m AS (SELECT song_id, artist, line_idx, w, list_transform(regexp_extract_all(s, '(.*?)([ao]{2,}t[aotx]?o)', 1), lambda x: length(x)) AS b, list_transform(regexp_extract_all(s, '(.*?)([ao]{2,}t[aotx]?o)', 2), lambda x: length(x)) AS n FROM e WHERE regexp_matches(s, '[ao]{2,}t[aotx]?o')),
r AS (SELECT song_id, artist, line_idx, w, unnest(n) AS length, unnest(list_transform(range(1, len(n) + 1), lambda i: list_sum(b[1:i]) + coalesce(list_sum(n[1:i - 1]), 0))) AS start FROM m)
SELECT song_id, artist, line_idx::BIGINT AS line_idx, start::BIGINT AS start, length::BIGINT AS length, array_to_string(w[start + 1:start + length], ' ') AS matched FROM r""")
def cql_search(spark, sf_dir):
    return search.pattern_search(T.lines(spark, sf_dir), CQL_ITEMS)


@query(with_("lines") + " SELECT song_id, artist, line_idx::BIGINT AS line_idx, text, instr(lower(text), 'worthless')::BIGINT AS at FROM lines WHERE contains(lower(text), 'worthless')")
def fts_search(spark, sf_dir):
    return search.full_text(T.lines(spark, sf_dir), "worthless").drop("rank")


GRAMS = sorted({"worthless"[i : i + 3] for i in range(7)})
BM25_SQL = " - ".join(
    f"ln(1 + (N - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(GRAMS))
)


@query(with_("lines") + f""",
st AS (SELECT count(*) AS N, avg(greatest(length(text) - 2, 0)) AS mean, {", ".join(f"count(*) FILTER (WHERE contains(lower(text), '{g}'))::DOUBLE AS df{i}" for i, g in enumerate(GRAMS))} FROM lines),
h AS (SELECT *, greatest(length(text) - 2, 0) AS size, list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3)) AS g FROM lines WHERE contains(lower(text), 'worthless')),
r AS (SELECT *, {", ".join(f"len(list_filter(g, lambda x: x = '{g}'))::DOUBLE AS tf{i}" for i, g in enumerate(GRAMS))} FROM h)
SELECT song_id, artist, line_idx::BIGINT AS line_idx, text, instr(lower(text), 'worthless')::BIGINT AS at, round(0 - {BM25_SQL}, 6) AS rank FROM r, st ORDER BY round(0 - {BM25_SQL}, 9), artist, song_id, line_idx LIMIT 100""")
def fts_ranked(spark, sf_dir):
    return rounded(search.full_text(T.lines(spark, sf_dir), "worthless", limit=100))


@query(with_("lines") + r""",
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), l AS (SELECT song_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM lines),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b)), lg AS (SELECT DISTINCT song_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT song_id, w, unnest(range(1, len(w) - 6)) AS i FROM l))
SELECT song_id, item_id, count(*) AS shared FROM lg JOIN bg USING (g) GROUP BY song_id, item_id""")
def fts_known_passages(spark, sf_dir):
    return search.known_passages(T.lines(spark, sf_dir), T.table(spark, sf_dir, "benchmark"))


@query(with_("lines", "tokens", "kept") + """,
w AS (SELECT lemma, pos, count(*) AS freq FROM kept GROUP BY lemma, pos), s AS (SELECT doc_id AS song_id, string_split(text, chr(10))[1] AS title FROM documents),
u AS (SELECT 'track' AS kind, song_id::VARCHAR AS id, title AS label, row_number() OVER (ORDER BY length(title), title, song_id) AS rank FROM s WHERE contains(lower(title), 'on')
UNION ALL SELECT 'person', s_suppkey::VARCHAR, s_name, row_number() OVER (ORDER BY length(s_name), s_name, s_suppkey) FROM supplier WHERE contains(lower(s_name), 'on')
UNION ALL SELECT 'album', c_custkey::VARCHAR, c_name, row_number() OVER (ORDER BY length(c_name), c_name, c_custkey) FROM customer WHERE contains(lower(c_name), 'on')
UNION ALL SELECT 'word', lemma, lemma, row_number() OVER (ORDER BY (lower(lemma) <> 'on')::INT, freq DESC, lemma, pos) FROM w WHERE contains(lower(lemma), 'on')
UNION ALL SELECT 'lyric', song_id || ':' || line_idx, text, row_number() OVER (ORDER BY instr(lower(text), 'on'), artist, song_id, line_idx) FROM lines WHERE contains(lower(text), 'on'))
SELECT kind, id, label, rank FROM u WHERE rank <= 10""")
def quick_search(spark, sf_dir):
    words = frequency.word_frequency(tokens(spark, sf_dir), None)
    return search.quick_search(T.songs(spark, sf_dir), T.people(spark, sf_dir), T.albums(spark, sf_dir), words, T.lines(spark, sf_dir), "on")


@query(LT + """,
d AS (SELECT song_id, line_idx, text FROM (SELECT DISTINCT song_id, line_idx, text FROM tokens WHERE lemma = 'the') QUALIFY row_number() OVER (PARTITION BY text ORDER BY song_id, line_idx) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY line_idx) AS nth FROM d)
SELECT song_id, line_idx::BIGINT AS line_idx, text, nth FROM n ORDER BY (nth > 1), song_id, line_idx LIMIT 10""")
def examples_diverse(spark, sf_dir):
    return search.diverse_examples(T.lines(spark, sf_dir), "the")


@query(with_("lines") + " SELECT language, count(*) AS lines FROM lines WHERE artist IN ('src0', 'src1') AND language IN ('en', 'fr') GROUP BY language")
def flt_subcorpus(spark, sf_dir):
    chosen = scope.Subcorpus(artists=("src0", "src1"), languages=("en", "fr"))
    return scope.in_scope(T.lines(spark, sf_dir), T.songs(spark, sf_dir), chosen).groupBy("language").agg(F.count("*").alias("lines"))


@query("SELECT lang AS language, count(*) AS songs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY lang")
def flt_live(spark, sf_dir):
    return scope.live(T.songs(spark, sf_dir), T.removed_songs(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("songs"))


@query(with_("lines") + " SELECT artist, count(*) AS lines FROM (SELECT DISTINCT song_id, artist, text FROM lines) GROUP BY artist")
def flt_stats_distinct(spark, sf_dir):
    return scope.first_of_equal_lines(T.lines(spark, sf_dir)).groupBy("artist").agg(F.count("*").alias("lines"))


@query("SELECT lower(trim(lang)) AS key, min(lang) AS value, count(*) AS songs FROM documents GROUP BY 1")
def flt_facet_values(spark, sf_dir):
    return scope.facets(T.songs(spark, sf_dir), "language")


# ---- library ----

LIB = with_("works", "credits")


@query(LIB + """ SELECT (SELECT count(*) FROM works) AS tracks, (SELECT count(DISTINCT album_id) FROM works) AS albums, (SELECT round(sum(duration_sec), 2) FROM works) AS duration_sec, count(DISTINCT person_id) AS people,
    count(DISTINCT person_id) FILTER (WHERE role = 'performer') AS performers, count(DISTINCT person_id) FILTER (WHERE role = 'composer') AS composers, count(DISTINCT person_id) FILTER (WHERE role = 'lyricist') AS lyricists FROM credits""")
def agg_overview(spark, sf_dir):
    return library.overview(T.works(spark, sf_dir), T.credits(spark, sf_dir))


@query(with_("works") + " SELECT year, count(DISTINCT song_id) AS songs, count(DISTINCT album_id) AS albums FROM works GROUP BY year")
def agg_timeline(spark, sf_dir):
    return library.timeline(T.works(spark, sf_dir))


@query(with_("works") + " SELECT genre, count(*) AS songs, round(sum(duration_sec), 2) AS duration_sec FROM works GROUP BY genre")
def agg_genres(spark, sf_dir):
    return library.genres(T.works(spark, sf_dir))


@query(with_("works") + " SELECT year[1:3] || '0s' AS decade, count(*) AS songs, round(sum(duration_sec), 2) AS duration_sec FROM works GROUP BY 1")
def agg_decades(spark, sf_dir):
    return library.decades(T.works(spark, sf_dir))


@query(with_("works") + " SELECT c_custkey AS album_id, c_name AS title, count(song_id) AS tracks, round(coalesce(sum(duration_sec), 0), 2) AS duration_sec, min(year) AS first_year FROM customer LEFT JOIN works ON album_id = c_custkey GROUP BY ALL")
def agg_albums(spark, sf_dir):
    return library.albums(T.albums(spark, sf_dir), T.works(spark, sf_dir))


@query(LIB + " SELECT s_suppkey AS person_id, s_name AS name, count(DISTINCT song_id) AS songs FROM supplier JOIN credits ON person_id = s_suppkey WHERE role = 'performer' GROUP BY ALL")
def agg_people_by_role(spark, sf_dir):
    return library.people_by_role(T.people(spark, sf_dir), T.credits(spark, sf_dir), "performer")


@query(LIB + """ SELECT s_suppkey AS person_id, s_name AS name, count(DISTINCT song_id) FILTER (WHERE role = 'performer') AS performer, count(DISTINCT song_id) FILTER (WHERE role = 'composer') AS composer,
    count(DISTINCT song_id) FILTER (WHERE role = 'lyricist') AS lyricist, count(DISTINCT song_id) AS songs, min(year) AS first_year, max(year) AS last_year
    FROM supplier LEFT JOIN (SELECT credits.*, year FROM credits LEFT JOIN works USING (song_id)) ON person_id = s_suppkey GROUP BY ALL""")
def agg_people_directory(spark, sf_dir):
    return library.people_directory(T.people(spark, sf_dir), T.credits(spark, sf_dir), T.works(spark, sf_dir))


@query(LIB + " SELECT x.person_id AS a, y.person_id AS b, count(DISTINCT song_id) AS songs FROM credits x JOIN credits y USING (song_id) WHERE x.person_id < y.person_id GROUP BY ALL")
def agg_collab_edges(spark, sf_dir):
    return library.collaboration_edges(T.credits(spark, sf_dir))


@query(LIB + """ SELECT person_id, count(DISTINCT song_id) AS songs, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM credits WHERE song_id IN (SELECT song_id FROM credits WHERE person_id = 1) AND person_id <> 1 GROUP BY person_id""")
def agg_collaborators(spark, sf_dir):
    return library.collaborators(T.credits(spark, sf_dir), 1)


@query(LIB + """ SELECT person_id, coalesce('album:' || album_id, 'song:' || song_id) AS release, min(release_date) AS first_date, count(*) AS tracks
    FROM works JOIN (SELECT DISTINCT song_id, person_id FROM credits WHERE role = 'performer') USING (song_id) GROUP BY 1, 2""")
def agg_timeline_releases(spark, sf_dir):
    return library.release_timeline(T.works(spark, sf_dir), T.credits(spark, sf_dir))


@query(LIB + """, p AS (SELECT DISTINCT song_id, person_id AS performer FROM credits WHERE role = 'performer'), w AS (SELECT DISTINCT song_id, person_id AS writer FROM credits WHERE role <> 'performer'),
n AS (SELECT writer, count(*) AS written FROM w GROUP BY writer)
SELECT performer, writer, count(*) AS shared, written, round(count(*) / written, 6) AS share FROM w JOIN p USING (song_id) JOIN n USING (writer) WHERE writer <> performer GROUP BY performer, writer, written HAVING count(*) >= 2 AND count(*) / written >= 0.02""")
def agg_member_suggestions(spark, sf_dir):
    return rounded(library.member_suggestions(T.credits(spark, sf_dir), least=2, share=0.02))


@query(LIB + """, n AS (SELECT person_id, role, count(*) AS n FROM credits GROUP BY ALL)
SELECT person_id, role, n AS credits FROM n QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, CASE role WHEN 'performer' THEN 0 WHEN 'composer' THEN 1 ELSE 2 END) = 1""")
def lib_person_by_id(spark, sf_dir):
    return library.main_role(T.credits(spark, sf_dir))


@query(LIB + """ SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY CASE role WHEN 'performer' THEN 0 WHEN 'composer' THEN 1 ELSE 2 END, position, s_name, person_id) AS nth, role, s_name AS name FROM credits JOIN supplier ON s_suppkey = person_id""")
def lib_credits_for_track(spark, sf_dir):
    return library.credits_of_songs(T.credits(spark, sf_dir), T.people(spark, sf_dir))


@query(LIB + """ SELECT song_id FROM credits WHERE person_id = 1 UNION SELECT song_id FROM credits WHERE person_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1))""")
def lib_person_works(spark, sf_dir):
    """Bands are all suppliers of a person's nation."""
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    members = s.select(F.col("s_suppkey").alias("person"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("band"), "s_nationkey"), "s_nationkey").select("band", "person")
    return library.person_works(T.credits(spark, sf_dir), members, 1)


@query(LIB + """ SELECT 'album' AS kind, count(album_id) AS done, count(*) AS total FROM works UNION ALL SELECT 'year', count(*), count(*) FROM works UNION ALL SELECT 'genre', count(*) FILTER (WHERE genre <> ''), count(*) FROM works
    UNION ALL SELECT 'duration', count(*) FILTER (WHERE duration_sec > 0), count(*) FROM works
    UNION ALL SELECT r, count(*) FILTER (WHERE song_id IN (SELECT song_id FROM credits WHERE role = r)), count(*) FROM works, (VALUES ('performer'), ('composer'), ('lyricist')) x(r) GROUP BY r""")
def agg_completeness(spark, sf_dir):
    return library.completeness(T.works(spark, sf_dir), T.credits(spark, sf_dir))


# ---- plays ----

PL = with_("plays")


@query(PL + """ SELECT song_id, count(*) FILTER (WHERE listened_sec >= 30) AS plays, round(sum(listened_sec) FILTER (WHERE listened_sec >= 30), 4) AS listened_sec, max(played_at) FILTER (WHERE listened_sec >= 30) AS last_played,
    arg_max(listened_sec, (played_at, id)) AS last_position, arg_max(completed, (played_at, id)) AS last_completed FROM plays GROUP BY song_id HAVING count(*) FILTER (WHERE listened_sec >= 30) > 0 ORDER BY plays DESC, last_played DESC, song_id LIMIT 20""")
def agg_most_played(spark, sf_dir):
    return plays.most_played(T.plays(spark, sf_dir))


@query(PL + " SELECT song_id, max(played_at) AS last_played, count(*) AS plays, arg_max(listened_sec, (played_at, id)) AS last_position FROM plays GROUP BY song_id ORDER BY last_played DESC, song_id LIMIT 20")
def agg_recent(spark, sf_dir):
    return plays.recent(T.plays(spark, sf_dir))


@query(PL + " SELECT (played_at + INTERVAL 9 HOUR)::DATE::VARCHAR AS day, round(sum(listened_sec), 4) AS listened_sec, count(DISTINCT song_id) AS songs, count(*) AS plays FROM plays GROUP BY 1")
def agg_today(spark, sf_dir):
    return plays.daily(T.plays(spark, sf_dir), 9).withColumn("day", F.col("day").cast("string"))


@query(PL + """, d AS (SELECT DISTINCT song_id AS key, played_at::DATE AS day FROM plays), i AS (SELECT *, day - row_number() OVER (PARTITION BY key ORDER BY day)::INT AS island FROM d)
SELECT key, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS days FROM i GROUP BY key, island""")
def agg_streak(spark, sf_dir):
    return plays.streaks(T.plays(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query(with_("lines", "tokens", "kept", "plays") + """, w AS (SELECT DISTINCT song_id, lemma FROM kept WHERE pos <> 'ADP'), h AS (SELECT song_id FROM plays GROUP BY song_id HAVING sum(listened_sec) >= 30)
SELECT count(DISTINCT lemma) FILTER (WHERE song_id IN (SELECT song_id FROM h)) AS heard, count(DISTINCT lemma) AS total FROM w""")
def agg_reach(spark, sf_dir):
    return plays.reach(T.plays(spark, sf_dir), tokens(spark, sf_dir))


TIMED = with_("plays", "turns") + ", p AS (SELECT *, listened_sec AS position_sec FROM plays)"


def positioned(spark, sf_dir):
    return T.plays(spark, sf_dir).withColumn("position_sec", F.col("listened_sec"))


@query(TIMED + " SELECT song_id, count(*) AS lines_heard FROM p JOIN turns t USING (song_id) WHERE t.time_sec BETWEEN position_sec - listened_sec AND position_sec GROUP BY song_id")
def join_range(spark, sf_dir):
    return plays.lines_heard(positioned(spark, sf_dir), T.turns(spark, sf_dir))


@query(TIMED + " SELECT id, arg_max(line_idx, (t.time_sec, line_idx)) AS line_idx, arg_max(text, (t.time_sec, line_idx)) AS text FROM p JOIN turns t USING (song_id) WHERE t.time_sec <= position_sec GROUP BY id")
def join_asof(spark, sf_dir):
    return plays.line_at(positioned(spark, sf_dir), T.turns(spark, sf_dir))


@query(PL + """, f AS (SELECT *, coalesce(epoch_us(played_at) - epoch_us(lag(played_at) OVER w) > 86400000000, true)::INT AS far FROM plays WINDOW w AS (PARTITION BY song_id ORDER BY played_at, id)),
s AS (SELECT *, sum(far) OVER (PARTITION BY song_id ORDER BY played_at, id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT song_id, session::BIGINT AS session, min(played_at) AS started, max(played_at) AS ended, count(*) AS plays, round(sum(listened_sec), 4) AS listened_sec FROM s GROUP BY song_id, session""")
def session_tracker(spark, sf_dir):
    return plays.sessions(T.plays(spark, sf_dir), 86_400)


# ---- time axis and quality ----

SPAN_SQL = with_("turns") + """,
e AS (SELECT t.*, (SELECT arg_min(n.time_sec, n.line_idx) FROM turns n WHERE n.song_id = t.song_id AND n.line_idx > t.line_idx AND n.time_sec > t.time_sec) AS later, t.time_sec + greatest(5.0, least(12.0, 3 + 0.25 * length(t.text))) AS guess FROM turns t),
spans AS (SELECT song_id, line_idx, time_sec AS start_sec, CASE WHEN later IS NOT NULL AND later <= guess THEN later ELSE guess END AS end_sec, CASE WHEN later IS NOT NULL AND later <= guess THEN 'next_line' ELSE 'estimated' END AS kind FROM e)
"""


@query(SPAN_SQL + " SELECT song_id, line_idx, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, kind FROM spans")
def ts_line_spans(spark, sf_dir):
    return rounded(timeline.line_spans(T.turns(spark, sf_dir)))


@query(SPAN_SQL + """ SELECT song_id, line_idx, round(greatest(0.0, min(start_sec) OVER w - 0.4), 6) AS from_sec, round(max(end_sec) OVER w, 6) AS to_sec, count(*) OVER w AS lines FROM spans WINDOW w AS (PARTITION BY song_id ORDER BY line_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def ts_listen_window(spark, sf_dir):
    return rounded(timeline.listen_window(timeline.line_spans(T.turns(spark, sf_dir))))


Q_SQL = """turns AS (SELECT conv_id AS song_id, turn AS line_idx, text, (length(text) * 7919 % 120000) / 1000.0 AS time_sec FROM conversations),
m AS (SELECT *, max(time_sec) OVER (PARTITION BY song_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM turns),
b AS (SELECT *, last_value(CASE WHEN mx IS NULL OR time_sec >= mx THEN time_sec END IGNORE NULLS) OVER w AS p, last_value(CASE WHEN mx IS NULL OR time_sec >= mx THEN trim(text) END IGNORE NULLS) OVER w AS px FROM m WINDOW w AS (PARTITION BY song_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, length(trim(text)) > 80 AS long, coalesce(time_sec + 0.01 < p, false) AS back, coalesce(abs(time_sec - p) <= 0.01 AND NOT time_sec + 0.01 < p, false) AS same, coalesce(time_sec - p > 30, false) AS gap FROM b)"""


def jumbled(spark, sf_dir):
    """Turns with times that a rule scatters, so that every issue of timing occurs."""
    c = T.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("song_id"), F.col("turn").alias("line_idx"), "text", ((F.length("text") * 7919 % 120000) / 1000.0).alias("time_sec"))


@query("WITH " + Q_SQL + """ SELECT song_id, line_idx, concat_ws(',', CASE WHEN long THEN 'very_long_line' END, CASE WHEN back THEN 'non_monotonic' END, CASE WHEN same AND px = trim(text) THEN 'stacked_duplicate' END, CASE WHEN same AND px <> trim(text) THEN 'duplicate_timestamp' END, CASE WHEN gap AND NOT same THEN 'long_gap' END) AS issues,
    round(least(1.0, CASE WHEN back THEN 0.2 ELSE 1 END, CASE WHEN same THEN 0.5 ELSE 1 END, CASE WHEN gap THEN 0.7 ELSE 1 END), 3) AS confidence FROM i""")
def q_validate(spark, sf_dir):
    return timeline.line_issues(jumbled(spark, sf_dir))


@query("WITH " + Q_SQL + """,
r AS (SELECT *, count(*) OVER (PARTITION BY song_id, trim(text)) AS n FROM i),
l AS (SELECT song_id, count(*) AS lines, count(*) FILTER (WHERE n > 1) AS rep, count(*) FILTER (WHERE same AND px = trim(text)) AS s, count(*) FILTER (WHERE gap AND NOT same) AS g, count(*) FILTER (WHERE back) AS b, sum(len(regexp_extract_all(text, '[a-zA-Zａ-ｚＡ-Ｚ]'))) AS latin FROM r GROUP BY song_id)
SELECT song_id, lines, lines AS timed_lines, CASE WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS language, round(rep / lines, 3) AS repeated_ratio, round(greatest(0.0, 1 - (CASE WHEN latin > 0 THEN 0.2 ELSE 0 END) - least(0.2, 0.05 * s) - least(0.2, 0.05 * g) - least(0.2, 0.05 * b)), 3) AS completeness FROM l""")
def agg_quality_overview(spark, sf_dir):
    rows = jumbled(spark, sf_dir)
    return timeline.song_quality(rows, timeline.line_issues(rows))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def src_html_text(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


# ---- matching and reconciliation ----


@query("SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS key, count(*) OVER (PARTITION BY regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g')) AS same FROM part")
def str_matching_key(spark, sf_dir):
    from pyspark.sql import Window

    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.matching_key(F.col("p_name")).alias("key"))
    return p.withColumn("same", F.count("*").over(Window.partitionBy("key")))


@query("""WITH k AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_retailprice AS duration_sec, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM part)
SELECT a.id AS a, b.id AS b, CASE WHEN a.title = b.title THEN 1.0 ELSE 0.95 END AS title_score, CASE WHEN a.artist = b.artist THEN 1.0 ELSE 0.0 END AS artist_score FROM k a JOIN k b ON a.key = b.key AND a.id < b.id""")
def er_title_ladder(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_retailprice").alias("duration_sec"))
    return resolve.same_title_pairs(p)


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS path, o_orderpriority AS identity, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'F'), e AS (SELECT o_orderkey AS id, o_custkey AS path, o_orderpriority AS identity, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'O')
SELECT CASE WHEN s.id IS NULL THEN 'gone' WHEN e.id IS NULL THEN 'new' WHEN s.size <> e.size OR s.path <> e.path THEN 'changed' ELSE 'unchanged' END AS action, count(*) AS n FROM s FULL JOIN e ON s.id = e.id GROUP BY 1""")
def dd_sync_plan(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("identity"), F.col("o_totalprice").alias("size"), "o_orderstatus")
    return resolve.sync_plan(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'F'"), "id", ["size", "path"]).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS nth, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40) AS known FROM lineitem)
SELECT CASE WHEN known THEN 'have' WHEN nth > 1 THEN 'duplicate' ELSE 'new' END AS action, count(*) AS n FROM n GROUP BY 1""")
def dd_import_plan(spark, sf_dir):
    batch = T.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("file"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("title"), F.col("l_suppkey").alias("artist"))
    library_ = T.table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("title"))
    return resolve.import_plan(batch, library_, ["title"], ["title", "artist"], ["o", "l"]).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT l_orderkey AS song_id, l_linenumber AS version_no, l_returnflag AS source, l_shipdate AS made FROM lineitem)
SELECT song_id, max(version_no)::BIGINT AS current_version, arg_max(source, (version_no, source)) AS source, count(*) AS versions FROM v GROUP BY song_id""")
def lin_current_version(spark, sf_dir):
    v = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").cast("long").alias("version_no"), F.col("l_returnflag").alias("source"))
    return resolve.current_versions(v)


@query("""WITH s AS (SELECT l_orderkey AS song_id, l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS kind_rank, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS precision_rank, l_shipdate AS made FROM lineitem)
SELECT song_id, id::BIGINT AS id FROM s QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY kind_rank, precision_rank, made DESC, id) = 1""")
def src_choose(spark, sf_dir):
    rank = lambda c, values: F.coalesce(*[F.when(F.col(c) == v, F.lit(k)) for k, v in enumerate(values)], F.lit(len(values)))
    s = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").cast("long").alias("id"), rank("l_returnflag", ["R", "A"]).alias("kind_rank"), rank("l_linestatus", ["O"]).alias("precision_rank"), F.col("l_shipdate").alias("made"))
    return resolve.best_source(s)


# ---- work-lists, rosters, runs ----


@query(TOK + " SELECT lemma, pos, surface, n FROM (SELECT lemma, pos, surface, count(*) AS n, row_number() OVER (PARTITION BY lemma, pos ORDER BY count(*) DESC, surface) AS r FROM kept GROUP BY lemma, pos, surface) WHERE r = 1")
def agg_common_surface(spark, sf_dir):
    return frequency.common_surface(tokens(spark, sf_dir))


@query(with_("lines") + " SELECT d.doc_id AS song_id, d.source AS artist, count(line_idx) AS line_count FROM documents d LEFT JOIN lines ON lines.song_id = d.doc_id GROUP BY ALL")
def lib_tracks(spark, sf_dir):
    return library.tracks(T.songs(spark, sf_dir), T.lines(spark, sf_dir))


@query("SELECT source AS artist, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS in_library, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS removed FROM documents GROUP BY source")
def agg_source_counts(spark, sf_dir):
    return library.source_counts(T.songs(spark, sf_dir), T.removed_songs(spark, sf_dir), "artist")


@query("SELECT doc_id AS song_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def agg_needs_annotation(spark, sf_dir):
    return scope.live(T.songs(spark, sf_dir), T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("song_id"))).select("song_id")


@query("SELECT name, count(*) AS tracks FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS name FROM part) GROUP BY name")
def agg_artist_roster(spark, sf_dir):
    return library.roster(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_type").alias("artist")), " ")


@query(TOK + """,
a AS (SELECT lemma, pos, count(*) AS n FROM kept WHERE language = 'en' GROUP BY ALL), b AS (SELECT lemma, pos, count(*) AS n FROM kept WHERE language = 'fr' GROUP BY ALL)
SELECT lemma, pos, coalesce(a.n, 0) AS left_freq, coalesce(b.n, 0) AS right_freq, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM a FULL JOIN b USING (lemma, pos) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0) ORDER BY abs(coalesce(b.n, 0) - coalesce(a.n, 0)) DESC, lemma, pos LIMIT 200""")
def run_compare(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return runs.compare_words(*[frequency.word_frequency(t.where(F.col("language") == x), None) for x in ("en", "fr")])


@query(with_("lines", "tokens", "kept") + " SELECT (SELECT count(DISTINCT song_id) FROM lines) AS songs, (SELECT count(*) FROM lines) AS lines, (SELECT max(song_id) FROM lines) AS last_song, (SELECT max(line_idx)::BIGINT FROM lines) AS last_line, (SELECT count(*) FROM kept) AS tokens")
def agg_snapshot(spark, sf_dir):
    return runs.snapshot(T.lines(spark, sf_dir), tokens(spark, sf_dir)).drop("fingerprint")


@query("""SELECT CASE WHEN a THEN 'left' ELSE 'right' END AS side, song_id FROM (SELECT DISTINCT doc_id AS song_id, lang = 'en' AS a, source = 'src0' AS b FROM documents) WHERE a <> b""")
def run_scope_diff(spark, sf_dir):
    s = T.songs(spark, sf_dir)
    return runs.scope_difference(s.where("language = 'en'"), s.where("artist = 'src0'"))


@query("""WITH p AS (SELECT page_id, url, string_split(url, '/') AS x FROM pages), r AS (SELECT DISTINCT array_to_string(x[1:3], '/') AS root FROM p UNION SELECT DISTINCT array_to_string(x[1:4], '/') FROM p WHERE len(x) > 4)
SELECT DISTINCT url AS path, CASE WHEN len(x) >= 4 AND array_to_string(x[1:4], '/') IN (SELECT root FROM r) THEN array_to_string(x[1:4], '/') ELSE array_to_string(x[1:3], '/') END AS root FROM p""")
def join_longest_prefix(spark, sf_dir):
    """Roots are all hosts, and first folders of pages that lie deeper."""
    p = T.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.split("url", "/").alias("x"))
    cut = lambda n: F.array_join(F.slice("x", 1, n), "/").alias("root")
    roots = p.select(cut(3)).union(p.where(F.size("x") > 4).select(cut(4))).distinct()
    return resolve.longest_prefix(p.select("path").distinct(), roots)


@query(TOK + """,
g AS (SELECT song_id, line_idx, idx, lemma || ' ' || lead(lemma) OVER w AS words, lead(lemma) OVER w IS NOT NULL AND NOT lead(gap_before) OVER w AS ok, row_number() OVER (ORDER BY song_id, line_idx, idx) - 1 AS place FROM kept WINDOW w AS (PARTITION BY song_id, line_idx ORDER BY idx)),
p AS (SELECT song_id, words, place FROM g WHERE ok), z AS (SELECT song_id, count(*) AS size FROM kept GROUP BY song_id), t AS (SELECT sum(size)::DOUBLE AS n FROM z),
f AS (SELECT words, count(*) AS freq FROM p GROUP BY words HAVING count(*) >= 20), v AS (SELECT words, song_id, count(*) AS v FROM p GROUP BY ALL),
d AS (SELECT words, sum(abs(v / freq - size / n)) AS off, sum(size / n) AS covered FROM v JOIN z USING (song_id) JOIN f USING (words), t GROUP BY words),
h AS (SELECT words, freq, n, lead(place) OVER w - place AS gap, first_value(place) OVER w + n - place AS around FROM p JOIN f USING (words), t WINDOW w AS (PARTITION BY words ORDER BY place)),
a AS (SELECT words, sum(least(coalesce(gap, around), n / freq) / (n / freq)) AS arf FROM h GROUP BY words)
SELECT words, freq, round(greatest(0, least(1, 0.5 * (off + greatest(0, 1 - covered)))), 6) AS dp, round(arf, 6) AS arf FROM d JOIN f USING (words) JOIN a USING (words)""")
def corp_ngram_dispersion(spark, sf_dir):
    return rounded(frequency.ngram_dispersion(tokens(spark, sf_dir), 2, min_freq=20).select("words", "freq", "dp", "arf"))


@query(LT + """,
k AS (SELECT * FROM tokens WHERE pos NOT IN ('PUNCT', 'SYM')), h AS (SELECT song_id, line_idx, token_idx FROM k WHERE lemma = 'worthless'),
n AS (SELECT song_id, line_idx, token_idx, lead(lemma) OVER (PARTITION BY song_id, line_idx ORDER BY token_idx) AS after FROM k)
SELECT h.song_id, h.line_idx::BIGINT AS line_idx, h.token_idx::BIGINT AS token_idx, row_number() OVER (ORDER BY coalesce(after, ''), h.song_id, h.line_idx, h.token_idx) AS nth FROM h JOIN n USING (song_id, line_idx, token_idx) ORDER BY nth LIMIT 40""")
def kwic_sort(spark, sf_dir):
    """The first forty hits by the word to the right."""
    hits = search.kwic(T.lines(spark, sf_dir), ("worthless",), context=1)
    return search.sorted_hits(hits, ["right"], 40).select("song_id", "line_idx", "token_idx", "nth")


@query(TOK + " SELECT lemma, count(*) AS freq, count(DISTINCT song_id) AS songs FROM kept WHERE pos = 'NOUN' GROUP BY lemma HAVING count(*) >= 5")
def pick_words(spark, sf_dir):
    return frequency.pick_words(tokens(spark, sf_dir), ("NOUN",), 5)


from strophe import queries_history, queries_library, queries_matching, queries_morphology, queries_spans, queries_words  # noqa: E402, F401  they register their queries
