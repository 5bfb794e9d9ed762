"""Registered queries of the dictionary operators: the words of the documents are the dictionary, the texts looked up are the given tables'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import inflection
from strophe.operators import dictionary
from strophe.plans import stream
from strophe.queries import query, tokens, with_
from strophe.sources import tables as T

FLAGS = inflection.condition_flags(inflection.ENGLISH_CONDITIONS)
TOK = with_("lines", "tokens", "kept").replace("WITH ", "WITH RECURSIVE ", 1)
RULES_SQL = "rules(transform, place, a, b, cin, cout) AS (VALUES " + ", ".join(
    f"('{t}', {k}, '{a}', '{b}', {inflection.flags_of(FLAGS, before)}, {inflection.flags_of(FLAGS, after)})" for k, (t, a, b, before, after) in enumerate(inflection._ENGLISH)
) + ")"
#: Forms of the distinct words of ``words``.
FORMS_SQL = f"""{RULES_SQL},
d AS (SELECT word, word AS form, 0 AS conditions, []::VARCHAR[] AS names, []::BIGINT[] AS path, []::VARCHAR[] AS seen FROM words WHERE word <> ''
    UNION ALL SELECT word, left(form, length(form) - length(a)) || b, cout, list_prepend(transform, names), list_append(path, place), list_append(seen, place || '|' || form) FROM d JOIN rules ON suffix(form, a)
    WHERE (conditions = 0 OR conditions & cin <> 0) AND NOT list_contains(seen, place || '|' || form)),
forms AS MATERIALIZED (SELECT word, form, conditions, names, row_number() OVER (PARTITION BY word ORDER BY len(path), path) - 1 AS step FROM d)"""


@query(TOK + f""",
words AS (SELECT DISTINCT lemma AS word FROM kept), {FORMS_SQL}
SELECT word, form, conditions::BIGINT AS conditions, array_to_string(names, ' < ') AS rules, step::BIGINT AS place FROM forms""")
def dict_deinflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form that the endings of every word of the documents may come from."""
    out = dictionary.deinflected(tokens(spark, sf_dir).select(F.col("lemma").alias("word")), inflection.english_rules(spark))
    return out.select("word", "form", "conditions", F.array_join(dictionary.rule_names(F.col("trace")), " < ").alias("rules"), F.col("place").cast("long").alias("place"))


WIDE_SQL = "translate({0}, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ')"


@query(TOK + f""",
w AS (SELECT DISTINCT surface AS text, {WIDE_SQL.format("surface")} AS wide FROM kept)
SELECT text, 0::BIGINT AS place, text AS variant, '' AS chains FROM w UNION ALL SELECT text, 1::BIGINT, wide, 'width' FROM w WHERE wide <> text""")
def dict_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of every word of the documents but those in kana: these words aren't romanised Japanese."""
    processors = tuple(p for p in dictionary.PROCESSORS if p[0] != "alphabet")
    out = dictionary.variants(tokens(spark, sf_dir).select(F.col("surface").alias("text")), processors)
    chains = F.array_join(F.transform("chains", lambda c: F.array_join(c, "+")), " ")
    return out.select("text", F.col("place").cast("long").alias("place"), "variant", chains.alias("chains"))


ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
CONDITIONS = (("tion", "n"), ("ly", "adv"), ("ble", "adj"), ("ing", "v n"))
DEFAULT = "n v adj"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words as two dictionaries: all that stand twice, and those of five documents. A word in -ou is but another form of the word without it."""
    by_song = tokens(spark, sf_dir).groupBy("lemma", "song_id").agg(F.count("*").alias("n"))
    words = by_song.groupBy(F.col("lemma").alias("term")).agg(F.sum("n").alias("freq"), F.count("*").alias("songs")).where("freq >= 2")
    flags = F.lit(inflection.flags_of(FLAGS, DEFAULT))
    for ending, names in reversed(CONDITIONS):
        flags = F.when(F.col("term").endswith(ending), inflection.flags_of(FLAGS, names)).otherwise(flags)
    other = F.col("term").endswith("ou") & (F.length("term") > 4)
    of = F.array(F.struct(F.expr("substring(term, 1, length(term) - 2)").alias("form"), F.array(F.lit("-ou")).alias("rules")))
    shared = [F.col("term"), F.translate("term", ACCENTED, PLAIN).alias("reading"), flags.cast("long").alias("term_conditions"), (-F.col("freq")).cast("double").alias("frequency_order"), (~other).alias("content"), F.when(other, of).otherwise(F.expr("slice(array(named_struct('form', '', 'rules', array(''))), 1, 0)")).alias("forms_of")]
    one = words.select(F.concat(F.lit("1:"), "term").alias("id"), *shared, F.lit(1).alias("dictionary"), F.col("freq").cast("double").alias("score"))
    two = words.where("songs >= 5").select(F.concat(F.lit("2:"), "term").alias("id"), *shared, F.lit(2).alias("dictionary"), F.col("songs").cast("double").alias("score"))
    return one.unionByName(two)


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("text"))


TERM_FLAGS_SQL = "CASE " + " ".join(f"WHEN suffix(term, '{e}') THEN {inflection.flags_of(FLAGS, n)}" for e, n in CONDITIONS) + f" ELSE {inflection.flags_of(FLAGS, DEFAULT)} END"
BENCHMARK_SQL = r"texts AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS text FROM benchmark)"
LOOKUP_SQL = TOK + f""",
v AS (SELECT lemma AS term, count(*) AS freq, count(DISTINCT song_id) AS songs FROM kept GROUP BY lemma HAVING count(*) >= 2),
t AS MATERIALIZED (SELECT term, translate(term, '{ACCENTED}', '{PLAIN}') AS reading, {TERM_FLAGS_SQL} AS flags, -freq AS frequency, suffix(term, 'ou') AND length(term) > 4 AS other, dictionary, dictionary || ':' || term AS id, CASE dictionary WHEN 1 THEN freq ELSE songs END AS score
    FROM v, (VALUES (1), (2)) x(dictionary) WHERE dictionary = 1 OR songs >= 5),
{BENCHMARK_SQL},
starts AS (SELECT text, n, left(text, n) AS original FROM texts, range(1, 17) r(n) WHERE n <= length(text)),
words AS (SELECT DISTINCT original AS word FROM starts), {FORMS_SQL},
r0 AS MATERIALIZED (SELECT text, n, original, form, names, step, t.* FROM starts JOIN forms ON word = original JOIN (SELECT *, term AS met FROM t UNION ALL SELECT *, reading FROM t WHERE reading <> term) t ON form = met WHERE conditions = 0 OR conditions & flags <> 0),
r1 AS (SELECT r.text, r.n, r.original, t.met AS form, list_append(r.names, '-ou') AS names, r.step, t.* EXCLUDE (met) FROM r0 r JOIN (SELECT *, term AS met FROM t UNION ALL SELECT *, reading FROM t WHERE reading <> term) t ON left(r.term, length(r.term) - 2) = t.met WHERE r.other),
f AS (SELECT * FROM (SELECT *, 0 AS led FROM (SELECT * EXCLUDE (met) FROM r0) UNION ALL SELECT *, 1 FROM r1) WHERE NOT other QUALIFY n = max(n) OVER (PARTITION BY text, id)),
ways AS (SELECT text, id, list(names ORDER BY sorted) AS rules FROM (SELECT text, id, list_sort(names) AS sorted, min(names) AS names FROM f GROUP BY ALL) GROUP BY ALL),
e AS (SELECT f.text, f.id, any_value(term) AS term, any_value(reading) AS reading, any_value(original) AS original, arg_min(form, led * 1000 + step) AS form, any_value(dictionary) AS dictionary, any_value(score) AS score, any_value(frequency) AS frequency, any_value(rules) AS rules
    FROM f JOIN ways USING (text, id) GROUP BY f.text, f.id),
g AS (SELECT text, term, <reading> AS reading, any_value(original) AS original, rules, list(id ORDER BY frequency, dictionary, score DESC, id) AS ids, max(length(original)) AS n, count(*) FILTER (WHERE form = term) AS exact, min(frequency) AS frequency, min(dictionary) AS dictionary, max(score) AS score
    FROM e GROUP BY text, term, <by>rules),
o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n DESC, list_min(list_transform(rules, lambda x: len(x))), exact DESC, frequency, dictionary, score DESC, length(term) DESC, term, len(ids) DESC, reading, array_to_string(flatten(rules), ' ')) AS nth FROM g)
SELECT text, nth::BIGINT AS nth, term, reading, original, array_to_string(list_transform(rules, lambda x: array_to_string(x, ' < ')), '; ') AS rules, array_to_string(ids, ' ') AS ids FROM o WHERE nth <= 32"""


def _lookup(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out = dictionary.lookup(benchmark_words(spark, sf_dir), vocabulary(spark, sf_dir), inflection.english_rules(spark), mode, processors=())
    rules = F.array_join(F.transform("rules", lambda r: F.array_join(r, " < ")), "; ")
    return out.select("text", F.col("nth").cast("long").alias("nth"), "term", "reading", "original", rules.alias("rules"), F.array_join("ids", " ").alias("ids"))


@query(LOOKUP_SQL.replace("<reading>", "reading").replace("<by>", "reading, "))
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark looked up in the documents' words, terms of one spelling and reading together."""
    return _lookup(spark, sf_dir, "group")


@query(LOOKUP_SQL.replace("<reading>", "any_value(reading)").replace("<by>", ""))
def dict_lookup_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, terms of one spelling together."""
    return _lookup(spark, sf_dir, "term")


@query(TOK + f""",
{BENCHMARK_SQL},
s AS (SELECT song_id, line_idx, idx, list(surface) OVER (PARTITION BY song_id, line_idx ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS near FROM (SELECT song_id, line_idx, idx, lemma AS surface FROM kept)),
spans AS MATERIALIZED (SELECT * FROM (SELECT song_id, line_idx, idx AS start, idx + n AS stop, array_to_string(near[1:n], '') AS text FROM s, range(1, 17) r(n) WHERE n <= len(near)) WHERE length(text) <= 16),
words AS (SELECT DISTINCT text AS word FROM spans), {FORMS_SQL},
hits AS (SELECT DISTINCT word, form AS target FROM forms WHERE form IN (SELECT text FROM texts WHERE length(text) >= 6) AND (conditions = 0 OR conditions & {FLAGS["any"]} <> 0)),
found AS (SELECT song_id, line_idx, target, start, max(stop) AS stop FROM spans JOIN hits ON word = text GROUP BY ALL),
lists AS (SELECT song_id, line_idx, target, list([start, stop] ORDER BY start) AS x FROM found GROUP BY ALL),
chosen AS (SELECT song_id, line_idx, target, unnest(list_reduce(x, lambda acc, y: CASE WHEN y[1] >= acc[len(acc)][2] THEN list_append(acc, y) ELSE acc END, [[0, 0]])) AS s FROM lists)
SELECT song_id, line_idx, target, s[1]::BIGINT AS start, s[2]::BIGINT AS stop FROM chosen WHERE s[2] > 0""")
def dict_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the benchmark's words of six letters and more stand in the documents' lines, inflected or not."""
    rows = stream.marked(T.lines(spark, sf_dir)).select("song_id", "line_idx", F.col("kept.lemma").alias("surfaces"))
    targets = benchmark_words(spark, sf_dir).where(F.length("text") >= 6).distinct().select(F.col("text").alias("target"), F.lit(FLAGS["any"]).cast("long").alias("term_conditions"))
    return dictionary.occurrences(rows, targets, inflection.english_rules(spark), ["song_id", "line_idx"], processors=())
