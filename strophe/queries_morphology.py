"""Registered queries of tagged tokens: the documents' words are tagged by the endings that lead back to other words of theirs; accents are the spelling that plain letters can do without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import inflection
from strophe.operators import dictionary, morphology
from strophe.plans.rounds import settled
from strophe.queries import query, rounded, tokens
from strophe.queries_words import ACCENTED, FORMS_SQL, PLAIN, TOK

TAGGED_SQL = TOK + f""",
v AS (SELECT lemma FROM kept GROUP BY lemma HAVING count(*) >= 2),
words AS (SELECT DISTINCT lemma AS word FROM kept), {FORMS_SQL},
base AS (SELECT word, arg_min(form, step) AS form, arg_min(names, step) AS names FROM forms WHERE step > 0 AND length(form) >= 3 AND form IN (SELECT lemma FROM v) GROUP BY word),
t AS MATERIALIZED (SELECT k.song_id, k.lemma, k.surface, k.pos, CASE WHEN b.word IS NULL THEN '' ELSE 'regular' END AS ctype, coalesce(array_to_string(list_reverse(b.names), '-'), '') AS cform, translate(k.lemma, '{ACCENTED}', '{PLAIN}') AS reading, coalesce(b.form, k.lemma) AS normalized FROM kept k LEFT JOIN base b ON b.word = k.lemma)"""


def tagged_words(t: DataFrame) -> DataFrame:
    """lemma and TAGS: each word of the tokens ``t`` with the nearest one that its endings lead back to as what it is a form of."""
    words = settled(t.groupBy("lemma").agg(F.count("*").alias("n")))
    known = words.where("n >= 2").select(F.col("lemma").alias("form"))
    forms = dictionary.deinflected(words.select(F.col("lemma").alias("word")), inflection.english_rules(t.sparkSession)).where((F.col("place") > 0) & (F.length("form") >= 3))
    base = forms.join(known, "form").groupBy("word").agg(F.min_by(F.struct("form", F.array_join(F.reverse(dictionary.rule_names(F.col("trace"))), "-").alias("names")), "place").alias("b"))
    words = words.select("lemma").join(base, F.col("lemma") == F.col("word"), "left")
    return words.select("lemma", F.when(F.col("b").isNull(), "").otherwise("regular").alias("ctype"), F.coalesce("b.names", F.lit("")).alias("cform"), F.translate("lemma", ACCENTED, PLAIN).alias("reading"), F.coalesce("b.form", "lemma").alias("normalized"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tokens with what ``tagged_words`` says of them."""
    t = tokens(spark, sf_dir)
    return morphology.tagged(t, tagged_words(t))


@query(TAGGED_SQL + """,
a AS (SELECT cform, count(*) AS freq, count(DISTINCT song_id) AS songs FROM t WHERE cform <> '' GROUP BY cform),
l AS (SELECT cform, string_agg(lemma || ' ' || n, ', ' ORDER BY nth) AS x FROM (SELECT cform, lemma, count(*) AS n, row_number() OVER (PARTITION BY cform ORDER BY count(*) DESC, lemma) AS nth FROM t WHERE cform <> '' GROUP BY cform, lemma) WHERE nth <= 6 GROUP BY cform),
s AS (SELECT cform, string_agg(surface || ' ' || n, ', ' ORDER BY nth) AS x FROM (SELECT cform, surface, count(*) AS n, row_number() OVER (PARTITION BY cform ORDER BY count(*) DESC, surface) AS nth FROM t WHERE cform <> '' GROUP BY cform, surface) WHERE nth <= 6 GROUP BY cform)
SELECT cform, string_split(cform, '-')[1] AS coarse, freq, round(freq / (SELECT sum(freq) FROM a), 6) AS share, songs, l.x AS lemmas, s.x AS surfaces FROM a JOIN l USING (cform) JOIN s USING (cform)""")
def corp_inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each inflected form stands in the documents."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["value"], x["n"].cast("string"))), ", ").alias(c)
    return rounded(morphology.inflection(tagged(spark, sf_dir)).select("cform", "coarse", "freq", "share", "songs", said("lemmas"), said("surfaces")))


@query(TAGGED_SQL + " SELECT song_id, count(*) AS tokens, count(DISTINCT lemma) AS lemmas FROM t WHERE starts_with(cform, '-ing') GROUP BY song_id")
def flt_cform_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document whose form begins with -ing."""
    t = tokens(spark, sf_dir)
    return morphology.form_counts(t, tagged_words(t), "-ing")


def accents(word: Column) -> Column:
    return F.when(word.rlike(f"[{ACCENTED}]"), "kanji").when(word.rlike("^[a-z]+$"), "kana").otherwise("other")


@query(TAGGED_SQL + f""",
k AS (SELECT * FROM t WHERE pos <> 'ADP'),
w AS (SELECT normalized, pos, ctype, CASE WHEN ctype <> '' THEN '' WHEN regexp_matches(normalized, '[{ACCENTED}]') THEN 'kanji' WHEN regexp_matches(normalized, '^[a-z]+$') THEN 'kana' ELSE 'other' END AS how, CASE WHEN ctype = '' THEN reading ELSE '' END AS main FROM k GROUP BY ALL),
j AS (SELECT pos, main, min(normalized) AS target FROM w WHERE how = 'kanji' GROUP BY pos, main HAVING count(*) = 1),
g AS (SELECT w.normalized, w.pos, j.target FROM w JOIN j ON j.pos = w.pos AND j.main = w.main WHERE how = 'kana'),
m AS (SELECT k.*, g.target IS NOT NULL AS merged, coalesce(g.target, k.normalized) AS word FROM k LEFT JOIN g ON g.normalized = k.normalized AND g.pos = k.pos AND k.ctype = ''),
f AS (SELECT word, pos, ctype, lemma, count(*) AS freq, count(DISTINCT song_id) AS songs, bool_or(merged) AS merged FROM m GROUP BY ALL),
r AS (SELECT word, pos, ctype, reading, row_number() OVER (PARTITION BY word, pos, ctype ORDER BY count(*) DESC, reading) AS nth FROM m WHERE ctype = '' GROUP BY word, pos, ctype, reading),
h AS (SELECT *, count(*) OVER p AS forms, sum(freq) OVER p AS all_freq, bool_or(merged) OVER p AS any_merged FROM f WINDOW p AS (PARTITION BY word, pos, ctype))
SELECT h.word AS normalized, h.pos, coalesce(r.reading, '') AS reading, lemma, freq, songs, any_merged AS merged FROM h LEFT JOIN r ON r.word = h.word AND r.pos = h.pos AND r.ctype = h.ctype AND r.nth = 1 WHERE forms >= 2 AND all_freq >= 5""")
def corp_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the documents' words; words without accents go to the one word with accents that they read like."""
    t = tokens(spark, sf_dir)
    return morphology.word_spellings(t, tagged_words(t), written=accents)
