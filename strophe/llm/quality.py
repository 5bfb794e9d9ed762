"""Document quality: base measures of a text and a short-circuit cascade of rules, all Spark expressions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import common

#: Rows of the sample on which rules are timed and counted.
SAMPLE_ROWS = 2_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more (first included)."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 2), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def some(h: Column) -> Column:
        # most texts repeat nothing, which a count of the different ones tells
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(by_places(h))

    def by_places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        starts = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"])))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"]

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), some))


def measured(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_lines and n_dup_lines of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return {
        "of_words": let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("rep"))),
        "of_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def measure(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (null text: none of each)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, lines = common.free_names(docs, "of_words", "of_lines")
    found = measured(text)
    out = common.once(docs.drop("n_symbols"), **{words: found["of_words"], lines: found["of_lines"], "n_symbols": found["n_symbols"]})
    named = {"n_words": F.col(words)["n"], "word_chars": F.col(words)["chars"], "n_repeat_words": F.col(words)["rep"], "n_lines": F.col(lines)["n"], "n_dup_lines": F.col(lines)["dup"]}
    return out.withColumns(named).drop(words, lines)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a Boolean Column over a document's columns and measures; null counts as not rejected."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 50), Rule("repetition", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))]


def text_rules() -> list[Rule]:
    """Rules on the text and its measures. All are about form, none about language."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.col("n_words")
    # signs and digits in words are few; letters are what else is in words
    letters = F.col("word_chars") - n(r"[^\p{L} \t\n\x0B\f\r]")
    # possessive, between blanks only: a run of any length is read once
    without_letter = n(r"(?<![^ \t\n\x0B\f\r])[^\p{L} \t\n\x0B\f\r]++(?![^ \t\n\x0B\f\r])")
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * words),
        Rule("long_words", F.col("word_chars") > 20 * words),
        Rule("short_words", F.col("word_chars") < 2 * words),
        Rule("few_letter_words", words - without_letter < 0.6 * words),
        Rule("shouting", n(r"\p{Lu}") > 0.5 * letters),
        Rule("ellipses", n(r"(?:…|\.\.\.)[\x20\x09-\x0D]*(?:\n|$)") > F.greatest(F.lit(3), F.lit(0.3) * F.size(F.split(text, "\n")))),
        Rule("duplicate_lines", F.col("n_dup_lines") > 0.5 * F.col("n_lines")),
    ]


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their estimated cost (seconds a row) and rejection share, most rejections per cost first.

    Measured on a bounded sample of about ``sample_rows`` rows, spread over the whole table. Each rule is timed
    alone over the cached sample, after one untimed pass. The order changes the work, never the verdict.
    """
    total = max(1, docs.count())
    sample = measure(docs.select("text").sample(min(1.0, sample_rows / total), seed=7).limit(2 * sample_rows).repartition(2)).persist()
    rows = max(1, sample.count())
    found = []
    for rule in rules:
        hit = sample.select(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long")))
        hit.first()
        began = time.perf_counter()
        rejected = hit.first()[0] or 0
        found.append((rule, max(time.perf_counter() - began, 1e-6) / rows, (rejected + 0.5) / (rows + 1)))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def verdict(ordered: list[Rule]) -> Column:
    """The first rule that rejects, by name, or null: a chain of CASE branches, each run only if none before it fired."""
    branch = F
    for rule in ordered:
        branch = branch.when(rule.rejects, F.lit(rule.name))
    return branch.otherwise(F.lit(None).cast("string")) if ordered else F.lit(None).cast("string")


def assess(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with its measures, base_failed, rejected_by and kept, one row for each row.

    Rows that fail the base rules skip the cascade. Null and empty texts have no words, fail the base rules and
    are not kept; very long texts are measured whole, in their own row; repeated rows get the same result each;
    an empty table gives no rows. Input columns named like a measure are replaced.
    """
    ordered = [rule for rule, _, _ in cascade_order(docs, text_rules() if rules is None else rules, sample_rows)]
    out = measure(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that ``assess`` keeps, with their own columns; here the base rules are links of the cascade too."""
    ordered = [rule for rule, _, _ in cascade_order(docs, base_rules() + (text_rules() if rules is None else rules), sample_rows)]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return measure(row).where(verdict(ordered).isNull()).select("row.*")
