"""Dictionary look-up of running text: spellings, inflected forms, terms, occurrences.

All rewriting runs over distinct strings: a form that a million lines hold is rewritten once. Rules and terms are met by
equi-joins on endings and on whole forms, so no string is compared with every rule or every term.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from strophe.functions import kana
from strophe.plans.rounds import once, settled

#: Most characters of a text that a look-up takes from its beginning.
SCAN = 16
#: Rows of a side up to which it is broadcast, two texts of at most ``SCAN`` characters each; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
TRACE = "array<struct<transform:string,place:long,text:string>>"
CHAINS = "array<array<string>>"


# ---- spellings ----

#: A name, and what gives for an array of texts arrays of their other spellings.
Processor = tuple[str, Callable[[Column], list[Column]]]


def _each(*ways: Callable[[Column], Column]) -> Callable[[Column], list[Column]]:
    return lambda texts: [F.transform(texts, way) for way in ways]


#: In the order in which they are tried.
PROCESSORS: tuple[Processor, ...] = (
    ("half width", _each(kana.full_width_kana)),
    ("alphabet", lambda texts: [kana.hiragana_of_latin(texts)]),
    ("combining", _each(kana.composed)),
    ("compatibility", _each(kana.compatible)),
    ("radicals", _each(kana.radicals)),
    ("width", _each(kana.narrow, kana.wide)),
    ("kana", _each(kana.to_katakana, kana.spoken_hiragana)),
    ("emphasis", _each(lambda c: kana.collapsed(c, False), lambda c: kana.collapsed(c, True))),
)


def variants(texts: DataFrame, processors: tuple[Processor, ...] = PROCESSORS) -> DataFrame:
    """text, place (from 0), variant and chains: the ways, as lists of processors, that lead from each distinct text to the spelling.

    A processor takes every spelling so far to itself and to its results. Spellings met twice keep the first's place and all
    ways, but a spelling that stays as it is adds no way where it was met before. Null texts are left out.
    """
    rows = texts.select("text").where(F.col("text").isNotNull()).distinct()
    rows = rows.withColumn("v", F.array(F.struct(F.col("text").alias("t"), F.array(F.array().cast("array<string>")).alias("c"))))
    for name, process in processors:
        made = process(F.col("v.t"))
        rows = rows.withColumns({f"m{k}": m for k, m in enumerate(made)})

        results_of, step = len(made), F.array(F.lit(name))

        def grown(v: Column, k: Column) -> Column:  # used at once
            longer = F.transform(v["c"], lambda chain: F.concat(chain, step))  # noqa: B023
            results = [F.get(F.col(f"m{i}"), k) for i in range(results_of)]  # noqa: B023
            entries = [F.struct(r.alias("t"), F.when(r == v["t"], v["c"]).otherwise(longer).alias("c"), (r == v["t"]).alias("same")) for r in results]
            return F.array(F.struct(v["t"].alias("t"), v["c"].alias("c"), F.lit(True).alias("same")), *entries)

        rows = once(rows, "e", F.flatten(F.transform("v", grown)))

        def merged(t: Column) -> Column:
            first = F.array_position(F.col("e.t"), t) - 1
            mine = F.filter("e", lambda x, k: (x["t"] == t) & (~x["same"] | (k == first)))
            return F.struct(t.alias("t"), F.flatten(F.transform(mine, lambda x: x["c"])).alias("c"))

        rows = once(rows, "v", F.transform(F.array_distinct("e.t"), merged)).drop("e", *[f"m{k}" for k in range(len(made))])
    return rows.select("text", F.posexplode("v").alias("place", "v")).select("text", "place", F.col("v.t").alias("variant"), F.col("v.c").alias("chains"))


# ---- inflected forms ----


def deinflected(words: DataFrame, rules: DataFrame, most_rounds: int = 32) -> DataFrame:
    """word, form, conditions, trace (newest rule first) and place: every form that ``rules`` lead to from each distinct word.

    Rounds go breadth first: each form's endings are joined with the rules' endings. A rule may not meet the same text twice in
    one trace, so loops end; rules that lengthen words for ever raise after ``most_rounds``. Place 0 is the word itself, without conditions; forms follow by
    round, then by the form they come from, then by rule. Null and empty words are left out. ``rules`` has to be small against words.
    """
    lengths = [r[0] for r in rules.select(F.length("inflected").alias("n")).distinct().orderBy("n").collect()]  # as many as lengths of endings
    rule = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    frontier = words.select("word").where("word <> ''").distinct()
    frontier = frontier.select("word", F.col("word").alias("form"), F.lit(0).cast("long").alias("conditions"), F.array().cast(TRACE).alias("trace"))
    rounds = [settled(frontier)]
    for _ in range(most_rounds):
        endings = F.array(*[F.when(F.length("form") >= n, F.right("form", F.lit(n))) for n in lengths])
        ends = rounds[-1].withColumn("ending", F.explode(F.array_compact(endings)))
        met = ends.join(rule, F.col("ending") == F.col("r_inflected"))
        met = met.where((~F.col("r_whole") | (F.col("form") == F.col("ending"))) & ((F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("r_conditions_in")) != 0)))
        met = met.where(~F.exists("trace", lambda s: (s["place"] == F.col("r_place")) & (s["text"] == F.col("form"))))
        stem = F.expr("substring(form, 1, length(form) - length(ending))")
        step = F.struct(F.col("r_transform").alias("transform"), F.col("r_place").alias("place"), F.col("form").alias("text"))
        frontier = settled(met.select("word", F.concat(stem, "r_deinflected").alias("form"), F.col("r_conditions_out").alias("conditions"), F.concat(F.array(step), "trace").alias("trace")))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    else:
        raise RuntimeError(f"rules still lead on after {most_rounds} rounds")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    path = F.transform(F.reverse("trace"), lambda s: s["place"])
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.size("trace"), path)) - 1  # the forms of one word
    return out.withColumn("place", place)


def rule_names(trace: Column) -> Column:
    return F.transform(trace, lambda s: s["transform"])


def algorithm(texts: DataFrame, rules: DataFrame, processors: tuple[Processor, ...] = PROCESSORS, scan: int = SCAN) -> DataFrame:
    """text, original (a beginning of it, longest first by place), transformed (a spelling of that), chains, form, conditions, rules (names, newest
    first) and place (array: order of the results of a text) for every beginning of each distinct text."""
    starts = texts.select("text").where("text <> ''").distinct()
    starts = starts.select("text", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(scan)))).alias("n"))
    starts = starts.select("text", "n", F.expr("substring(text, 1, n)").alias("original"))
    spelled = settled(variants(starts.select(F.col("original").alias("text")), processors).withColumnsRenamed({"text": "original", "place": "nth"}))
    forms = deinflected(spelled.select(F.col("variant").alias("word")), rules).withColumnRenamed("place", "step")
    found = starts.join(spelled, "original").join(forms, F.col("variant") == F.col("word"))
    return found.select("text", "original", F.col("variant").alias("transformed"), "chains", "form", "conditions", rule_names(F.col("trace")).alias("rules"), F.array(-F.col("n"), F.col("nth"), F.col("step")).cast("array<long>").alias("place"))


# ---- terms ----


def matched(forms: DataFrame, terms: DataFrame) -> DataFrame:
    """``forms`` with each term whose spelling or, else, reading is the form and whose word class the form's conditions allow.

    A form without conditions may be any term; one with conditions needs a term that shares a bit. Two equi-joins instead of one on either.
    """
    by_term = forms.join(terms, F.col("form") == F.col("term")).withColumn("by", F.lit("term"))
    by_reading = forms.join(terms, F.col("form") == F.col("reading")).where("term <> reading").withColumn("by", F.lit("reading"))
    fits = (F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("term_conditions")) != 0)
    return by_term.unionByName(by_reading).where(fits)


def lookup(texts: DataFrame, terms: DataFrame, rules: DataFrame, mode: str = "group", limit: int = 32, processors: tuple[Processor, ...] = PROCESSORS, scan: int = SCAN, redirects: int = 1) -> DataFrame:
    """The terms that each distinct text begins with, best first.

    ``terms``: id, term, reading (blank: the term), term_conditions, dictionary (number, first counts most), score, frequency_order, content (it has a meaning
    of its own), forms_of (array of struct of form and rules: what it is a form of). All beginnings of a text, their spellings and forms are looked up;
    terms that are forms of others lead on to these, ``redirects`` times; terms without content are then left out.

    A term that is found in several ways keeps the longest spelling's; ways of equal length add their chains of rules.
    ``mode``: "simple" or "split" give a row for each term; "term" puts terms of one spelling and chains together, "group" those of one spelling, reading and
    chains. Order: longest beginning, fewest processors, fewest rules, found as spelled, frequency, dictionary, score, longer term, term, more meanings.
    Returns text, nth (from 1, at most ``limit``), term, reading, original, rules (chains), ids (in their order), n_processors.
    """
    if mode not in ("simple", "split", "term", "group"):
        raise ValueError(f"no such mode: {mode}")
    terms = terms.withColumn("reading", F.coalesce(F.nullif("reading", F.lit("")), F.col("term")))
    rows = settled(matched(algorithm(texts, rules, processors, scan), terms).withColumn("source", F.when(F.size("rules") > 0, "algorithm").otherwise("")))
    found = rows
    for step in range(redirects):
        led = rows.where(F.size("forms_of") > 0).select("text", "original", "transformed", "chains", "rules", "source", "place", F.col("id").alias("via"), F.posexplode("forms_of").alias("k", "f"))
        led = led.select(
            "text", "original", "transformed", "chains", F.col("f.form").alias("form"), F.lit(0).cast("long").alias("conditions"), F.concat("rules", F.coalesce("f.rules", F.array().cast("array<string>"))).alias("rules"),
            F.concat("place", F.array(F.xxhash64("via"), F.col("k").cast("long"))).alias("place"), F.when(F.col("source") == "", "dictionary").otherwise("both").alias("source"),
        )
        rows = settled(matched(led.where("form <> ''"), terms))
        found = found.unionByName(rows)
    found = found.where("content").withColumn("redirected", F.col("source").isin("dictionary", "both"))
    longest = F.max(F.length("transformed")).over(Window.partitionBy("text", "id"))
    found = found.withColumn("longest", longest).where(F.length("transformed") == F.col("longest"))
    first = F.struct("redirected", F.size("place"), "place")
    chain = F.struct(F.array_sort("rules").alias("sorted"), F.col("rules").alias("rules"))
    entry = found.groupBy("text", "id").agg(
        *[F.min_by(c, first).alias(c) for c in ("term", "reading", "original", "form", "dictionary", "score", "frequency_order")],
        F.min(first).alias("first"), F.array_sort(F.collect_set(chain)).alias("ways"), F.min(F.array_min(F.transform("chains", lambda c: F.size(c)))).alias("n_processors"),
    )
    # ways of the same rules in another order are one
    entry = entry.withColumn("rules", F.transform(F.array_distinct("ways.sorted"), lambda s: F.filter("ways", lambda w: w["sorted"] == s)[0]["rules"])).drop("ways")
    key = {"term": ["text", "term", "rules"], "group": ["text", "term", "reading", "rules"]}.get(mode, ["text", "id"])
    definition = F.struct("frequency_order", "dictionary", (-F.col("score")).alias("less"), F.col("first"), "id")
    grouped = entry.groupBy(*key).agg(
        *[F.min_by(c, "first").alias(c) for c in ("term", "reading", "original", "rules") if c not in key],
        F.array_sort(F.collect_list(definition)).alias("definitions"), F.max(F.length("original")).alias("length"), F.min("n_processors").alias("n_processors"), F.count_if(F.col("form") == F.col("term")).alias("exact"),
        F.min("frequency_order").alias("frequency"), F.min("dictionary").alias("best_dictionary"), F.max("score").alias("best_score"),
    )
    grouped = grouped.withColumn("ids", F.col("definitions.id"))
    shortest = F.array_min(F.transform("rules", lambda r: F.size(r)))
    order = [F.desc("length"), "n_processors", shortest, F.desc("exact"), "frequency", "best_dictionary", F.desc("best_score"), F.desc(F.length("term")), "term", F.desc(F.size("ids")), "reading", F.array_join(F.flatten("rules"), " ")]
    nth = F.row_number().over(Window.partitionBy("text").orderBy(*order))  # the entries of one text
    return grouped.withColumn("nth", nth).where(F.col("nth") <= limit).select("text", "nth", "term", "reading", "original", "rules", "ids", "n_processors")


# ---- occurrences in lines ----


@F.pandas_udf(ArrayType(StructType().add("start", "integer").add("stop", "integer")))
def _in_turn(spans: pd.Series) -> pd.Series:
    """Of spans sorted by start, from the left those that begin where the one before has ended."""

    def chosen(line):
        out, free = [], 0
        for s in line:
            if s["start"] >= free:
                out.append({"start": s["start"], "stop": s["stop"]})
                free = s["stop"]
        return out

    return spans.map(chosen)


def spans_of(lines: DataFrame, key: list[str], scan: int = SCAN, starts: DataFrame | None = None) -> DataFrame:
    """``key``, start, stop (exclusive) and text of every run of a line's ``surfaces`` (array) of at most ``scan`` characters, without blanks between.
    ``starts`` (first, few enough to broadcast) leaves only runs with one of these first tokens."""
    lines = once(lines.select(*key, "surfaces"), "surfaces", F.col("surfaces"))
    # single places, as a slice would read the whole line for each token
    near = F.transform("surfaces", lambda x, i: F.transform(F.sequence(i, F.least(i + scan, F.size("surfaces")) - 1), lambda k: F.get(F.col("surfaces"), k)))
    rows = lines.select(*key, F.posexplode(near).alias("start", "near")).withColumn("first", F.get("near", F.lit(0))).where("first <> ''")
    rows = rows if starts is None else rows.join(F.broadcast(starts), "first", "left_semi")
    length = lambda a, x: a["length"] + F.coalesce(F.length(x), F.lit(0))
    room = F.aggregate("near", F.struct(F.lit(0).alias("length"), F.lit(0).alias("n")), lambda a, x: F.struct(length(a, x).alias("length"), (a["n"] + (length(a, x) <= scan).cast("int")).alias("n")), lambda a: a["n"])
    ends = F.transform(F.slice(F.sequence(F.lit(1), F.lit(scan)), F.lit(1), room), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(F.col("near"), F.lit(1), n), "").alias("text")))
    rows = rows.select(*key, "start", F.explode(ends).alias("e"))
    return rows.select(*key, "start", (F.col("start") + F.col("e.n")).alias("stop"), F.col("e.text").alias("text"))


def inflections(targets: DataFrame, rules: DataFrame, scan: int = SCAN, most_rounds: int = 32) -> DataFrame:
    """word and target: every word of at most ``scan`` characters that ``deinflected`` leads to a target whose ``term_conditions`` its conditions fit.

    The rules backwards, from the targets: work grows with the targets and not with the words of a corpus. Rules must not lengthen words, else longer words may
    lie between. A state met before leads to nothing new: where a rule meets a text twice, what follows the second time may as well follow the first.
    """
    lengths = [r[0] for r in rules.select(F.length("deinflected").alias("n")).distinct().orderBy("n").collect()]
    rule = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    state = ["target", "form", "need"]
    frontier = settled(targets.where("target <> ''").select("target", F.col("target").alias("form"), F.col("term_conditions").alias("need")).where(F.length("target") <= scan).distinct())
    seen = frontier
    for _ in range(most_rounds):
        endings = F.array(*[F.when(F.length("form") >= n, F.right("form", F.lit(n))) for n in lengths])
        met = frontier.withColumn("ending", F.explode(F.array_compact(endings))).join(rule, F.col("ending") == F.col("r_deinflected"))
        met = met.where((F.col("r_conditions_out") == 0) | (F.col("r_conditions_out").bitwiseAND(F.col("need")) != 0)).withColumn("stem", F.expr("substring(form, 1, length(form) - length(ending))"))
        met = met.where(~F.col("r_whole") | (F.col("stem") == "")).select("target", F.concat("stem", "r_inflected").alias("form"), F.col("r_conditions_in").alias("need"))
        frontier = settled(met.where(F.length("form") <= scan).distinct().join(seen, state, "left_anti"))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    else:
        raise RuntimeError(f"rules still lead on after {most_rounds} rounds")
    return seen.where("form <> ''").select(F.col("form").alias("word"), "target").distinct()


def occurrences(lines: DataFrame, targets: DataFrame, rules: DataFrame, key: list[str], processors: tuple[Processor, ...] = PROCESSORS, scan: int = SCAN) -> DataFrame:
    """Where ``targets`` (target, term_conditions) stand in lines, inflected or not, beginning and ending at borders of tokens.

    ``lines`` has ``key`` and surfaces (array of tokens). A run of tokens counts if one of its spellings' forms is the target and the target's word class allows
    the form's conditions; a target without word class stands only as it is. Of a target's runs in a line the longest at the first token counts, then what begins after it.
    Rules that do not lengthen words are taken from the targets back, and without processors runs that are no such word move nowhere.
    Returns ``key``, target, start and stop (tokens, exclusive).
    """
    spans = spans_of(lines, key, scan)
    spelled = variants(spans.select("text"), processors).select("text", "variant") if processors else None
    if processors or not rules.where(F.length("deinflected") > F.length("inflected")).isEmpty():
        spelled = settled(spelled if processors else spans.select("text", F.col("text").alias("variant")).distinct())
        forms = deinflected(spelled.select(F.col("variant").alias("word")), rules).select(F.col("word").alias("variant"), "form", "conditions")
        fits = (F.col("conditions") == 0) | (F.col("conditions").bitwiseAND(F.col("term_conditions")) != 0)
        hits = forms.join(targets, F.col("form") == F.col("target")).where(fits).select("variant", "target").distinct()
        known = settled(spelled.join(hits, "variant").select("text", "target").distinct())
    else:
        known = settled(inflections(targets, rules, scan).withColumnRenamed("word", "text"))
    if known.count() <= BROADCAST_ROWS:  # at most ``scan`` beginnings each
        beginnings = F.transform(F.sequence(F.lit(1), F.length("text")), lambda n: F.left(F.col("text"), n))
        spans = spans_of(lines, key, scan, known.where("text <> ''").select(F.explode(beginnings).alias("first")).distinct())
        known = F.broadcast(known)
    found = spans.join(known, "text").groupBy(*key, "target", "start").agg(F.max("stop").alias("stop"))
    lists = found.groupBy(*key, "target").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # one line's hits of one target
    return lists.select(*key, "target", F.explode(_in_turn("spans")).alias("s")).select(*key, "target", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))
