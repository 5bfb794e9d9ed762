"""Word frequency, dispersion, n-grams and the corpus report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.measures import per_10k
from strophe.plans import stream as S
from strophe.plans.scope import DISTINCT_LINES, TOKENS

COVERAGE = (100, 500, 1000, 2000)


def frequency(tokens: DataFrame, unit: str = TOKENS, pos: str | None = None, limit: int | None = 500) -> DataFrame:
    """Lemma by part of speech: freq in the unit, per_10k, raw and distinct-line freq, repeat_share, songs, range and the five
    most frequent surfaces. The denominators ignore ``pos``; range counts against all songs with any token."""
    word = ["lemma", "pos"]
    of_unit = F.lit(True) if unit == TOKENS else ~F.col("repeat")
    total, songs = tokens.agg(F.count_if(of_unit).alias("_total"), F.count_distinct("song_id").alias("_songs")), "_songs"
    rows = tokens.where(F.col("pos") == pos) if pos else tokens
    # a row for each word and song first: what follows is small, and a word of every text is no hot group
    by_song = rows.groupBy(*word, "song_id").agg(F.count("*").alias("raw"), F.count_if(~F.col("repeat")).alias("distinct"), F.max(of_unit).alias("there"))
    counts = by_song.groupBy(*word).agg(F.sum("raw").alias("raw_freq"), F.sum("distinct").alias("distinct_freq"), F.count_if("there").alias("songs"))
    surface = rows.groupBy(*word, "surface").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*word).orderBy(F.desc("n"), "surface"))
    top = surface.withColumn("nth", nth).where("nth <= 5").groupBy(*word).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "surface"))), lambda x: x["surface"]), " ").alias("surfaces"))
    freq = F.col("raw_freq") if unit == TOKENS else F.col("distinct_freq")
    out = counts.withColumn("freq", freq).where("freq > 0").join(F.broadcast(total))  # one row
    out = out.select(*word, "freq", per_10k(F.col("freq"), F.col("_total")).alias("per_10k"), "raw_freq", "distinct_freq", (1 - F.col("distinct_freq") / F.col("raw_freq")).alias("repeat_share"), "songs", (F.col("songs") / F.greatest(songs, F.lit(1))).alias("range"))
    if limit is not None:
        out = out.orderBy(F.desc("freq"), *word).limit(limit)
    return out.join(top, word)


def dispersion(tokens: DataFrame, key: list[str], unit: str = TOKENS) -> DataFrame:
    """For each key: freq, dp, dp_norm, juilland_d and arf over songs as parts.

    Positions stay arrays within one song; gaps across songs run over a bucket of songs, then over buckets, so the most
    frequent word is no longer group than a rare one.
    """
    return dispersion_at(S.positions(S.counted(tokens, unit)), key)


def dispersion_at(placed: DataFrame, key: list[str], parts: DataFrame | None = None) -> DataFrame:
    """``dispersion`` of rows with song_id, bucket, size (of the song) and at (place in the stream). ``parts`` gives all
    songs' sizes where the rows do not stand for every token."""
    songs = parts if parts is not None else placed.groupBy("song_id").agg(F.first("size").alias("size"))
    corpus = songs.agg(F.sum("size").cast("double").alias("N"), F.count("*").alias("n_parts"), F.min("size").alias("least"))
    per_song = placed.groupBy(*key, "song_id", "bucket").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("at")).alias("p"))  # at most a song's tokens
    per_song = per_song.withColumn("v", F.size("p"))
    freq = per_song.groupBy(*key).agg(F.sum("v").alias("freq"))
    rows = per_song.join(freq, key).join(F.broadcast(corpus))  # one row
    step = F.col("N") / F.col("freq")
    within = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1, F.lit(1)), F.lit(0.0), lambda a, i: a + F.least((F.get("p", i) - F.get("p", i - 1)).cast("double"), step))
    rows = rows.withColumn("gaps", F.when(F.col("v") > 1, within).otherwise(0.0)).withColumn("first", F.get("p", F.lit(0))).withColumn("last", F.get("p", F.col("v") - 1))
    share, rel = F.col("size") / F.col("N"), F.col("v") / F.col("size")
    to_last = F.col("first") - F.lag("last").over(Window.partitionBy(*key, "bucket").orderBy("song_id"))
    rows = rows.withColumn("gaps", F.col("gaps") + F.when(to_last.isNotNull(), F.least(to_last.cast("double"), step)).otherwise(0.0))
    buckets = rows.groupBy(*key, "bucket").agg(
        F.sum("gaps").alias("gaps"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("freq").alias("freq"), F.first("N").alias("N"), F.first("n_parts").alias("n_parts"), F.first("least").alias("least"),
        F.sum(F.abs(F.col("v") / F.col("freq") - share)).alias("off"), F.sum(share).alias("covered"), F.sum(rel).alias("rel"), F.sum(rel * rel).alias("rel2"),
    )
    to_last = F.col("first") - F.lag("last").over(Window.partitionBy(*key).orderBy("bucket"))
    buckets = buckets.withColumn("gaps", F.col("gaps") + F.when(to_last.isNotNull(), F.least(to_last.cast("double"), step)).otherwise(0.0))
    out = buckets.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("gaps", "off", "covered", "rel", "rel2")], F.min("first").alias("first"), F.max("last").alias("last"), *[F.first(c).alias(c) for c in ("freq", "N", "n_parts", "least")])
    dp = unit_range(0.5 * (F.col("off") + F.greatest(F.lit(0.0), 1 - F.col("covered"))))
    mean = F.col("rel") / F.col("n_parts")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("rel2") / F.col("n_parts") - mean * mean))
    around = F.least(F.col("first") + F.col("N") - F.col("last"), step)
    return out.select(
        *key, "freq", dp.alias("dp"),
        F.when(F.col("least") < F.col("N"), unit_range(dp / (1 - F.col("least") / F.col("N")))).otherwise(0.0).alias("dp_norm"),
        F.when(F.col("n_parts") > 1, unit_range(1 - sd / mean / F.sqrt(F.col("n_parts") - F.lit(1)))).alias("juilland_d"),
        ((F.col("gaps") + around) / step).alias("arf"),
    )


def unit_range(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ngrams(tokens: DataFrame, n: int = 2, unit: str = TOKENS, min_freq: int = 2, min_songs: int = 2, contains: str | None = None, limit: int | None = 200) -> DataFrame:
    """Sequences of ``n`` (2 to 6) lemmas of one line without dropped tokens between: words, surface (most frequent), freq,
    per_10k, songs, range. Order freq, songs, words."""
    n = max(2, min(6, n))
    rows = S.counted(tokens, unit)
    corpus = rows.agg(F.count("*").alias("_total"), F.count_distinct("song_id").alias("_songs"))
    line = Window.partitionBy("song_id", "line_idx").orderBy("idx")
    ahead = lambda c, k: F.lead(c, k).over(line) if k else F.col(c)
    whole = F.lit(True)
    for k in range(1, n):
        whole &= ahead("lemma", k).isNotNull() & ~ahead("gap_before", k)
    rows = rows.select("song_id", F.array(*[ahead("lemma", k) for k in range(n)]).alias("w"), F.concat(*[ahead("surface", k) for k in range(n)]).alias("surface"), whole.alias("ok")).where("ok")
    if contains:
        rows = rows.where(F.array_contains("w", contains))
    rows = rows.withColumn("words", F.array_join("w", " "))
    by_song = rows.groupBy("words", "song_id").agg(F.count("*").alias("n"))
    counts = by_song.groupBy("words").agg(F.sum("n").alias("freq"), F.count("*").alias("songs")).where((F.col("freq") >= max(1, min_freq)) & (F.col("songs") >= max(1, min_songs)))
    out = counts.join(F.broadcast(corpus)).select("words", "freq", per_10k(F.col("freq"), F.col("_total")).alias("per_10k"), "songs", (F.col("songs") / F.greatest("_songs", F.lit(1))).alias("range"))
    if limit is not None:
        out = out.orderBy(F.desc("freq"), F.desc("songs"), "words").limit(limit)
    surface = rows.join(out.select("words"), "words", "left_semi").groupBy("words", "surface").agg(F.count("*").alias("n"))
    best = surface.groupBy("words").agg(F.max_by("surface", F.struct("n", negated("surface"))).alias("surface"))
    return out.join(best, "words")


def negated(c: str) -> Column:
    """Orders strings downwards within a struct: code points from the top."""
    return F.transform(F.split(c, ""), lambda x: -F.coalesce(F.ascii(x), F.lit(0)))


def report_totals(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: songs, lines, tokens, types, ttr, hapax, hapax_ratio, avg_types_per_song, avg_tokens_per_line."""
    head = lines.agg(F.count_distinct("song_id").alias("song_count"), F.count("*").alias("utterance_count"))
    per_song = tokens.groupBy("song_id", "lemma").agg(F.count("*").alias("n"))
    types = per_song.groupBy("lemma").agg(F.sum("n").alias("n"))
    words = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("token_count"), F.count("*").alias("type_count"), F.count_if(F.col("n") == 1).alias("hapax_count"))
    each = per_song.groupBy("song_id").agg(F.count("*").alias("t")).agg(F.sum("t").alias("types_in_songs"), F.count("*").alias("n_songs"))
    out = head.join(F.broadcast(words)).join(F.broadcast(each))  # one row each
    d = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(
        "song_count", "utterance_count", "token_count", "type_count", d("type_count", "token_count").alias("ttr"), "hapax_count", d("hapax_count", "type_count").alias("hapax_ratio"),
        d("types_in_songs", "n_songs").alias("avg_types_per_song"), d("token_count", "utterance_count").alias("avg_tokens_per_line"),
    )


def pos_distribution(tokens: DataFrame) -> DataFrame:
    types = tokens.groupBy("pos", "lemma").agg(F.count("*").alias("n")).groupBy("pos").agg(F.sum("n").alias("token_count"), F.count("*").alias("type_count"))
    total = types.agg(F.sum("token_count").alias("_all"))  # a row for each part of speech
    return types.join(F.broadcast(total)).select("pos", "token_count", (F.col("token_count") / F.col("_all") * 100).alias("token_pct"), "type_count")


def coverage(tokens: DataFrame, targets: tuple[int, ...] = COVERAGE) -> DataFrame:
    """Share of all tokens that the n most frequent lemmas make up; with fewer lemmas than n, all of them."""
    freq = tokens.groupBy("lemma").agg(F.count("*").alias("n"))
    total = freq.agg(F.sum("n").alias("_all"))
    top = freq.orderBy(F.desc("n"), "lemma").limit(max(targets))  # at most the largest target
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "lemma")))
    sums = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= t, F.col("n"))), F.lit(0)).alias(str(t)) for t in targets])
    wide = sums.join(F.broadcast(total))
    each = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("n"), F.col(f"`{t}`").alias("sum")) for t in targets])).alias("c")
    return wide.select(each, "_all").select("c.n", F.coalesce(F.try_divide(F.col("c.sum") * 100.0, F.col("_all")), F.lit(0.0)).alias("pct"))


def sttr(tokens: DataFrame) -> DataFrame:
    """Mean type-token ratio of full chunks of the stream: 1000 tokens if there are 5000 or more, 500 from 1000 on, else null."""
    placed = S.positions(tokens)
    total = S.song_sizes(tokens).agg(F.sum("size").alias("_all"))
    size = F.when(F.col("_all") >= 5000, 1000).when(F.col("_all") >= 1000, 500)
    placed = placed.select("lemma", "at").join(F.broadcast(total)).withColumn("size", size).withColumn("chunk", F.floor(F.col("at") / F.col("size")))
    chunks = placed.where("size IS NOT NULL").groupBy("chunk", "size").agg(F.count("*").alias("n"), F.count_distinct("lemma").alias("types")).where("n = size")
    out = chunks.agg(F.sum("types").alias("t"), F.count("*").alias("c"), F.max("size").alias("size"))
    return out.select(F.col("size").cast("long").alias("sttr_chunk"), F.try_divide(F.col("t") / F.col("c"), F.col("size")).alias("sttr"))


def word_in_corpus(tokens: DataFrame, lemma: str) -> DataFrame:
    """Occurrences, songs and artists of a word for each part of speech."""
    return tokens.where(F.col("lemma") == lemma).groupBy("lemma", "pos").agg(F.count("*").alias("occurrences"), F.count_distinct("song_id").alias("songs"), F.count_distinct("artist").alias("artists"), F.min("song_id").alias("first_song"))


def word_frequency(tokens: DataFrame, limit: int | None = 500) -> DataFrame:
    """lemma, pos, freq, songs; marks, blanks and unknown parts of speech left out, also where there is none. Ties by lemma, pos."""
    rows = tokens.where(~F.col("pos").isin("PUNCT", "SYM", "SPACE", "X"))
    out = rows.groupBy("lemma", "pos", "song_id").agg(F.count("*").alias("n")).groupBy("lemma", "pos").agg(F.sum("n").alias("freq"), F.count("*").alias("songs"))
    return out.orderBy(F.desc("freq"), "lemma", "pos").limit(limit) if limit is not None else out


def merged_by_lemma(words: DataFrame) -> DataFrame:
    """Rows of ``word_frequency`` with parts of speech put together: freq, songs (the most of any), parts of speech by freq."""
    order = lambda a, b: F.when(a["freq"] != b["freq"], F.sign(b["freq"] - a["freq"]).cast("int")).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("freq", "pos")), order), lambda x: x["pos"]), " ")  # a row for each part of speech
    return words.groupBy("lemma").agg(F.sum("freq").alias("freq"), F.max("songs").alias("songs"), parts.alias("pos"))


def common_surface(tokens: DataFrame) -> DataFrame:
    """lemma, pos, surface and n: each word's most frequent spelling, the first of equal ones."""
    counts = tokens.groupBy("lemma", "pos", "surface").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy(F.desc("n"), "surface"))
    return counts.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def ngram_dispersion(tokens: DataFrame, n: int = 2, unit: str = TOKENS, min_freq: int = 2) -> DataFrame:
    """``dispersion`` of n-grams of at least ``min_freq``: places and songs' sizes are those of all tokens."""
    placed = S.positions(S.counted(tokens, unit))
    parts = placed.groupBy("song_id").agg(F.first("size").alias("size"))
    line = Window.partitionBy("song_id", "line_idx").orderBy("idx")
    whole, words = F.lit(True), [F.col("lemma")]
    for k in range(1, n):
        whole &= F.lead("lemma", k).over(line).isNotNull() & ~F.lead("gap_before", k).over(line)
        words.append(F.lead("lemma", k).over(line))
    rows = placed.select("song_id", "bucket", "size", "at", F.array_join(F.array(*words), " ").alias("words"), whole.alias("ok")).where("ok")
    often = rows.groupBy("words").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq).select("words")
    return dispersion_at(rows.join(often, "words", "left_semi"), ["words"], parts)


def pick_words(tokens: DataFrame, pos: tuple[str, ...], least: int, known: DataFrame | None = None) -> DataFrame:
    """Words worth a card: lemma, freq, songs of the given parts of speech from ``least`` on, without those in ``known``."""
    out = tokens.where(F.col("pos").isin(*pos)).groupBy("lemma", "song_id").agg(F.count("*").alias("n")).groupBy("lemma").agg(F.sum("n").alias("freq"), F.count("*").alias("songs")).where(F.col("freq") >= least)
    return out.join(known.select("lemma"), "lemma", "left_anti") if known is not None else out


__all__ = ["DISTINCT_LINES", "TOKENS"]
