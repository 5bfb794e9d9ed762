"""Time-aligned lines: spans, windows, loop regions, and validation of timing and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ranges by which a language is guessed.
KANA, HAN, LATIN, HANGUL = r"[ぁ-ゖァ-ヺーｦ-ﾟ]", r"[一-鿿㐀-䶿々]", r"[a-zA-Zａ-ｚＡ-Ｚ]", r"[가-힯ᄀ-ᇿ㄰-㆏]"
# Seconds after which a gap is long, by which a stamp may pass the end, and characters of a very long line.
LONG_GAP, SLACK, LONG_LINE = 30.0, 2.0, 80
# Labels of credit lines.
LABELS = ("作詞", "作词", "作曲", "編曲", "编曲", "歌词")


def estimated_duration(text: Column) -> Column:
    """Seconds a line takes by its length: 3 and a quarter for each character, between 5 and 12."""
    return F.greatest(F.lit(5.0), F.least(F.lit(12.0), 3 + 0.25 * F.length(text)))


#: Lines of a song whose latest time is known together, where the next line does not start later.
TOGETHER = 64


def next_later(timed: DataFrame) -> DataFrame:
    """song_id, line_idx, time_sec, text and _end: the start of the first later line, in line order, with a greater time.

    The next line settles nearly all. The others look on in their own stretch of lines, then for the first stretch whose latest time is
    later, and only into that one, so no row carries the rest of its song.
    """
    song = Window.partitionBy("song_id").orderBy("line_idx")
    rows = timed.withColumns({"_next": F.lead("time_sec").over(song), "_n": F.row_number().over(song)}).withColumn("_part", F.floor(F.col("_n") / TOGETHER))
    open_ = rows.where(F.col("_next") <= F.col("time_sec")).select("song_id", F.col("_n").alias("of"), F.col("time_sec").alias("t"), F.col("_part").alias("p"))
    near = rows.select("song_id", F.col("_n").alias("n"), F.col("time_sec").alias("t2"), F.col("_part").alias("p"))
    first = F.min_by("t2", "n").alias("_later")
    own = open_.join(near, ["song_id", "p"]).where("n > of AND t2 > t").groupBy("song_id", "of").agg(first)
    latest = rows.groupBy("song_id", F.col("_part").alias("p2")).agg(F.max("time_sec").alias("most"))
    far = open_.join(own, ["song_id", "of"], "left_anti").join(latest, "song_id").where("p2 > p AND most > t").groupBy("song_id", "of", "t").agg(F.min("p2").alias("p"))
    far = far.join(near, ["song_id", "p"]).where("t2 > t").groupBy("song_id", "of").agg(first)
    found = own.unionByName(far).withColumnRenamed("of", "_n")
    end = F.when(F.col("_next") > F.col("time_sec"), F.col("_next")).otherwise(F.col("_later"))
    return rows.join(found, ["song_id", "_n"], "left").select("song_id", "line_idx", "time_sec", "text", end.alias("_end"))


def line_spans(lines: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """start_sec, end_sec and kind of each timed line. The end is the start of the first later line, in line order, with a greater time
    if that is within the estimate, else the estimate, cut at the song's end."""
    rows = next_later(lines.where("time_sec IS NOT NULL").select("song_id", "line_idx", "time_sec", "text"))
    guess = F.col("time_sec") + estimated_duration(F.col("text"))
    near = F.col("_end").isNotNull() & (F.col("_end") <= guess)
    end = F.when(near, F.col("_end")).otherwise(guess)
    kind = F.when(near, "next_line").otherwise("estimated")
    if durations is not None:
        rows = rows.join(durations.select("song_id", "duration_sec"), "song_id", "left")
        kind = F.when(F.col("duration_sec") < end, "track_end").otherwise(kind)
        end = F.least(end, F.col("duration_sec"))
    return rows.select("song_id", "line_idx", F.col("time_sec").alias("start_sec"), end.alias("end_sec"), kind.alias("kind"))


def listen_window(spans: DataFrame, around: int = 1, preroll: float = 0.4) -> DataFrame:
    """For each line the stretch from ``around`` lines before it to ``around`` after it, begun ``preroll`` earlier."""
    near = Window.partitionBy("song_id").orderBy("line_idx").rowsBetween(-around, around)
    return spans.select("song_id", "line_idx", F.greatest(F.lit(0.0), F.min("start_sec").over(near) - preroll).alias("from_sec"), F.max("end_sec").over(near).alias("to_sec"), F.count("*").over(near).alias("lines"))


def loop_regions(spans: DataFrame, adjust: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Loop of each line: its span, ended with the last word where words are timed, moved by stored deltas of at most 10 s, 0.3 s at least."""
    rows = spans.join(adjust, ["song_id", "line_idx"], "left")
    end = F.col("end_sec")
    if words is not None:
        rows = rows.join(words.groupBy("song_id", "line_idx").agg(F.max("word_end").alias("word_end")), ["song_id", "line_idx"], "left")
        end = F.coalesce("word_end", "end_sec")
    delta = lambda c: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.coalesce(F.col(c), F.lit(0.0))))
    start = F.greatest(F.lit(0.0), F.col("start_sec") + delta("start_delta"))
    return rows.select("song_id", "line_idx", start.alias("start_sec"), F.greatest(end + delta("end_delta"), start + 0.3).alias("end_sec"))


def guess_language(kana: Column, han: Column, latin: Column, hangul: Column) -> Column:
    """ko, ja, en, zh, mixed or unknown by counts of letters; a twentieth of kana makes Japanese."""
    total = kana + han + latin + hangul
    share = lambda n: F.round(n / total, 3)
    return F.when(total == 0, "unknown").when(share(hangul) >= 0.5, "ko").when(share(kana) >= 0.05, "ja").when(share(latin) >= 0.8, "en").when((kana == 0) & (share(han) >= 0.5), "zh").otherwise("mixed")


def line_issues(lines: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """song_id, line_idx, issues (codes joined by commas) and confidence (null without time) of each line.

    A time is compared with the last line that did not run backwards, not with the line before, so one early stamp
    does not make all that follow look late.
    """
    song = Window.partitionBy("song_id").orderBy("line_idx")
    earlier = song.rowsBetween(Window.unboundedPreceding, -1)
    t, text = F.col("time_sec"), F.trim("text")
    rows = lines.select("song_id", "line_idx", "time_sec", "text").withColumn("_max", F.max("time_sec").over(earlier))
    base = F.when(t.isNotNull() & (F.col("_max").isNull() | (t >= F.col("_max"))), F.struct(t.alias("t"), text.alias("x")))
    rows = rows.withColumn("_base", base).withColumn("_prev", F.last("_base", True).over(earlier))
    limit = F.lit(None).cast("double")
    if durations is not None:
        rows = rows.join(durations.select("song_id", F.when(F.col("duration_sec") > 0, F.col("duration_sec")).alias("_d")), "song_id", "left")
        limit = F.col("_d")
    p = F.col("_prev.t")
    same = (F.abs(t - p) <= 0.01) & ~(t + 0.01 < p)
    gap = (t - p > LONG_GAP) & ~same
    # issue, whether it holds, and what a line's confidence falls to
    rules = [
        ("leftover_markup", text.rlike(r"\[[0-9.]*:[0-9:.]*\]|<[0-9.]*:[0-9:.]*>|^(?:" + "|".join(LABELS) + r")\s*[:：]"), 1.0),
        ("very_long_line", F.length(text) > LONG_LINE, 1.0),
        ("beyond_duration", t > limit + SLACK, 0.1),
        ("non_monotonic", t + 0.01 < p, 0.2),
        ("stacked_duplicate", same & (F.col("_prev.x") == text), 0.5),
        ("duplicate_timestamp", same & (F.col("_prev.x") != text), 0.5),
        ("long_gap", gap, 0.7),
    ]
    whole = Window.partitionBy("song_id")
    mixed = F.when(F.count("time_sec").over(whole) < F.count("*").over(whole), 0.8).otherwise(1.0)
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _ in rules]))
    least = F.least(mixed, *[F.when(c, F.lit(v)).otherwise(1.0) for _, c, v in rules])
    return rows.select("song_id", "line_idx", F.array_join(codes, ",").alias("issues"), F.when(t.isNotNull(), F.round(least, 3)).alias("confidence"))


def song_quality(lines: DataFrame, issues: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Each song's lines, timed lines, language, share of repeated lines and completeness: 1 less the penalties of what is wrong."""
    count = lambda code: F.count_if(F.array_contains(F.split("issues", ","), code))
    rows = lines.join(issues, ["song_id", "line_idx"])
    n = Window.partitionBy("song_id", F.trim("text"))
    rows = rows.withColumn("_n", F.count("*").over(n))
    letters = {k: F.sum(F.regexp_count("text", F.lit(c))).alias(f"_{k}") for k, c in (("kana", KANA), ("han", HAN), ("latin", LATIN), ("hangul", HANGUL))}
    per = rows.groupBy("song_id").agg(
        F.count("*").alias("lines"), F.count("time_sec").alias("timed_lines"), F.count_if(F.col("_n") > 1).alias("_rep"), F.max("time_sec").alias("_last"), F.max(F.col("text").contains("\ufffd")).alias("_bad"),
        count("stacked_duplicate").alias("_s"), count("long_gap").alias("_g"), count("non_monotonic").alias("_b"), *letters.values(),
    )
    if durations is not None:
        per = per.join(durations.select("song_id", "duration_sec"), "song_id", "left")
    else:
        per = per.withColumn("duration_sec", F.lit(None).cast("double"))
    language, d = guess_language(*[F.col(f"_{k}") for k in letters]), F.col("duration_sec")
    few = lambda c: F.least(F.lit(0.2), 0.05 * F.col(c))
    when = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    penalty = when(F.col("_bad"), 0.5) + when(~language.isin("ja", "unknown"), 0.2) + when((d >= 120) & (F.col("lines") < 8), 0.4) + when((d >= 60) & (F.col("_last") < d * 0.5), 0.3) + few("_s") + few("_g") + few("_b")
    return per.select("song_id", "lines", "timed_lines", language.alias("language"), F.round(F.col("_rep") / F.col("lines"), 3).alias("repeated_ratio"), F.round(F.greatest(F.lit(0.0), 1 - penalty), 3).alias("completeness"))


def align_translations(lines: DataFrame, translations: DataFrame, tolerance: float = 0.05, enough: float = 0.8) -> DataFrame:
    """song_id, line_idx, translation: nearest start within ``tolerance``, one to one, taken in line order; a song of which less than
    ``enough`` finds a line gets none. A song's lines are one call, as each choice depends on those before."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("line_idx"), right.sort_values(["time_sec", "translation"])
        free, out = list(zip(right["time_sec"], right["translation"], strict=True)), []
        for n, t in zip(left["line_idx"], left["time_sec"], strict=True):
            best = min(((abs(u - t), k) for k, (u, _) in enumerate(free) if abs(u - t) <= tolerance + 1e-9), default=None)
            if best:
                out.append((key[0], n, free.pop(best[1])[1]))
        out = out if len(out) >= enough * len(right) else []
        return pd.DataFrame(out, columns=["song_id", "line_idx", "translation"])

    right = translations.select(F.col("song_id").alias("song_id2"), F.col("time_sec"), "translation")
    return lines.select("song_id", "line_idx", "time_sec").groupBy("song_id").cogroup(right.groupBy("song_id2")).applyInPandas(run, "song_id long, line_idx long, translation string")
