"""Stretches of characters and of time within lines: two tokenisations of one text, timelines, words that are sung, units that tile a line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

#: Milliseconds by which a line may begin after the song's end.
OVER_DURATION = 2_000
#: Rows of a batch of tokens.
ROWS = 65_536
# Signs that no one sings, besides blanks and ASCII punctuation.
SILENT = "、。！？「」『』（）［］【】〈〉《》〔〕…‥—―〜～・：；，．“”‘’"
SEPARATORS = rf"(?U)^[\s!-/:-@\[-`{{-~{SILENT}]*$"


# ---- tokens against tokens ----


def spans_of(text: str, surfaces: list[str]) -> list[dict | None]:
    """Where each surface stands in the text, each looked for after the one before; None where it isn't found, or is empty."""
    out, at = [], 0
    for s in surfaces:
        found = text.find(s, at) if s else -1
        out.append(None if found < 0 else {"start": found, "stop": found + len(s)})
        at = at if found < 0 else found + len(s)
    return out


def aligned_offsets(text: Column, surfaces: Column) -> Column:
    """Where each token begins, if all are found one after the other with nothing but blanks between; else null. Empty tokens stand where the next may begin."""
    return _offsets(text, surfaces)


@F.pandas_udf(ArrayType(LongType()))
def _offsets(text: pd.Series, surfaces: pd.Series) -> pd.Series:
    def each(t, tokens):
        at, out = 0, []
        for s in tokens:
            while s and at < len(t) and not t.startswith(s, at) and t[at].isspace():
                at += 1
            if not t.startswith(s, at):
                return None
            out.append(at)
            at += len(s)
        return out

    return pd.Series([None if t is None or s is None else each(t, list(s)) for t, s in zip(text, surfaces, strict=True)])


def _texts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and where each begins (one more for the end)."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _spans_of_all(texts: pa.Array, surfaces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spans_of`` of all lines of a batch: start and stop (-1 where there is none) of each surface, and how many surfaces lines before have (one more for the end).

    Surfaces without blanks that make up a text but for its blanks stand where sums of lengths say; other lines are looked through one by one.
    """
    data, at = _texts(texts)
    flat = surfaces.flatten()
    firsts = _sums(pc.list_value_length(surfaces).to_numpy(zero_copy_only=False).astype(np.int64))
    theirs, places = _texts(flat)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    solid = _sums(~blank)
    here, there = solid[at], places[firsts]  # bytes that are no blanks, up to each line
    fits = np.diff(here) == np.diff(there)
    # bytes of lines that fit in length are compared, all at once
    line = np.repeat(np.arange(len(texts)), np.diff(there))
    equal = np.zeros(len(theirs), bool)
    some = fits[line]
    equal[some] = theirs[some] == data[~blank][(np.arange(len(theirs)) - there[line] + here[line])[some]]
    fits[line[some & ~equal]] = False
    begins = (data & 0xC0) != 0x80
    letters = _sums(begins)
    spot = (letters[:-1] - np.repeat(letters[at[:-1]], np.diff(at)))[begins & ~blank]  # the place in its line of each letter that is no blank
    n = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    fits[owner[n == 0]] = False
    solid_letters = _sums(begins & ~blank)[at]
    sums = _sums(n)
    first = (sums[:-1] - sums[firsts[owner]]) + solid_letters[owner]
    start, stop = np.full(len(n), -1), np.full(len(n), -1)
    whole = fits[owner]
    start[whole], stop[whole] = spot[first[whole]], spot[first[whole] + n[whole] - 1] + 1
    fits[owner[whole & (stop - start != n)]] = False  # a blank lies within a surface
    for k in np.flatnonzero(~fits):
        found = spans_of(texts[k].as_py(), surfaces[k].as_py())
        start[firsts[k] : firsts[k + 1]] = [-1 if s is None else s["start"] for s in found]
        stop[firsts[k] : firsts[k + 1]] = [-1 if s is None else s["stop"] for s in found]
    return start, stop, firsts


def _aligned(key: list[str], carried: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts, ours, theirs = batch.columns[: len(key) + 3]
            start, stop, firsts = _spans_of_all(texts, ours)
            begin, end, others = _spans_of_all(texts, theirs)
            lines = lambda firsts: np.repeat(np.arange(len(batch)), np.diff(firsts))
            mine, base = lines(firsts), _sums(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            # spans ascend within a line and from line to line, so places among all that are there are found by bisection
            there = np.flatnonzero(begin >= 0)
            shift = base[lines(others)[there]]
            left, right = np.searchsorted(end[there] + shift, start + base[mine], "right"), np.searchsorted(begin[there] + shift, stop + base[mine], "left") - 1
            missing = start < 0
            none = missing | (left > right)
            first, last = (there[np.where(none, 0, x)] if len(there) else np.zeros(len(start), np.int64) for x in (left, right))
            differs = none | (first != last)
            if len(there):
                differs |= (begin[first] != start) | (end[first] != stop)
            number = lambda values, gone: pa.array(values - others[mine], pa.int64(), mask=gone)
            columns = [
                *[k.take(pa.array(mine)) for k in keys], pa.array(np.arange(len(mine)) - firsts[mine], pa.int64()), ours.flatten(), pa.array(start, pa.int64(), mask=missing), pa.array(stop, pa.int64(), mask=missing),
                number(first, none), number(last, none), number(first, differs),
            ]
            names = [*key, "idx", "surface", "start", "stop", "first", "last", "same"]
            if carried:
                columns.append(batch.column(len(key) + 3).flatten().take(pa.array(first, mask=differs)))
                names.append("carried")
            out = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, len(out), ROWS):
                yield out.slice(at, ROWS)

    return aligned


def align_tokens(lines: DataFrame, key: list[str], ours: str, theirs: str, carried: str | None = None) -> DataFrame:
    """``key``, idx, surface, start, stop, first, last, same: each of our tokens of a line with the range of theirs that it overlaps and the equal one.

    ``lines`` has text and the two tokenisations as arrays of surfaces. Tokens that the text doesn't hold have nulls; lines without text or tokens have no rows.
    ``carried`` is an array of what goes with each of their tokens: the equal one's is one more column, of that name.
    """
    rows = lines.where(F.col("text").isNotNull() & F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    rows = rows.select(*key, "text", F.col(ours).alias("_ours"), F.col(theirs).alias("_theirs"), *([F.col(carried).alias("_carried")] if carried else []))
    schema = StructType([rows.schema[k] for k in key]).add("idx", LongType()).add("surface", rows.schema["_ours"].dataType.elementType)
    for c in ("start", "stop", "first", "last", "same"):
        schema = schema.add(c, LongType())
    if carried:
        schema = schema.add("carried", rows.schema["_carried"].dataType.elementType)
    out = rows.mapInArrow(_aligned(key, carried is not None), schema)
    return out.withColumnRenamed("carried", carried) if carried else out


def annotate(lines: DataFrame, key: list[str], surfaces: str, analysed: str, alone: DataFrame) -> DataFrame:
    """``key``, idx, surface, morph and how: what an analysis says of each token of older lines.

    ``analysed`` is an array of struct of surface and morph, of the same text. A token takes the morph of the analysed token of just its characters ("context"), else what
    ``alone`` (surface, morph) says of its surface by itself ("alone"), else none ("unknown").
    """
    rows = lines.withColumn("_theirs", F.filter(F.col(analysed), lambda t: F.trim(t["surface"]) != ""))
    met = align_tokens(rows.withColumns({"_surfaces": F.col("_theirs")["surface"], "_morph": F.col("_theirs")["morph"]}), key, surfaces, "_surfaces", "_morph")
    # words are few beside tokens, so these need not be sorted
    known = alone.groupBy(F.col("surface").alias("_alone")).agg(F.min("morph").alias("_by_itself")).hint("shuffle_hash")
    met = met.join(known, F.col("surface") == F.col("_alone"), "left")
    how = F.when(F.col("same").isNotNull(), "context").when(F.col("_alone").isNotNull(), "alone").otherwise("unknown")
    return met.select(*key, "idx", "surface", F.when(F.col("same").isNotNull(), F.col("_morph")).otherwise(F.col("_by_itself")).alias("morph"), how.alias("how"))


# ---- timelines ----


def to_ms(seconds: Column) -> Column:
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < 1e12), F.round(seconds * 1000).cast("long"))


def _words(text: Column, words: Column, line_end: Column) -> Column:
    """The words with ends if all of them are in order and within the text, else none."""
    w = F.transform(words, lambda x: F.struct(x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), F.when(x["start_sec"] >= 0, to_ms(x["start_sec"])).alias("start_ms"), to_ms(x["end_sec"]).alias("end_ms")))
    before = lambda k: F.get(w, k - 1)
    good = F.transform(w, lambda x, k: F.coalesce(x["start_ms"].isNotNull() & (x["char_start"] < x["char_end"]) & (x["char_end"] <= F.length(text)) & ((k == 0) | ((x["char_start"] >= before(k)["char_end"]) & (x["start_ms"] >= before(k)["start_ms"]))), F.lit(False)))
    after = lambda k: F.get(w, k + 1)["start_ms"]
    end = lambda x, k: F.when(x["end_ms"] > x["start_ms"], x["end_ms"]).when(k + 1 < F.size(w), after(k)).when(line_end > x["start_ms"], line_end)
    ended = F.transform(w, lambda x, k: F.struct(x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), x["start_ms"].alias("start_ms"), end(x, k).alias("end_ms")))
    return F.when(F.forall(good, lambda g: g), ended).otherwise(F.slice(ended, 1, 0))


def build_timelines(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """song_id, place, id, line_idx, start_ms, end_ms, text, words and what was mended: a song's lines as a timeline.

    ``lines``: song_id, line_idx, text, start_sec, end_sec, words (array of struct of char_start, char_end, start_sec, end_sec; null: none); ``durations``: song_id, duration_sec.
    Blank lines go. Times that are negative or not finite, and those over two seconds after the song's end, are none. Lines go by time, those without last, else as they came. A line ends where it says,
    if that is after its start, else at the song's next later start, else at the song's end if that is later. Words count only on timed lines and only if
    all are in order. ``mended``: "invalid", "over", "end" or null. The id names a line by its time, its text and how many like it came before.
    """
    rows = lines.where(F.trim("text") != "").join(durations.groupBy("song_id").agg(F.max("duration_sec").alias("_d")), "song_id", "left")
    length = F.when(F.col("_d") > 0, to_ms(F.col("_d").cast("double")))
    start = F.when(F.col("start_sec") >= 0, to_ms(F.col("start_sec")))
    over = F.coalesce(start > length + OVER_DURATION, F.lit(False))
    rows = rows.withColumns({"_length": length, "start_ms": F.when(~over, start), "_end": to_ms(F.col("end_sec")), "mended": F.when(F.col("start_sec").isNotNull() & start.isNull(), "invalid").when(over, "over")})
    # the next later start: distinct starts know the one after them
    starts = rows.where("start_ms IS NOT NULL").select("song_id", "start_ms").distinct()
    starts = starts.withColumn("_next", F.lead("start_ms").over(Window.partitionBy("song_id").orderBy("start_ms")))
    rows = rows.join(starts, ["song_id", "start_ms"], "left")
    said = F.col("_end") > F.col("start_ms")
    fallback = F.coalesce("_next", F.when(F.col("_length") > F.col("start_ms"), F.col("_length")))
    end = F.when(F.col("start_ms").isNotNull(), F.when(said, F.col("_end")).otherwise(fallback))
    rows = rows.withColumns({"end_ms": end, "mended": F.coalesce("mended", F.when(F.col("start_ms").isNotNull() & F.col("_end").isNotNull() & ~said, "end"))})
    words = F.when(F.col("start_ms").isNotNull(), _words(F.col("text"), F.coalesce("words", F.slice(F.col("words"), 1, 0)), F.col("end_ms")))
    order = [F.col("start_ms").asc_nulls_last(), "line_idx"]
    nth = F.row_number().over(Window.partitionBy("song_id", "start_ms", "text").orderBy("line_idx")) - 1
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(*order)) - 1  # the lines of one song
    name = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("start_ms").cast("string"), F.lit("")), "text", nth.cast("string")))
    return rows.select("song_id", place.cast("long").alias("place"), name.alias("id"), "line_idx", "start_ms", "end_ms", "text", words.alias("words"), "mended")


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """song_id, lines, precision ("word", "line" or "none") and how many lines were mended in which way."""
    mended = {f"n_{m}": F.count_if(F.col("mended") == m) for m in ("invalid", "over", "end")}
    precision = F.when(F.max(F.coalesce(F.size("words"), F.lit(0))) > 0, "word").when(F.count("start_ms") > 0, "line").otherwise("none")
    return timeline.groupBy("song_id").agg(F.count("*").alias("lines"), precision.alias("precision"), *[c.alias(n) for n, c in mended.items()])


def normalized_segments(text: Column, segments: Column) -> Column:
    """Sung segments (start, stop, time_sec, end_sec) of a line so that signs no one sings belong to the segment before them, or to the first one, and no segment sounds on after the next has begun.

    Segments that are empty or reach beyond the text go; others keep their time. What lies between two segments is absorbed only if it is all signs and blanks.
    """
    fit = F.array_sort(F.filter(segments, lambda s: (s["start"] >= 0) & (s["start"] < s["stop"]) & (s["stop"] <= F.length(text))), lambda a, b: (F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    silent = lambda a, b: (a <= b) & F.substring(text, a.cast("int") + 1, (b - a).cast("int")).rlike(SEPARATORS)
    n = F.size(fit)
    zero = F.lit(0).cast("long")
    after = lambda k: F.get(fit, k + 1)
    start = lambda s, k: F.when((k == 0) & silent(zero, s["start"]), zero).otherwise(s["start"])
    stop = lambda s, k: F.when((k == n - 1) & silent(s["stop"], F.length(text).cast("long")), F.length(text).cast("long")).when((k < n - 1) & (s["stop"] < after(k)["start"]) & silent(s["stop"], after(k)["start"]), after(k)["start"]).otherwise(s["stop"])
    end = lambda s, k: F.when((s["end_sec"] > after(k)["time_sec"]) & (after(k)["time_sec"] > s["time_sec"]), after(k)["time_sec"]).otherwise(s["end_sec"])
    return F.transform(fit, lambda s, k: F.struct(start(s, k).alias("start"), stop(s, k).alias("stop"), s["time_sec"].alias("time_sec"), end(s, k).alias("end_sec")))


def display_units(lines: DataFrame, timings: DataFrame, key: list[str]) -> DataFrame:
    """``key``, mode and units: how each line can be shown.

    "karaoke" where timed units tile the line: sorted, each begins where the one before stops, the last one stops with the text, and their times ascend within the line's; units are then given. Else
    "line" if the line's own time is valid, else "plain". ``lines``: ``key``, text, time_sec, end_sec; ``timings``: ``key``, char_start, char_end, start_sec, end_sec, source. Only "lrc" and finished "manual" timings
    count; of both on the same characters manual ones hold; different times from one source on the same characters rule karaoke out.
    """
    t = timings.where("source = 'lrc' OR (source = 'manual' AND end_sec IS NOT NULL)")
    at = F.struct(F.when(F.col("source") == "manual", 0).otherwise(1).alias("rank"), "start_sec", "end_sec", "source")
    t = t.groupBy(*key, "char_start", "char_end").agg(F.min(at).alias("t"), F.count_distinct(F.when(F.col("source") == "manual", F.struct("start_sec", "end_sec"))).alias("m"), F.count_distinct(F.when(F.col("source") == "lrc", F.struct("start_sec", F.coalesce("end_sec", F.lit(-1.0))))).alias("l"))
    unit = F.struct("char_start", "char_end", F.col("t.start_sec").alias("start_sec"), F.col("t.end_sec").alias("end_sec"), F.col("t.source").alias("source"))
    t = t.groupBy(*key).agg(F.array_sort(F.collect_list(unit)).alias("u"), F.max((F.col("m") > 1) | ((F.col("m") == 0) & (F.col("l") > 1))).alias("torn"))  # the units of one line
    rows = lines.join(t, key, "left")
    valid = lambda c: (c >= 0) & ~F.isnan(c) & (c < float("inf"))
    u, time, end = F.col("u"), F.col("time_sec"), F.col("end_sec")
    before = lambda k: F.get(u, k - 1)
    good = F.forall(
        F.transform(u, lambda x, k: (x["char_start"] == F.when(k == 0, 0).otherwise(before(k)["char_end"])) & (x["char_start"] < x["char_end"]) & (x["char_end"] <= F.length("text")) & valid(x["start_sec"]) & valid(x["end_sec"]) & (x["end_sec"] > x["start_sec"])
            & (x["start_sec"] >= F.when(k == 0, F.coalesce(time, F.lit(0.0))).otherwise(before(k)["end_sec"])) & F.coalesce(x["end_sec"] <= end, F.lit(True))),
        lambda g: F.coalesce(g, F.lit(False)),
    )
    fit = (F.length("text") > 0) & F.coalesce(valid(time), F.lit(True)) & F.coalesce(valid(end), F.lit(True)) & F.coalesce(end > time, F.lit(True)) & ~F.coalesce("torn", F.lit(False))
    whole = F.coalesce(fit & (F.size(u) > 0) & good & (F.element_at(u, -1)["char_end"] == F.length("text")), F.lit(False))
    mode = F.when(whole, "karaoke").when(F.coalesce(valid(time), F.lit(False)), "line").otherwise("plain")
    return rows.select(*key, mode.alias("mode"), F.when(whole, u).alias("units"))
