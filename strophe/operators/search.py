"""Concordance, token patterns, full text and quick search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import text as X
from strophe.plans import stream as S
from strophe.plans.rounds import settled

FIELDS = ("surface", "lemma", "pos")
#: A count of passages' sequences up to which they are broadcast (some 30 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def matches_at(i: Column, words: tuple[str, ...], attribute: str) -> Column:
    """Tokens from place ``i`` (from 0) on are ``words``."""
    out = F.lit(True)
    for k, w in enumerate(words):
        out &= F.coalesce(F.get("tokens", i + k)[attribute] == w, F.lit(False))
    return out


def after_characters(text: Column, n: Column) -> Column:
    """start and end: where a text's ``n``-th character that is no blank ends, with the blanks that follow it and without them.

    One pass over the text's words, each with the blanks behind it, so that a line of any length needs no recursion.
    """

    def step(a: Column, word: Column) -> Column:
        full = F.length(F.regexp_replace(word, r"\s", ""))
        take = F.least(full, a["left"])
        start = F.when(take < full, a["start"] + take).otherwise(a["start"] + F.length(word))
        moved = F.struct((a["left"] - take).alias("left"), start.alias("start"), F.when(full > 0, a["start"] + take).otherwise(a["end"]).alias("end"))
        return F.when((a["left"] <= 0) & (full > 0), a).otherwise(moved)

    zero = F.lit(0)
    # the count is part of the state, so that it is not computed again for each word
    return F.aggregate(F.split(text, r"(?<=\s)(?=\S)"), F.struct(n.alias("left"), zero.alias("start"), zero.alias("end")), step)


def kwic(lines: DataFrame, keywords: tuple[str, ...], attribute: str = "lemma", pos: str | None = None, near: tuple[str, int] | None = None, dedup: bool = False, cross_line: bool = False, jp_only: bool = False, context: int = 5, limit: int | None = None) -> DataFrame:
    """Keyword in context: song_id, artist, line_idx, token_idx, left, keyword, right, left_words, right_words, repeat_count.

    A keyword is a word or words joined by ``+``; of several that match at a place the longest holds. ``pos`` only counts if every
    keyword is one word. ``near`` asks for a word within so many content tokens on either side. ``dedup`` folds equal lines of a
    song to the first hit and counts hits. ``cross_line`` adds the lines with the line numbers before and after, after `` / ``.
    """
    patterns = sorted({tuple(w for w in k.split("+") if w) for k in keywords} - {()}, key=lambda p: (-len(p), p))
    # a line is only taken apart if its letters can hold all words of a keyword
    some = F.lit(False)
    for p in patterns:
        every = F.lit(True)
        for w in p:
            every &= may_hold(F.col("text"), attribute, w)
        some |= every
    rows = S.tokenized(lines.where(some))
    firsts = [p[0] for p in patterns] or [""]
    rows = rows.where(F.exists("tokens", lambda t: t[attribute].isin(*firsts)))
    if cross_line:
        side = lines.select("song_id", F.col("line_idx").alias("_l"), F.col("text").alias("_t"))
        rows = rows.join(side.select("song_id", (F.col("_l") + 1).alias("line_idx"), F.col("_t").alias("before")), ["song_id", "line_idx"], "left")
        rows = rows.join(side.select("song_id", (F.col("_l") - 1).alias("line_idx"), F.col("_t").alias("after")), ["song_id", "line_idx"], "left")
    if not patterns:
        return rows.limit(0)
    length = lambda i: F.coalesce(*[F.when(matches_at(i, p, attribute), F.lit(len(p))) for p in patterns])
    found = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), length(i).alias("n"))), lambda x: x["n"].isNotNull())
    rows = rows.withColumn("_hit", F.explode(found)).withColumn("i", F.col("_hit.i")).withColumn("n", F.col("_hit.n"))
    if pos and all(len(p) == 1 for p in patterns):
        rows = rows.where(F.get("tokens", F.col("i"))["pos"] == pos)
    content = lambda t: ~t["pos"].isin(*S.DROPPED)
    left = F.reverse(F.filter(F.slice("tokens", F.lit(1), F.col("i")), content))
    right = F.filter(F.slice("tokens", F.col("i") + F.col("n") + 1, F.size("tokens")), content)
    if near:
        word, window = near
        ahead = lambda side: F.exists(F.slice(side, 1, window), lambda t: t[attribute] == word)
        rows = rows.where(ahead(left) | ahead(right))
    words = lambda side: F.array_join(F.transform(F.slice(side, 1, context), lambda t: t["surface"]), " ")
    # places of tokens in the raw text: a token begins where the text before it without blanks is as long as the tokens before it
    span = lambda a, b: F.array_join(F.transform(F.slice("tokens", a, b), lambda t: t["surface"]), "")
    chars = F.length(span(F.lit(1), F.col("i")))
    inner = F.length(span(F.col("i") + 1, F.col("n")))
    rows = rows.withColumn("_a", after_characters(F.col("text"), chars)["start"]).withColumn("_b", after_characters(F.col("text"), chars + inner)["end"])
    before, after = F.substring(F.col("text"), F.lit(1), F.col("_a")), F.substring(F.col("text"), F.col("_b") + 1, F.length("text"))
    if cross_line:
        before, after = F.concat_ws(" / ", "before", before), F.concat_ws(" / ", after, "after")
    out = rows.select(
        "song_id", "artist", "line_idx", F.get("tokens", F.col("i"))["token_idx"].alias("token_idx"), before.alias("left"), F.substring(F.col("text"), F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("keyword"), after.alias("right"),
        words(left).alias("left_words"), words(right).alias("right_words"), "text",
    )
    if dedup:
        same = Window.partitionBy("song_id", "text")
        nth = F.row_number().over(same.orderBy("line_idx", "token_idx"))
        out = out.withColumn("repeat_count", F.count("*").over(same)).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    else:
        out = out.withColumn("repeat_count", F.lit(1).cast("long"))
    if jp_only:
        out = out.where(X.is_japanese(F.col("keyword")))
    out = out.drop("text")
    return out.orderBy("artist", "song_id", "line_idx", "token_idx").limit(limit) if limit and limit > 0 else out


def sorted_hits(hits: DataFrame, sides: list[str], limit: int) -> DataFrame:
    """The first ``limit`` hits by the words on the given sides (nearest word first), numbered; ties by song, line and place."""
    keys = [F.lower(f"{side}_words") for side in sides]
    order = [*keys, "song_id", "line_idx", "token_idx"]
    top = hits.orderBy(*order).limit(limit)  # a bounded top-k
    return top.withColumn("nth", F.row_number().over(Window.orderBy(*order)).cast("long"))


# ---- token patterns ----

#: Letters that tokens are written as, one for each combination of conditions.
FIRST_LETTER, MOST_CONDITIONS = 0x4E00, 10


@dataclass(frozen=True)
class Item:
    """A condition on a token (a struct of surface, lemma, pos), and how often it holds in a row (``most`` None: without end). ``word``: attribute and value that
    a token which meets it has."""

    holds: Callable[[Column], Column]
    least: int = 1
    most: int | None = 1
    word: tuple[str, str] | None = None


def word(value: str, attribute: str = "lemma", least: int = 1, most: int | None = 1) -> Item:
    return Item(lambda t: t[attribute] == value, least, most, (attribute, value))


def like(pattern: str, attribute: str = "lemma") -> Callable[[Column], Column]:
    """Tokens whose whole value a regular expression matches."""
    return lambda t: t[attribute].rlike(f"^(?:{pattern})$")


#: Any token, up to once.
ANY = Item(lambda t: F.lit(True), 0, 1)


def may_hold(text: Column, attribute: str, value: str) -> Column:
    """Texts that can have a token of that lemma or surface, by their letters alone; all for other attributes."""
    return F.lower(text).contains(value) if attribute == "lemma" else text.contains(value) if attribute == "surface" else F.lit(True)


def pattern_search(lines: DataFrame, items: list[Item], dedup: bool = False, limit: int | None = None, overlap: bool = False) -> DataFrame:
    """Runs of tokens that meet ``items`` one after the other: song_id, artist, line_idx, start, length, matched; the longest at each place, from
    left to right without overlap. With ``overlap`` every place where a run begins counts, also within another one.

    Each token is written as the letter of the conditions that it meets, and the items are a regular expression over these. Words that have to be there are looked for in the raw text first, so that only
    lines that may hold them are taken apart. ``dedup`` takes equal lines of a song once. Items that could all be missing are refused.
    """
    if not items or all(i.least == 0 for i in items) or len(items) > MOST_CONDITIONS or any(i.least < 0 or (i.most is not None and i.most < max(1, i.least)) for i in items):
        raise ValueError(f"one to {MOST_CONDITIONS} items, not all of which may be missing, with bounds in order")
    needed = [i.word for i in items if i.least > 0 and i.word]
    for n in needed:
        lines = lines.where(may_hold(F.col("text"), *n))
    rows = S.tokenized(lines)
    for attribute, value in needed:
        rows = rows.where(F.exists("tokens", _is(attribute, value)))
    if dedup:
        nth = F.row_number().over(Window.partitionBy("song_id", "text").orderBy("line_idx"))
        rows = rows.withColumn("_nth", nth).where("_nth = 1")
    letters = [chr(FIRST_LETTER + k) for k in range(1 << len(items))]
    number = lambda t: sum((F.when(i.holds(t), 1 << k).otherwise(0) for k, i in enumerate(items)), F.lit(0))
    bounds = lambda i: f"{{{i.least},{'' if i.most is None else i.most}}}"
    pattern = "".join(f"[{''.join(c for n, c in enumerate(letters) if n >> k & 1)}]{bounds(i)}" for k, i in enumerate(items))
    rows = rows.withColumn("_line", F.array_join(F.transform("tokens", lambda t: F.substring(F.lit("".join(letters)), number(t) + 1, F.lit(1))), ""))
    rows = rows.where(F.col("_line").rlike(pattern))
    if overlap:
        # one match a place: what begins there, looked ahead at, or a letter with nothing
        runs = F.transform(F.regexp_extract_all("_line", F.lit(f"(?=({pattern}))|."), F.lit(1)), lambda run, i: F.struct(i.alias("start"), F.length(run).alias("n")))
        placed = F.filter(runs, lambda m: m["n"] > 0)
    else:
        group = lambda n: F.transform(F.regexp_extract_all("_line", F.lit(f"(.*?)({pattern})"), F.lit(n)), F.length)
        pairs = F.zip_with(group(1), group(2), lambda before, n: F.struct(before.alias("before"), n.alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("found"))
        placed = F.aggregate(pairs, start, lambda a, p: F.struct((a["at"] + p["before"] + p["n"]).alias("at"), F.concat(a["found"], F.array(F.struct((a["at"] + p["before"]).alias("start"), p["n"].alias("n")))).alias("found")))["found"]
    hits = rows.select("song_id", "artist", "line_idx", "tokens", F.explode(placed).alias("m"))
    matched = F.array_join(F.transform(F.slice("tokens", F.col("m.start") + 1, F.col("m.n")), lambda t: t["surface"]), " ")
    found = hits.select("song_id", "artist", "line_idx", F.col("m.start").cast("long").alias("start"), F.col("m.n").cast("long").alias("length"), matched.alias("matched"))
    return found.orderBy("artist", "song_id", "line_idx", "start").limit(limit) if limit and limit > 0 else found


def _is(attribute: str, value: str) -> Callable[[Column], Column]:
    return lambda t: t[attribute] == value


# ---- full text ----


def trigrams(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def equal_to(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def full_text(lines: DataFrame, phrase: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Lines that hold ``phrase`` (case does not matter) with a rank, smaller is better. From three letters on the rank is minus the
    sum of BM25 over the phrase's trigrams; below, 0, and the order is by where the phrase stands."""
    hit = X.contains(F.col("text"), phrase)
    if len(phrase) < 3:
        out = lines.where(hit).select("song_id", "artist", "line_idx", "text", F.instr(F.lower("text"), phrase.lower()).cast("long").alias("at"), F.lit(0.0).alias("rank"))
        return out.orderBy("at", "artist", "song_id", "line_idx").limit(limit) if limit else out
    grams = sorted({phrase.lower()[i : i + 3] for i in range(len(phrase) - 2)})
    # each trigram's document frequency and the mean length: one pass, one row
    stats = lines.agg(F.count("*").alias("N"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("mean"), *[F.count_if(F.lower("text").contains(g)).alias(f"df{i}") for i, g in enumerate(grams)])
    rows = lines.where(hit).join(F.broadcast(stats))
    size = F.greatest(F.length("text") - 2, F.lit(0))
    rank = F.lit(0.0)
    for i, g in enumerate(grams):
        tf = equal_to(trigrams(F.col("text")), g).cast("double")
        idf = F.ln(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        rank -= idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.col("mean")))
    out = rows.select("song_id", "artist", "line_idx", "text", F.instr(F.lower("text"), phrase.lower()).cast("long").alias("at"), rank.alias("rank"))
    return out.orderBy(F.round("rank", 9), "artist", "song_id", "line_idx").limit(limit) if limit else out


def known_passages(lines: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """Which songs hold ``words`` words in a row of which passages: song_id, item_id, shared (different sequences).

    An equi-join on the sequences that both sides share, never a scan of every pair. Passages are counted first: few are looked up where the lines are, so that only sequences that are found move;
    beyond BROADCAST_ROWS sequences both sides are shuffled.
    """

    def sequences(rows: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        rows = rows.select(key, w.alias("w")).where(F.size("w") >= words)
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.array_join(F.slice("w", i + 1, words), " "))
        return rows.select(key, F.explode(F.array_distinct(grams)).alias("g"))

    there, here = settled(sequences(passages, "item_id").distinct()), sequences(lines, "song_id")
    met = here.join(F.broadcast(there), "g").distinct() if there.count() <= BROADCAST_ROWS else here.distinct().join(there, "g")
    return met.groupBy("song_id", "item_id").agg(F.count("*").alias("shared"))


def quick_search(songs: DataFrame, people: DataFrame, albums: DataFrame, words: DataFrame, lines: DataFrame, query: str, per_kind: int = 10) -> DataFrame:
    """kind, id, label, rank: up to ``per_kind`` (1 to 50) tracks, people, albums, words and lyrics that hold the query."""
    n = max(1, min(50, per_kind))

    def top(kind: str, rows: DataFrame, id_: str, label: str, *order: Column | str) -> DataFrame:
        rows = rows.where(X.contains(F.col(label), query)).orderBy(*order).limit(n)  # at most 50 rows
        rank = F.row_number().over(Window.orderBy(*order))
        return rows.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.col(label).alias("label"), rank.cast("long").alias("rank"))

    exact = F.when(F.lower("lemma") == query.lower(), 0).otherwise(1)
    parts = [
        top("track", songs, "song_id", "title", F.length("title"), "title", "song_id"),
        top("person", people, "person_id", "name", F.length("name"), "name", "person_id"),
        top("album", albums, "album_id", "title", F.length("title"), "title", "album_id"),
        top("word", words, "lemma", "lemma", exact, F.desc("freq"), "lemma", "pos"),
        top("lyric", lines.withColumn("_id", F.concat_ws(":", "song_id", "line_idx")), "_id", "text", F.instr(F.lower("text"), query.lower()), "artist", "song_id", "line_idx"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diverse_examples(lines: DataFrame, lemma: str, limit: int = 10) -> DataFrame:
    """Lines with a word: different texts, songs not seen yet first, then more of the same songs."""
    rows = S.tokenized(lines.where(may_hold(F.col("text"), "lemma", lemma))).where(F.exists("tokens", lambda t: t["lemma"] == lemma)).select("song_id", "line_idx", "text")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("song_id", "line_idx"))).where("_n = 1")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("song_id").orderBy("line_idx")).cast("long"))
    return rows.orderBy(F.col("nth") > 1, "song_id", "line_idx").limit(limit).select("song_id", "line_idx", "text", "nth")
