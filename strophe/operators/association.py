"""Collocations, networks of collocates, keyness between sub-corpora, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import measures as M
from strophe.plans import stream as S
from strophe.plans.scope import DISTINCT_LINES, TOKENS

MEASURES = ("log_dice", "mi", "log_likelihood", "mi3", "delta_p", "freq")


def neighbours(tokens: DataFrame, node: str, left: int, right: int) -> DataFrame:
    """Tokens around each occurrence of ``node`` in its line: lemma, pos, song_id, side (-1 or 1).

    Lines are cut into stretches as long as the window; an occurrence meets the one or two stretches that its window touches. So only what stands near the node is joined, in
    lines of any length, and the other lines' tokens go no further than the scan where the occurrences are few.
    """
    width = left + right + 1
    at = tokens.where(F.col("lemma") == node).select("song_id", "line_idx", F.col("idx").alias("_at"))
    at = at.withColumn("_part", F.explode(F.sequence(F.floor((F.col("_at") - left) / width), F.floor((F.col("_at") + right) / width))))
    rows = tokens.select("song_id", "line_idx", "idx", "lemma", "pos", F.floor(F.col("idx") / width).alias("_part"))
    met = rows.join(at, ["song_id", "line_idx", "_part"]).withColumn("_d", F.col("idx") - F.col("_at"))
    return met.where((F.col("_d") >= -left) & (F.col("_d") <= right) & (F.col("_d") != 0)).select("song_id", "lemma", "pos", F.sign("_d").cast("int").alias("side"))


def collocations(tokens: DataFrame, node: str, left: int = 5, right: int = 5, unit: str = TOKENS, min_freq: int = 2, pos: str | None = None, content_only: bool = False, measure: str = "log_dice", limit: int | None = 100) -> DataFrame:
    """Collocates of ``node`` with freq, freq_left, freq_right, collocate_freq, songs and eight measures.

    The expected count is the number of places in all windows times the collocate's share of all tokens. The node's own
    place is left out, other occurrences of it are not. Ties by freq, lemma, pos.
    """
    rows = S.counted(tokens, unit)
    near = neighbours(rows, node, left, right)
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.col("lemma") == node).alias("node_freq"))
    found = near.groupBy("lemma", "pos", "song_id").agg(F.count_if(F.col("side") < 0).alias("l"), F.count_if(F.col("side") > 0).alias("r"))
    found = found.groupBy("lemma", "pos").agg(F.sum("l").alias("freq_left"), F.sum("r").alias("freq_right"), F.count("*").alias("songs")).withColumn("freq", F.col("freq_left") + F.col("freq_right"))
    slots = found.agg(F.sum("freq").alias("slots"))
    found = found.where(F.col("freq") >= max(1, min_freq))
    if pos:
        found = found.where(F.col("pos") == pos)
    if content_only:
        found = found.where(~F.col("pos").isin(*S.FUNCTION_POS))
    counts = rows.groupBy("lemma", "pos").agg(F.count("*").alias("collocate_freq"))
    out = found.join(counts, ["lemma", "pos"]).join(F.broadcast(totals)).join(F.broadcast(slots))  # one row each
    o, fc, n, slot = (F.col(c).cast("double") for c in ("freq", "collocate_freq", "n", "slots"))
    expected = slot * fc / F.greatest(n, F.lit(1.0))
    a, b, c = o, F.greatest(slot - o, F.lit(0.0)), F.greatest(fc - o, F.lit(0.0))
    d = F.greatest(n - slot - c, F.lit(0.0))
    out = out.select(
        "lemma", "pos", "freq", "freq_left", "freq_right", "collocate_freq", "songs",
        (14 + F.log2(2 * o / F.greatest(F.col("node_freq") + fc, F.lit(1.0)))).alias("log_dice"), F.log2(o / expected).alias("mi"), M.g2(a, b, c, d).alias("log_likelihood"),
        ((o - expected) / F.sqrt(o)).alias("t_score"), F.log2(o * o * o / expected).alias("mi3"), ((o - expected) / F.sqrt(expected)).alias("z_score"),
        (M.ratio(a, b) - M.ratio(c, d)).alias("delta_p"), (M.ratio(a, c) - M.ratio(b, d)).alias("delta_p_reverse"),
    )
    return out.orderBy(F.desc(measure), F.desc("freq"), "lemma", "pos").limit(limit) if limit is not None else out


def network(tokens: DataFrame, node: str, left: int = 5, right: int = 5, unit: str = TOKENS, nodes: int = 20, per_node: int = 3, min_freq: int = 2) -> DataFrame:
    """Edges (a, b, freq, log_dice) among a word's best collocates: pairs of different ones within the window of each other in a
    line, kept if among the ``per_node`` strongest of either end."""
    window = max(left, right, 1)
    rows = S.counted(tokens, unit)
    best = collocations(tokens, node, left, right, unit, min_freq, limit=nodes).select("lemma").distinct()
    chosen = rows.join(F.broadcast(best), "lemma").select("song_id", "line_idx", "idx", "lemma")  # at most ``nodes`` words
    freq = chosen.groupBy("lemma").agg(F.count("*").alias("f"))
    # places meet those up to a window after them: in their own stretch of the line and the next one
    stretch = F.floor(F.col("idx") / window)
    one = chosen.select("song_id", "line_idx", F.col("idx").alias("i"), F.col("lemma").alias("x"), F.explode(F.array(stretch, stretch + 1)).alias("part"))
    two = chosen.select("song_id", "line_idx", F.col("idx").alias("j"), F.col("lemma").alias("y"), stretch.alias("part"))
    near = one.join(two, ["song_id", "line_idx", "part"]).where((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= window) & (F.col("x") != F.col("y")))
    pairs = near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("freq")).where(F.col("freq") >= max(1, min_freq))
    fa, fb = freq.select(F.col("lemma").alias("a"), F.col("f").alias("fa")), freq.select(F.col("lemma").alias("b"), F.col("f").alias("fb"))
    edges = pairs.join(F.broadcast(fa), "a").join(F.broadcast(fb), "b").withColumn("log_dice", 14 + F.log2(2.0 * F.col("freq") / (F.col("fa") + F.col("fb"))))
    ends = edges.select("*", F.explode(F.array("a", "b")).alias("end"))
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy(F.desc(F.round("log_dice", 9)), "a", "b")))
    return ranked.where(F.col("rank") <= per_node).select("a", "b", "freq", "log_dice").distinct()


def keyness(target: DataFrame, reference: DataFrame, unit: str = TOKENS, pos: str | None = None, min_freq: int = 5, max_p: float | None = None, bonferroni: bool = False, limit: int | None = 100) -> DataFrame:
    """Words of target against reference tokens: side (over or under), signed log_likelihood, log_ratio, p_value, bic,
    percent_diff and counts; words of likelihood 0 are on neither side. Totals ignore ``pos``; of each side the strongest ``limit``."""

    def counts(tokens: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
        rows = S.counted(tokens, unit)
        total = rows.agg(F.count("*").alias(f"{prefix}_total"))
        rows = rows.where(F.col("pos") == pos) if pos else rows
        by_song = rows.groupBy("lemma", "pos", "song_id").agg(F.count("*").alias("n"))
        return by_song.groupBy("lemma", "pos").agg(F.sum("n").alias(f"{prefix}_freq"), F.count("*").alias(f"{prefix}_songs")), total

    (t, t_total), (r, r_total) = counts(target, "target"), counts(reference, "reference")
    both = t.join(r, ["lemma", "pos"], "full").fillna(0, ["target_freq", "target_songs", "reference_freq"]).where(F.col("target_freq") + F.col("reference_freq") >= max(1, min_freq))
    both = both.join(F.broadcast(t_total)).join(F.broadcast(r_total))  # one row each
    a, b = F.col("target_freq").cast("double"), F.col("reference_freq").cast("double")
    c, d = F.greatest("target_total", F.lit(1)).cast("double"), F.greatest("reference_total", F.lit(1)).cast("double")
    half = F.lit(0.5)
    out = both.withColumn("_ll", M.keyness_ll(a, b, c, d))
    out = out.select(
        "lemma", "pos", "target_freq", "reference_freq", "target_songs",
        M.per_10k(a, F.col("target_total")).alias("target_per_10k"), M.per_10k(b, F.col("reference_total")).alias("reference_per_10k"),
        F.when(a / c >= b / d, F.col("_ll")).otherwise(-F.col("_ll")).alias("log_likelihood"), F.log2((F.greatest(a, half) / c) / (F.greatest(b, half) / d)).alias("log_ratio"),
        M.chi2_p(F.col("_ll")).alias("p_value"), (F.col("_ll") - F.ln(c + d)).alias("bic"), F.when(b > 0, (a / c - b / d) / (b / d) * 100).alias("percent_diff"),
    )
    if max_p:
        if bonferroni:
            out = out.join(F.broadcast(out.agg(F.greatest(F.count("*"), F.lit(1)).alias("_tests")))).where(F.col("p_value") <= F.lit(max_p) / F.col("_tests")).drop("_tests")
        else:
            out = out.where(F.col("p_value") <= max_p)
    side = F.when(F.col("log_likelihood") > 0, "over").when(F.col("log_likelihood") < 0, "under")
    out = out.withColumn("side", side).where("side IS NOT NULL")
    if limit is None:
        return out
    order = [F.desc(F.abs(F.round("log_likelihood", 6))), "lemma", "pos"]
    # each side's strongest by a bounded top-k, not by a window over half of all words
    return out.where("side = 'over'").orderBy(*order).limit(limit).unionByName(out.where("side = 'under'").orderBy(*order).limit(limit))


def song_profile(tokens: DataFrame, song_id, limit: int = 20) -> DataFrame:
    """A song's key content words against all other songs, each distinct line once."""
    found = keyness(tokens.where(F.col("song_id") == song_id), tokens.where(F.col("song_id") != song_id), DISTINCT_LINES, min_freq=1, limit=4 * limit)
    content = found.where((F.col("side") == "over") & ~F.col("pos").isin(*S.FUNCTION_POS, "PRON", "NUM"))
    return content.orderBy(F.desc(F.round("log_likelihood", 6)), "lemma", "pos").limit(limit)


def breakdown(tokens: DataFrame, words: tuple[str, ...], by: str) -> DataFrame:
    """Hits of any of ``words`` for each group: key, hits, songs, tokens, per_10k and ratio to the whole. Groups without tokens are none."""
    hit = F.col("lemma").isin(*words)
    groups = tokens.groupBy(F.col(by).alias("key"), "song_id").agg(F.count_if(hit).alias("h"), F.count("*").alias("n")).groupBy("key").agg(F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("songs"), F.sum("n").alias("tokens"))
    whole = groups.agg(F.sum("hits").alias("_h"), F.sum("tokens").alias("_n"))
    out = groups.join(F.broadcast(whole))
    share = M.per_10k(F.col("hits"), F.col("tokens"))
    return out.select("key", "hits", "songs", "tokens", share.alias("per_10k"), F.coalesce(F.try_divide(share, M.per_10k(F.col("_h"), F.col("_n"))), F.lit(0.0)).alias("ratio"))
