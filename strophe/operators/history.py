"""State from logs: versions and when they held, corrections that follow their lines, facts that better sources and refusals settle.

A log is only appended to. What holds, now or at a time, is computed from it, so the same log gives the same state however often it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import names
from strophe.plans.rounds import settled

# Sources of a membership, weakest first.
SOURCES = ("musicbrainz", "confirmed", "manual")

# ---- versions ----


def version_history(log: DataFrame) -> DataFrame:
    """``log`` (song_id, at, id, content and any other columns; one row an import) with version_no (from 1), valid_from, valid_to (null: still holds), is_current, kind ("attached" or
    "replaced") and changed (its content differs from the version's before; null for the first). Imports of one time go by id."""
    song = Window.partitionBy("song_id").orderBy("at", "id")  # one song's versions
    rows = log.withColumns({"version_no": F.row_number().over(song).cast("long"), "valid_from": F.col("at"), "valid_to": F.lead("at").over(song), "_before": F.lag("content").over(song)})
    first = F.col("version_no") == 1
    out = rows.withColumns({"kind": F.when(first, "attached").otherwise("replaced"), "changed": F.when(~first, ~F.col("_before").eqNullSafe(F.col("content")))})
    last = F.lead("version_no").over(song).isNull()
    return out.withColumn("is_current", last).drop("_before")


def as_of(history: DataFrame, time: Column) -> DataFrame:
    """The version of each song that held at ``time``; songs that had none yet have no row. Of versions of one moment the last holds."""
    return history.where((F.col("valid_from") <= time) & (F.col("valid_to").isNull() | (F.col("valid_to") > time)))


def provenance(facts: DataFrame) -> DataFrame:
    """entity_type, entity_id, field, source, confidence and at of each field's newest entry; ``facts`` has these columns and id."""
    last = F.max_by(F.struct("source", "confidence", "at"), F.struct("at", "id"))
    return facts.groupBy("entity_type", "entity_id", "field").agg(last.alias("l")).select("entity_type", "entity_id", "field", "l.source", "l.confidence", "l.at")


# ---- corrections ----


def corrections_as_of(log: DataFrame, time: Column | None = None) -> DataFrame:
    """line_id, tokens, text, artist, title and at of the lines that are corrected, now or at ``time``. ``log``: line_id, at, id, action ("save" or "revert"), tokens, text, artist,
    title. A line's last entry decides; a save without tokens corrects nothing."""
    log = log if time is None else log.where(F.col("at") <= time)
    entry = F.struct("action", "tokens", "text", "artist", "title", "at")
    last = log.where("action = 'revert' OR size(tokens) > 0").groupBy("line_id").agg(F.max_by(entry, F.struct("at", "id")).alias("e"))
    return last.where("e.action = 'save'").select("line_id", "e.tokens", "e.text", "e.artist", "e.title", "e.at")


def restored(corrections: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id, tokens, old_line_id and moved: which lines of a song that came anew take which correction.

    ``lines``: line_id, line_idx, text, artist, title. A line takes the correction of its own text in a song of its artist and title, else one whose text is the same after compatibility composition and without outer
    blanks; of several the last by text and line. A line that the correction already belongs to is left as it is. All lines of the text take it, and the first of them keeps it (``moved``).
    """
    fold = lambda c: F.trim(names.nfkc(c))
    c = settled(corrections.where(F.size("tokens") > 0).select("artist", "title", "text", F.col("line_id").alias("old_line_id"), "tokens").withColumn("folded", fold(F.col("text"))))
    best = lambda key: c.groupBy("artist", "title", key).agg(F.max_by(F.struct("old_line_id", "tokens"), F.struct("text", "old_line_id")).alias(f"by_{key}"))
    rows = lines.withColumn("folded", fold(F.col("text"))).join(best("text"), ["artist", "title", "text"], "left").join(best("folded"), ["artist", "title", "folded"], "left")
    found = rows.withColumn("c", F.coalesce("by_text", "by_folded")).where(F.col("c").isNotNull() & (F.col("c.old_line_id") != F.col("line_id")))
    first = found.groupBy(F.col("c.old_line_id").alias("_old")).agg(F.min(F.struct("line_idx", "line_id")).alias("_first"))
    out = found.join(first, F.col("c.old_line_id") == F.col("_old"))
    return out.select("line_id", F.col("c.tokens").alias("tokens"), F.col("c.old_line_id").alias("old_line_id"), (F.col("line_id") == F.col("_first.line_id")).alias("moved"))


# ---- facts by rank, with tombstones ----


def _rank() -> Column:
    """A refusal counts as the strongest source."""
    rank = F.coalesce(*[F.when(F.col("source") == s, k) for k, s in enumerate(SOURCES)], F.lit(0))
    return F.when(F.col("action") == "reject", len(SOURCES) - 1).otherwise(rank)


def put_outcomes(log: DataFrame, key: list[str]) -> DataFrame:
    """``log`` (``key``, at, id, action "put" or "reject", source and what is put) with outcome: "inserted", "updated", "kept" (a better source has been there) or "rejected" (it was refused, and only a manual
    entry takes that back).

    An entry holds against all before it if it has the highest rank so far, so a running maximum says what it met.
    """
    before = Window.partitionBy(*key).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)  # one fact's entries
    rows = log.withColumn("_rank", _rank()).withColumn("_met", F.max(F.struct("_rank", "at", "id", "action")).over(before))
    weaker = F.col("_rank") < F.col("_met._rank")
    outcome = F.when(F.col("_met").isNull(), "inserted").when(weaker & (F.col("_met.action") == "reject"), "rejected").when(weaker, "kept").otherwise("updated")
    return rows.withColumn("outcome", outcome).drop("_rank", "_met")


def holding(log: DataFrame, key: list[str]) -> DataFrame:
    """The entry that holds for each key: the highest rank's newest one. Refused keys keep their refusal (action "reject"), so that it can be merged with later entries: of a log's
    parts in any order, of what held and what came since, the result is the same."""
    rows = log.withColumn("_rank", _rank())
    best = F.max_by(F.struct(*log.columns), F.struct("_rank", "at", "id"))
    return rows.groupBy(*key).agg(best.alias("_b")).select("_b.*")


def members(log: DataFrame, key: list[str]) -> DataFrame:
    return holding(log, key).where("action = 'put'")


def upsert(spark: SparkSession, folder: str, entries: DataFrame, key: list[str], buckets: int = 64) -> None:
    """Merge ``entries`` into the Parquet table of ``holding`` entries at ``folder``: only buckets of keys that come are read and written again.

    Merging the same entries again changes nothing, so a batch that failed, or that a stream sends twice, is simply merged again; use it in ``foreachBatch`` as it is.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
    fresh = settled(holding(entries, key).select("*", bucket))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    try:
        there = spark.read.schema(fresh.schema).parquet(folder).where(F.col("bucket").isin(touched)).select(*fresh.columns)
        fresh = fresh.unionByName(there)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    merged = settled(holding(fresh.drop("bucket"), key).select("*", bucket))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
