"""Chat rendering of logged conversations after collapsing cumulative snapshots.

A log often holds a conversation again and again as it grows. Each conversation's turns get rolling prefix hashes; a
conversation whose last hash is a prefix hash of a longer one goes, and of equal ones the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm import common

# The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place (from 1) in its conversation, the conversation's size and the prefix hashes h1 and h2.

    The hash of a prefix is the exclusive-or of its turns' 64-bit hashes, each taken together with the turn's place,
    under two seeds: 128 bits in all, so one window pass gives all prefixes. Turns order by ``turn`` (nulls first), ties by role
    and text. A null conv_id makes each row a conversation of its own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    whole = Window.partitionBy("conv_id", "alone")
    so_far = whole.orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(so_far).cast("long"))
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns(
        {
            "h1": F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far),
            "h2": F.bit_xor(F.xxhash64(F.lit(1), "place", "role", "text")).over(so_far),
            "n_turns": F.count("*").over(whole),
        }
    )


def maximal(rows: DataFrame) -> DataFrame:
    """Of ``prefixes``: conv_id, alone, n_turns, h1, h2 of conversations that no longer or equal, smaller-numbered one contains as a prefix.

    Equal prefixes are summed up (most turns, smallest conv_id of those that end there) before anything is joined, so a
    first turn that a third of all conversations share is one row.
    """
    # what the conversations themselves are: their last turns
    ends = rows.where("place = n_turns").select("conv_id", "alone", "n_turns", "h1", "h2")
    longer = rows.groupBy("h1", "h2", F.col("place").alias("n_turns")).agg(F.max("n_turns").alias("most")).where("most > n_turns").select("h1", "h2", "n_turns")
    kept = ends.join(longer, ["h1", "h2", "n_turns"], "left_anti")
    first = kept.where("conv_id IS NOT NULL").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("alone"))
    # conversations without a number: one of equal ones, if no numbered one is equal
    nameless = kept.where("conv_id IS NULL").groupBy("h1", "h2", "n_turns").agg(F.lit(None).cast("long").alias("conv_id"), F.min("alone").alias("alone"))
    return first.unionByName(nameless.join(first.select("h1", "h2", "n_turns"), ["h1", "h2", "n_turns"], "left_anti")).select("conv_id", "alone", "n_turns", "h1", "h2")


def render(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """conv_id, n_turns and text of each maximal conversation: all its turns in order, as role and text between marks.

    Null roles and texts read as empty ones; very long texts are kept whole; repeated rows are turns of their own; an
    empty table gives no rows; other columns are not read. A conversation becomes one row, so it has to fit one.
    """
    said = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end + "\n")).alias("said")
    rows = common.cut(prefixes(turns))
    keep = maximal(rows).select("conv_id", "alone")
    same = rows["conv_id"].eqNullSafe(keep["conv_id"]) & rows["alone"].eqNullSafe(keep["alone"])
    kept = rows.join(keep, same, "left_semi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", said))), lambda x: x["said"]), "")
    return kept.groupBy("conv_id", "alone").agg(F.count("*").alias("n_turns"), text.alias("text")).drop("alone")
