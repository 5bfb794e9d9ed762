"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Documents with equal n-gram sets form a class and go on as one. MinHash signatures are banded; the classes of a band
bucket are linked to the bucket's first class only, so a bucket of any size gives as many rows as it has classes.
Connected classes then meet, block by block, and every pair within is verified on the full n-gram sets: a pair that
shares a band is always in one connected group, so none is lost, and no pair is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import common

#: Classes of a verification block; larger groups become several blocks, each pair of blocks a task.
BLOCK = 256
#: Classes that small groups are put together to for one call.
TOGETHER = 1_024


def bands_for(threshold: float, recall: float = 0.999, rows: int = 7) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` hashes that find a pair at ``threshold`` with at least ``recall``.

    7 rows keep pairs of similarity 0.5 or less mostly apart (one band matches with 0.8 %); at 0.8 it takes 30 bands.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def shingles(text: Column, n: int = 5) -> Column:
    """The distinct hashes of a text's n-grams of lower-case words; fewer words than n: all of them as one; none: no hash."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(each)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), grams)[0]


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of 64-bit hashes, whatever their order."""
    x = values.view(np.uint64)
    with np.errstate(over="ignore"):
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        a = np.bitwise_xor.reduce(y ^ (y >> np.uint64(31)), initial=np.uint64(len(x)))
        b = np.add.reduce(z ^ (z >> np.uint64(29)), initial=np.uint64(len(x)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(flat: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes, one line for each set; sets must not be empty. ``flat`` holds the sets one after another."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    starts, x = np.concatenate([[0], np.cumsum(sizes)[:-1]]), flat.view(np.uint64)
    out = np.empty((len(sizes), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sizes), np.uint64(b + 1))
            for k in range(b * rows, (b + 1) * rows):
                low = np.minimum.reduceat((x ^ mask[k]) * odd[k], starts)
                h = (h ^ (low >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out[:, b] = h
    return out.view(np.int64)


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, size, s1 and s2 (hash of the n-gram set) and band hashes (none for an empty set) of each row."""

    def run(batches):
        for batch in batches:
            sets = batch.column(2)
            offsets = sets.offsets.to_numpy().astype(np.int64)
            flat = sets.values.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(offsets)
            s = [set_hash(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            found: list[np.ndarray | None] = [None] * len(sizes)
            at = 0
            while at < len(sizes):  # about a million n-grams at a time
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000)) - 1)
                full = [k for k in range(at, min(end, len(sizes))) if sizes[k]]
                if full:
                    part = flat[offsets[at] : offsets[min(end, len(sizes))]]
                    for k, line in zip(full, signatures(part, sizes[full], bands, rows), strict=True):
                        found[k] = line
                at = end
            lists = pa.array([[] if f is None else f for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array([a for a, _ in s], pa.int64()), pa.array([b for _, b in s], pa.int64()), lists], ["doc_id", "text_hash", "size", "s1", "s2", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), shingles(F.col("text"), n).alias("sets"))
    return rows_in.mapInArrow(run, "doc_id long, text_hash long, size long, s1 long, s2 long, bands array<long>")


def overlaps(sets: list[np.ndarray], first: int, dense: int = 8_000_000) -> np.ndarray:
    """Sizes of the intersections of the first ``first`` sets with all sets, by products of a few columns at a time.

    Values that one set alone holds add nothing and are left out; the tables in memory have at most ``dense`` cells.
    """
    line = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    line, column = line[shared], column[shared]
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    _, column = np.unique(column, return_inverse=True) if len(column) else (None, column)
    width = max(1, dense // len(sets))
    out = np.zeros((first, len(sets)), np.float32)
    for a in range(0, (int(column[-1]) + 1) if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        table = np.zeros((len(sets), min(width, int(column[-1]) + 1 - a)), np.float32)
        table[line[lo:hi], column[lo:hi] - a] = 1
        out += table[:first] @ table.T
    return out.astype(np.int64)


def verify(sets: list[np.ndarray], blocks: np.ndarray, low: int, high: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of linked pairs, i < j: both in block ``low`` if the blocks are one, else one in either."""
    order = np.argsort(blocks != low, kind="stable")
    mine = int((blocks == low).sum())
    if not mine or len(sets) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = overlaps([sets[k] for k in order], mine)
    sizes = np.array([len(sets[k]) for k in order])
    near = shared >= threshold * (sizes[:mine, None] + sizes[None, :] - shared) - 1e-9
    i, j = np.nonzero(near)
    ok = (i < j) if low == high else (j >= mine)
    return order[i[ok]], order[j[ok]]


def links(members: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """c, n_links and root (smallest class it hangs together with in this call) from each call that holds class c.

    ``members`` has c, doc_id, text_hash, copies, group, low, high, block and share, the key of the call.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    there = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    met = members.join(there, members["doc_id"].eqNullSafe(there["d"]) & (members["text_hash"] == there["t"])).drop("d", "t")
    # the key brings texts together; their n-grams are computed after the exchange
    sets = met.repartition("group", "low", "high").select("c", "copies", "group", "low", "high", "block", "root", shingles(F.col("text"), n).alias("set"))

    def call(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.drop_duplicates(["c"]).groupby("root"):
            c, copies = part["c"].to_numpy(), part["copies"].to_numpy()
            i, j = verify([np.asarray(s, np.int64) for s in part["set"]], part["block"].to_numpy(), int(key[1]), int(key[2]), threshold)
            found = np.zeros(len(c), np.int64)
            np.add.at(found, i, copies[j])
            np.add.at(found, j, copies[i])
            top = c.copy()
            while True:  # smallest class of each hanging-together part
                before = top.copy()
                np.minimum.at(top, i, before[j])
                np.minimum.at(top, j, before[i])
                if (top == before).all():
                    break
            keep = found > 0
            out.append(pd.DataFrame({"c": c[keep], "n_links": found[keep], "root": top[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "n_links": [], "root": []}).astype("int64")

    return sets.groupBy("group", "low", "high").applyInPandas(call, "c long, n_links long, root long")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links.

    Documents are linked if the Jaccard similarity of their n-gram sets is at least ``threshold``; class_id is the smallest
    doc_id of all documents that links connect, n_links the number of other rows that a row is linked to. Links are exact for
    every pair that shares a band, and that is every linked pair but one in 1 / (1 - recall).

    Texts of fewer than n words are compared by all their words. Null and empty texts have no n-grams and no links: their
    class is their own doc_id. Very long texts are compared whole. A null doc_id counts as the largest; a class of null
    doc_ids only has class_id null. Repeated rows are rows of their own and linked to each other. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    return classified(docs, n, threshold, recall).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``join`` with text_hash and stays: whether the row has the doc_id and text that stand for its class. Of the class's
    smallest doc_id that is one text; repeated rows of it all have the mark."""
    bands, rows = bands_for(threshold, recall)
    signed = common.cut(sign(docs, n, bands, rows))
    full = signed.where("size > 0")
    classes = full.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = common.cut(classes.withColumns({"doc_id": F.col("one.doc_id"), "text_hash": F.col("one.text_hash")}).withColumn("c", F.monotonically_increasing_id()))
    keyed = classes.select("c", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("c").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    groups = common.components(keyed.join(heads, "key").select(F.col("c").alias("a"), F.col("head").alias("b")))
    groups = common.cut(groups.select(F.col("node").alias("c"), "root"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    found = groups.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    found = found.join(classes.select("c", "doc_id", "text_hash", "copies"), "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    alone = max(1, -(-groups.count() // TOGETHER))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    found = found.select("*", other).select(
        "c", "doc_id", "text_hash", "copies", "block", "root",
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(alone))).otherwise(F.col("root")).alias("group"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    linked = common.cut(links(found, docs, n, threshold))
    counts = linked.groupBy("c").agg(F.sum("n_links").alias("n_links"))
    tops = common.components(linked.select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), "root")
    named = classes.select("c", "s1", "s2", "one", "copies").join(tops, "c", "left").join(counts, "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = named.groupBy("root").agg(F.min("one").alias("first"))
    named = named.join(first, "root").select("s1", "s2", "first", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = signed.where("size = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    found = full.select("doc_id", "text_hash", "s1", "s2").join(named, ["s1", "s2"])
    return found.select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "n_links", stays.alias("stays")).unionByName(empty)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row of ``docs`` for each class of ``join``: of the smallest doc_id, null the largest; of several texts of that doc_id
    the one of the smallest hash, of rows that repeat both any one. Null texts and texts without a word all stay. All
    columns stay; an empty table gives no rows."""
    d, t = common.free_names(docs, "d", "t")
    marks = classified(docs, n, threshold, recall).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(t), "stays")
    marks = common.cut(marks.agg((F.count_if(F.col("n_links") > 0) > 1).alias("twice")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t))
    kept = docs.join(marks.where("NOT stays").select(d, t), same, "left_anti")
    twice = common.cut(marks.where("stays AND twice").select(d, t))
    if twice.isEmpty():
        return kept
    # only rows that repeat doc_id and text meet here
    one = kept.join(twice, same).dropDuplicates([d, t]).select(docs.columns)
    return kept.join(twice, same, "left_anti").unionByName(one)
