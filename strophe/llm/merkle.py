"""A content-addressed Merkle manifest of a dataset, and inclusion proofs by descent from its root.

Each tree's leaves, in order, are digested eight at a time until one node is left; the trees' roots are digested the same way. What is
stored is one record a node, digest to children. A request for leaves goes down from the root: the rank of
a leaf in base eight says at each node which child to take, the children not taken are collected, and the collected
segments, reversed, are the proof. Requests that share a node share its lookup, so that a level costs one join of as many rows as it
has wanted nodes; the eight leaves of a run share their path and get it in the last join only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm import common

#: Children of a node. A rank has BITS bits a level.
FANOUT, BITS = 8, 3
PATH = "array<struct<left:string,right:string>>"
ROW_BITS = 33


def field(c: Column) -> Column:
    """A value so that its end is known: "-" for null, else its bytes' number, ":", its text."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: how often eight go into one until one is left."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(21)), F.lit(0))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (cheap to read twice) as a checkpoint with ``name``: their place, gapless from 0, in ``order``; equal ones in any order.

    Ranges are sorted apart and counted, so no task sees all rows; a row number ends the sort key, so that equal rows spread too.
    """
    row, part, start = common.free_names(rows, "row", "part", "start")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(row)]
    placed = rows.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(row)
    placed = common.cut(placed.withColumn(name, F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright(name, ROW_BITS).alias(part)).agg(F.count("*").alias("n"))
    starts = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(start))  # one row a range
    met = placed.withColumn(part, F.shiftright(name, ROW_BITS)).join(starts, part)
    return met.withColumn(name, F.col(start) + F.col(name) - F.shiftleft(F.col(part), ROW_BITS)).drop(part, start)


def climb(nodes: DataFrame, most: int, folder: str) -> DataFrame:
    """Write the records above ``nodes`` (tree, rank, n: nodes of its tree, digest), a folder for each level; returns tree and digest of
    each tree's root. ``most`` is the largest n."""
    spark, level = nodes.sparkSession, 0
    roots = nodes.where("n = 1").select("tree", "digest")
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        run = nodes.where("n > 1").groupBy("tree", F.shiftright("rank", BITS).alias("rank"), F.ceil(F.col("n") / FANOUT).alias("n"))
        up = run.agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c")).select("tree", "rank", "n", F.col("c.digest").alias("children"))
        up.withColumn("digest", F.sha2(F.array_join("children", ""), 256)).write.parquet(f"{folder}/level={level}")
        nodes = spark.read.parquet(f"{folder}/level={level}")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return roots


def records(spark: SparkSession, folder: str, level: int) -> DataFrame:
    """The store as it is addressed: a digest and its children, equal subtrees once."""
    return spark.read.parquet(f"{folder}/level={level}").select("digest", "children").dropDuplicates(["digest"])


def descend(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """One level down: each node's children with the segment beside each of them added to its path."""
    met = frontier.join(store, "digest")
    beside = F.struct(F.array_join(F.slice("children", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("children", F.col("at") + 2, F.lit(FANOUT)), "").alias("right"))
    kept = [c for c in frontier.columns if c not in ("digest", "rank", "path")]
    out = met.select(*kept, "rank", "path", "children", F.posexplode("children").alias("at", "digest"))
    return out.select(*kept, (F.col("rank") * FANOUT + F.col("at")).alias("rank"), "digest", F.concat("path", F.array(beside)).alias("path"))


@dataclass(frozen=True)
class Manifest:
    """Where the records lie, the trees (tree, place, n, subroot) and the root (None: no leaves)."""

    folder: str
    trees: DataFrame
    most: int
    n_trees: int
    root: str | None


def build(leaves: DataFrame, tree: Column, order: list[Column], folder: str) -> tuple[DataFrame, Manifest]:
    """Number the leaves and write their manifest below ``folder`` (which must not exist).

    ``leaves`` has digest and any other columns; ``tree`` names each leaf's tree (null is a tree, the first), ``order`` its
    place there, ties by digest. Returns the leaves with tree (the tree's place) and rank, and the manifest. No leaves give no root.
    """
    spark = leaves.sparkSession
    rows = common.cut(leaves.withColumn("_tree", tree))
    rows = numbered(rows, [F.col("_tree").asc_nulls_first(), *order, F.col("digest")], "_at")
    sizes = rows.groupBy(F.col("_tree").alias("name")).agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    sizes = common.cut(numbered(sizes, [F.col("name").asc_nulls_first()], "tree"))
    most, n_trees = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    ranked = rows.join(sizes, F.col("_tree").eqNullSafe(F.col("name"))).withColumn("rank", F.col("_at") - F.col("first")).drop("_tree", "name", "_at", "first")
    subroots = common.cut(climb(ranked.select("tree", "rank", "n", "digest"), most, f"{folder}/trees"))
    top = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.lit(n_trees).cast("long").alias("n"), "digest")
    root = climb(top, n_trees, f"{folder}/top").first() if n_trees else None
    trees = sizes.join(subroots.withColumnRenamed("digest", "subroot"), "tree").select("tree", "name", "n", "subroot")
    return ranked, Manifest(folder, trees, most, n_trees, root.digest if root else None)


def levels_of(n: int) -> int:
    out = 0
    while n > 1:
        out, n = out + 1, -(-n // FANOUT)
    return out


def prove(requests: DataFrame, manifest: Manifest, every: bool = False) -> DataFrame:
    """``requests`` (tree, rank and any other columns) with subroot and path: the segments beside each node from the leaf up to the root.

    ``every`` says that all leaves are asked for, so that no node needs to be looked for among the wanted ones. Requests that repeat a leaf
    are answered each; requests for leaves that aren't there are left out.
    """
    spark, folder = requests.sparkSession, manifest.folder

    def wanted(nodes: DataFrame, level: int) -> DataFrame:
        asked = requests.select("tree", F.shiftright("rank", BITS * level).alias("rank")).distinct()
        return nodes if every else nodes.join(asked, ["tree", "rank"], "left_semi")

    top = spark.createDataFrame([(0, manifest.root, [])], f"rank long, digest string, path {PATH}").where("digest is not null")
    for level in range(levels_of(manifest.n_trees), 0, -1):
        top = descend(top, records(spark, f"{folder}/top", level))
    starts = top.withColumnRenamed("rank", "tree").join(manifest.trees.select("tree", "n", "subroot"), "tree")
    starts = common.cut(starts.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "subroot", height(F.col("n")).alias("height")))

    def at(level: int) -> DataFrame:
        return wanted(starts.where(F.col("height") == level).drop("height"), level)

    frontier = None
    for level in range(levels_of(manifest.most), 0, -1):
        frontier = at(level) if frontier is None else frontier.unionByName(at(level))
        if level > 1:
            frontier = wanted(descend(frontier, records(spark, f"{folder}/trees", level)), level - 1)
    # runs of leaves with their path; a tree of one leaf has no run
    runs = at(0).select("tree", "rank", "subroot", "path", F.lit(None).cast("array<string>").alias("children"))
    if frontier is not None:
        runs = runs.unionByName(frontier.join(records(spark, f"{folder}/trees", 1), "digest").select("tree", "rank", "subroot", "path", "children"))
    runs = runs.withColumnsRenamed({"tree": "run_tree", "rank": "run"})
    met = requests.join(runs, (F.col("tree") == F.col("run_tree")) & (F.shiftright("rank", BITS) == F.col("run")))
    digit = F.col("rank").bitwiseAND(FANOUT - 1).cast("int")
    there = F.coalesce(digit < F.size("children"), F.col("rank") == 0)
    beside = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"), F.array_join(F.slice("children", digit + 2, F.lit(FANOUT)), "").alias("right"))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(beside)))
    return met.where(there).withColumn("path", F.reverse(path)).drop("children", "run_tree", "run")


def siblings(path: Column) -> Column:
    """The digests of a proof in one text, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof make."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def check_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Every document's leaf, its proof from a manifest written below ``folder``, and whether the leaf still folds to the root after
    documents whose number's CRC-32 three divides had their text's A-Z made lower case.

    Trees are languages, null the first; leaves ascend by doc_id (null first, ties by digest). Null texts and other nulls are
    digested as such, empty texts as of 0 bytes; texts of any length are digested where they are read and never move. Documents
    without a doc_id are not tampered with. Repeated rows are leaves of their own with proofs of their own. An empty table gives no
    rows. Other columns are not read.
    """
    original = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.coalesce(common.unsigned_crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(hit, leaf_digest(*original[:-1], F.translate("text", capitals, capitals.lower())))
    leaves = docs.select("doc_id", "lang", leaf_digest(*original).alias("digest"), changed.alias("tampered"))
    ranked, made = build(leaves, F.col("lang"), [F.col("doc_id").asc_nulls_first()], folder)
    proofs = prove(ranked.drop("n", "lang"), made, every=True)
    out = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
