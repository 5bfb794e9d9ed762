"""Exact top-k search by inner product: columnar branch and bound, block by block.

Vectors become integers, floor(scale * x). Queries are a stated set of rows; they and all candidates are dealt to
blocks, and each pair of a query block and a candidate block is one task of bounded size. A task holds its
candidates in vertical layout, one row for each dimension, dimensions of most spread first, and adds up scores
one block of dimensions after another. What the remaining dimensions can add is at most the product of the
remaining norms (Cauchy-Schwarz); candidates that cannot reach the k-th best any more are compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm import common

#: Most vectors of a candidate block and of a query block, and most bytes of a block. Each vector is sent to every block of the
#: other side, so large blocks keep the shuffle small.
CANDIDATES, QUERIES, BLOCK_BYTES = 32_768, 32_768, 2**26
#: Dimensions that are added at a time.
DIMENSIONS = 8


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """Neither null nor empty, nor holding null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(embedding, odd) & (F.size(embedding) > 0), F.lit(False))


def search_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple[int, int, int]]:
    """(query number, candidate number, score) of each query's k best; ``own`` holds the queries' row numbers, which are skipped.

    Of equal scores at the k-th place the smaller ids stay.
    """
    dims = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")
    table = np.ascontiguousarray(vectors[:, dims].T)
    starts = list(range(0, len(dims), step))
    squares = (table.astype(np.float64) ** 2).cumsum(axis=0)
    total = squares[-1] if len(dims) else np.zeros(len(vectors))
    rest = [np.sqrt(np.maximum(total - squares[min(a + step, len(dims)) - 1], 0)) for a in starts]
    out = []
    for q, vector in enumerate(queries[:, dims]):
        norms = np.sqrt(np.maximum((vector.astype(np.float64) ** 2)[::-1].cumsum()[::-1], 0))
        alive = np.flatnonzero(rows != own[q])
        scores = np.zeros(len(alive), np.int64)
        least = None
        for n, a in enumerate(starts):
            b = min(a + step, len(dims))
            part = table[a:b] if len(alive) == table.shape[1] else table[a:b, alive]
            scores = scores + vector[a:b] @ part
            if b == len(dims) or len(alive) <= k:
                continue
            if least is None or n % 2:  # whole scores of the best so far bound the k-th best from below
                best = alive[np.argpartition(-scores, k - 1)[:k]]
                bound = np.sort(vector @ table[:, best])[0]
                least = bound if least is None else max(least, bound)
            reach = scores + norms[b] * rest[n][alive] * (1 + 1e-9) + 1
            keep = reach >= least
            if keep.sum() < 0.9 * len(alive):
                alive, scores = alive[keep], scores[keep]
        order = np.lexsort((ids[alive], -scores))[:k]
        out += [(q, int(alive[i]), int(scores[i])) for i in order]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best other rows; ties go to the smaller vec_id.

    ``vectors`` has vec_id and embedding. Null embeddings, empty ones and those that hold null or non-finite
    components take no part, as query or as candidate; null vec_ids take no part either. Vectors of fewer dimensions count as
    zero in the others. Rows that repeat a vec_id are rows of their own: a query skips only its own row. Vectors so large that a
    score could leave 64 bits raise an OverflowError. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("q"), whole_numbers(F.col("embedding"), scale).alias("v"))
    rows = common.cut(rows)
    n, asked, dims, most, least = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if n and dims * max(most, -least) ** 2 >= 2**63:
        raise OverflowError("scores of these vectors can exceed 64 bits; take a smaller scale")
    fit = max(1, BLOCK_BYTES // (8 * (dims or 1)))
    # few vectors are still dealt to all cores
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, groups = max(-(-n // min(CANDIDATES, fit)), min(cores, n // 1024), 1), max(1, -(-asked // min(QUERIES, fit)))
    at = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    candidates = rows.select(at(blocks).alias("b2"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g2"), *[F.col(c).alias(f"{c}2") for c in ("row", "vec_id", "v")])
    queries = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), at(groups).alias("g"), "row", "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(map(len, [*left["v"], *right["v2"]]))
        wide = lambda c: np.stack([np.pad(np.asarray(v, np.int64), (0, dims - len(v))) for v in c])
        ids = right["vec_id2"].to_numpy()
        found = search_block(wide(left["v"]), left["row"].to_numpy(), wide(right["v2"]), right["row2"].to_numpy(), ids, k)
        q, c, score = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pd.DataFrame({"query_row": left["row"].to_numpy()[q], "query_id": left["vec_id"].to_numpy()[q], "vec_id": ids[c], "score": score})

    found = queries.groupBy("b", "g").cogroup(candidates.groupBy("b2", "g2")).applyInPandas(search, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
