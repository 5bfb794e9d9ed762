"""Vector codes: vectors cut into parts, each part named by its nearest codebook entry, codebooks fitted in integers.

Nearest entries are found for a block's distinct parts at a time. In lexicographic order the parts are a trie: all parts below a
node share their first dimensions, and so the distances to all entries summed up over these. The trie is walked depth
first; a node adds one dimension to its sums for all of its children, and where a single part is left below a child, its
remaining dimensions are added at once. Leaves take the nearest entry and add to its weighted sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import common

#: Vectors whose parts make one trie.
BLOCK = 65_536
#: Children of a node that are added up at a time.
CHILDREN = 2_048
#: Components (scaled) from here on are refused: distances and their sums would leave 64 bits.
LARGEST = 2**26


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry number and squared distance of each of ``parts``: distinct rows in lexicographic order. Ties go to the lower number."""
    n, dims = parts.shape
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return codes, errors
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if dims * (2 * most) ** 2 < 2**52 else np.int64  # whole numbers below 2**53 are exact in either
    x, e = parts.astype(kind), entries.astype(kind)
    squares = np.zeros((dims + 1, len(e)), kind)
    squares[:dims] = (e**2)[:, ::-1].cumsum(axis=1)[:, ::-1].T  # of each entry's remaining dimensions

    def leaves(rows: np.ndarray, sums: np.ndarray, depth: int) -> None:
        rest = x[rows, depth:]
        sums = sums + (rest**2).sum(axis=1)[:, None] + squares[depth] - 2 * (rest @ e[:, depth:].T)
        codes[rows] = sums.argmin(axis=1)
        errors[rows] = sums[np.arange(len(rows)), codes[rows]]

    stack = [(0, n, 0, np.zeros(len(e), kind))]
    while stack:
        first, last, depth, sums = stack.pop()
        while depth < dims and x[first, depth] == x[last - 1, depth]:  # all parts below share it
            sums, depth = sums + (x[first, depth] - e[:, depth]) ** 2, depth + 1
        if depth == dims:
            leaves(np.arange(first, last), sums[None, :], depth)
            continue
        column = x[first:last, depth]
        starts = first + np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
        ends = np.append(starts[1:], last)
        below = []
        for k in range(0, len(starts), CHILDREN):
            a, b = starts[k : k + CHILDREN], ends[k : k + CHILDREN]
            grown = sums + (x[a, depth][:, None] - e[:, depth]) ** 2
            alone = b - a == 1
            if alone.any():
                leaves(a[alone], grown[alone], depth + 1)
            below += [(int(a[i]), int(b[i]), depth + 1, grown[i].copy()) for i in np.flatnonzero(~alone)]
        stack += reversed(below)
    return codes, errors


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the number of each row among them."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    new = np.ones(len(parts), bool)
    new[1:] = (parts[order][1:] != parts[order][:-1]).any(axis=1)
    number = np.empty(len(parts), np.int64)
    number[order] = new.cumsum() - 1
    return parts[order][new], number


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries (rows) of part p, whole numbers; ``scale``: what components were multiplied by."""

    entries: list[np.ndarray]
    scale: int

    @property
    def dims(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components as decimal text, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def cut_up(rows: list, dims: int, parts: int) -> np.ndarray:
    """Vectors as (parts, rows, dims of a part), zeros where a vector is short."""
    wide = np.zeros((len(rows), dims), np.int64)
    for k, v in enumerate(rows):
        wide[k, : len(v)] = v
    return wide.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)


def whole_vectors(vectors: DataFrame, scale: int) -> tuple[DataFrame, str]:
    """Rows whose embedding is neither null nor holds null or non-finite components, and the name of a column with its whole numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    (name,) = common.free_names(vectors, "whole")
    kept = vectors.where(F.coalesce(~F.exists("embedding", odd), F.lit(False)))
    return kept.withColumn(name, F.transform("embedding", whole)), name


def sums_of(rows: DataFrame, name: str, books: list[np.ndarray]) -> list[dict]:
    """For each part and entry that is the nearest one of any vector: how many vectors and the sums of their components.

    A block's copies are one trie leaf with a weight; each task sends one row an entry.
    """
    parts, width = len(books), books[0].shape[1]
    fields = [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64())] + [(f"s{d}", pa.int64()) for d in range(width)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: list = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= BLOCK:
                yield held[:BLOCK]
                held = held[BLOCK:]
        if held:
            yield held

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(e), np.int64) for e in books]
        total = [np.zeros(e.shape, np.int64) for e in books]
        for block in blocks(batches):
            for p, x in enumerate(cut_up(block, parts * width, parts)):
                kinds, number = distinct(x)
                weight = np.bincount(number, minlength=len(kinds))
                codes, _ = nearest(kinds, books[p])
                np.add.at(count[p], codes, weight)
                np.add.at(total[p], codes, kinds * weight[:, None])
        for p in range(parts):
            used = np.flatnonzero(count[p])
            columns = [np.full(len(used), p, np.int32), used.astype(np.int32), count[p][used], *total[p][used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    schema = ", ".join(f"{f} {'int' if t == pa.int32() else 'long'}" for f, t in fields)
    found = rows.select(name).mapInArrow(add_up, schema)
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)])
    return [r.asDict() for r in totals.collect()]  # parts x entries rows


def fit(rows: DataFrame, name: str, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks of whole-number vectors: at first the parts of the ``entries`` smallest vec_ids (nulls last, ties by the vector), then
    ``rounds`` times the floored means of what is nearest to each; unused entries stay. None without vectors."""
    dims, low, high = rows.agg(F.max(F.size(name)), F.min(F.array_min(name)), F.max(F.array_max(name))).first()
    if dims is None:
        return None
    if max(-(low or 0), high or 0) >= LARGEST:
        raise OverflowError(f"components of {LARGEST / scale} and more: distances could exceed 64 bits; take a smaller scale")
    dims = -(-dims // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), name).select(name).limit(entries).collect()
    books = list(np.ascontiguousarray(cut_up([r[0] for r in first], dims, parts)))
    for _ in range(rounds):
        for r in sums_of(rows, name, books):
            books[r["part"]][r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims // parts)]
    return Codebooks(books, scale)


def encoded(books: Codebooks, whole: str) -> Column:
    """codes (an entry number for each part) and error (squared distances over all parts) of a column of whole-number vectors."""
    entries, parts = books.entries, len(books.entries)

    @F.pandas_udf("codes array<int>, error long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, error = np.zeros((len(batch), parts), np.int64), np.zeros(len(batch), np.int64)
            for p, x in enumerate(cut_up(batch.tolist(), books.dims, parts)):
                kinds, number = distinct(x)
                found, far = nearest(kinds, entries[p])
                codes[:, p], error = found[number], error + far[number]
            yield pd.DataFrame({"codes": list(codes.astype(np.int32)), "error": error})

    return encode(whole)


def decoded(books: Codebooks, codes: Column) -> Column:
    """The vectors that codes stand for."""
    tables = [F.lit([[float(v) / books.scale for v in row] for row in e.tolist()]) for e in books.entries]
    return F.flatten(F.array(*[t[codes[p]] for p, t in enumerate(tables)]))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """Fit codebooks to ``vectors`` (vec_id, embedding and any other columns) and encode every one: its columns with codes and error.

    Components become floor(``scale`` * x). Vectors that are null or hold null or non-finite components are left out; short and empty ones
    count as zero in the dimensions they lack, and so does the last part where dimensions don't divide evenly. Null vec_ids and
    repeated rows are rows of their own; with fewer vectors than ``entries`` there are as many entries as vectors. Components so large that
    distances could leave 64 bits raise an OverflowError. An empty table gives no rows and no codebooks. Callers' own ``codes`` and
    ``error`` give way.

    Rows never move: a round is a pass over the vectors, in which a task sends a row for each part and entry, and the
    codebooks (parts x entries rows) go out with the next one.
    """
    rows, name = whole_vectors(vectors.drop("codes", "error"), scale)
    rows = common.cut(rows)
    books = fit(rows, name, parts, entries, rounds, scale)
    if books is None:
        return rows.drop(name).withColumns({"codes": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long")}), None
    (both,) = common.free_names(rows, "both")
    out = rows.withColumn(both, encoded(books, name)).drop(name)
    return out.withColumns({"codes": F.col(both)["codes"], "error": F.col(both)["error"]}).drop(both), books


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (errors summed over vectors of an equal label, nulls together) and codebooks_sha256."""
    coded, books = compress(vectors.select("vec_id", "embedding", "label"))
    coded = common.cut(coded.drop("embedding"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
