"""Packing documents into fixed-length training sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm import common, tokens

#: Pieces a packing task takes; more pieces make more tasks, each packed alone.
PIECES_A_TASK = 65_536


def fill_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fill windows of ``capacity`` from a multiset of lengths: yields ({length: copies}, windows filled so).

    Each pattern holds the longest remaining length. A bitset (bit s: sum s can be reached) runs the bounded
    subset-sum over the other remaining lengths, long ones first, and stops at an exact fill; the highest
    bit is the fill of least slack, and walking the saved bitsets backwards gives how many copies of each
    length make it. A pattern repeats while its copies last, so there are at most a few patterns a length,
    however many pieces there are.
    """
    left = dict(sorted(((n, c) for n, c in counts.items() if c > 0), reverse=True))
    while left:
        longest = next(iter(left))
        room = capacity - longest
        mask, reach, layers = (1 << (room + 1)) - 1, 1, []
        for n, have in left.items():
            if n > room:
                continue
            have = min(have - (n == longest), room // n)
            step = 1
            while have > 0:
                take = min(step, have)
                layers.append((n, take, reach))
                reach |= reach << (take * n) & mask
                have, step = have - take, step * 2
            if reach >> room:
                break
        at, used = reach.bit_length() - 1, Counter({longest: 1})
        for n, take, before in reversed(layers):
            if not before >> at & 1:
                at, used[n] = at - take * n, used[n] + take
        times = min(left[n] // c for n, c in used.items())
        yield dict(used), times
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece."""
    order = np.argsort(lengths, kind="stable")
    kinds, first = np.unique(lengths[order], return_index=True)
    next_of = dict(zip(kinds.tolist(), first.tolist(), strict=True))
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    base = 0
    for pattern, times in fill_windows(dict(Counter(lengths.tolist())), capacity):
        at = 0
        for n, c in pattern.items():
            k = order[next_of[n] : next_of[n] + c * times]
            next_of[n] += c * times
            window[k] = base + np.arange(c * times) // c
            offset[k] = at + np.arange(c * times) % c * n
            at += c * n
        base += times
    return window, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, keep_ids: bool = False) -> DataFrame:
    """Encode each document (null text: empty), append ``end_id`` and cut it every ``capacity`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, and with ``keep_ids`` the piece's ids.
    Where ``end_id`` is None, an empty document gives no piece.
    """
    spec = tokens.read_spec(tokenizer)
    end = b"" if end_id is None else tokens.packed([end_id])
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []

    def pieces(batches):
        encoder = tokens.encoder(spec)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n) + ((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ()))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = 2048, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Give each piece (column ``length``, 1 to ``capacity``) a ``sequence_id`` and its ``offset`` there.

    Pieces of full length are sequences of their own and move nowhere. The others are dealt at random, not by
    a key, to tasks of about ``pieces_a_task`` pieces, and each task packs its share by ``fill_windows``; the
    slack a task leaves is a few windows. Other columns pass through. ``pieces`` should be cheap to read
    twice (a checkpoint). No pieces give no rows; repeated rows are pieces of their own.
    """
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("_row") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    rest = pieces.where(F.col("length") < capacity)
    shares = max(1, -(-rest.count() // pieces_a_task))
    kinds = {f.name: f.dataType.simpleString() for f in full.schema.fields}
    names = list(kinds)

    def packed(key, share: pd.DataFrame) -> pd.DataFrame:
        window, offset = place(share["length"].to_numpy(), capacity)
        return share.assign(sequence_id=(window * shares + key[0]) * 2, offset=offset)[names]

    share = F.pmod(F.xxhash64("_row"), F.lit(shares)).alias("_share")
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    return full.unionByName(rest.select("*", share).groupBy("_share").applyInPandas(packed, schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents: ``token_pieces`` and ``pack``.

    Null texts and empty texts are the end id alone; very long texts are cut into many pieces; null doc_ids and
    repeated rows are packed as rows of their own; an empty table gives no rows; columns other than doc_id
    and text are not read.
    """
    return pack(common.cut(token_pieces(docs, tokenizer, capacity, end_id, keep_ids)), capacity)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The training rows of packed pieces that kept their ids: sequence_id, input_ids padded to ``capacity``
    (but not where the length is a power of two), n_tokens, and the pieces' doc_ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity ids a group
    out = packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
    n = F.size("ids")
    whole = n.bitwiseAND(n - 1) == 0
    return out.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))).alias("input_ids"), n.cast("long").alias("n_tokens"), "doc_ids")
