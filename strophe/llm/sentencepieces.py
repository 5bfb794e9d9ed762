"""SentencePiece encoding and decoding by one forward pass over a trie of marked words.

A text is its words, each with the mark of the space before it; no piece crosses a word start, so a text's ids
are its words' ids. A task takes the different words of its rows, sorts them and walks their trie depth-first:
the forward state of every prefix is kept on a stack, and a word reuses the states of the prefix it shares
with the one before it. Two kinds of models:

* unigram: the state of a prefix is its best sum of scores and the piece it ends in (Viterbi);
* BPE: the best segmentation is the one that merges give, not the one of the highest sum. Every prefix has
  exactly one such segmentation, and it ends in the one piece that may follow the last piece of the prefix before
  it, that is, where merging both pieces' letters gives these two pieces again. The state is that piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Different words, and pairs of pieces, that a worker remembers; beyond it the table starts anew.
REMEMBERED = 800_000
REMEMBERED_LENGTH = 64
#: Characters of text whose words are walked as one trie.
TRIE_CHARS = 4_000_000


class Pieces:
    """What a model file says: pieces, scores and kinds. ``read`` makes it on the driver; it is sent along with the job."""

    def __init__(self, pieces: list[str], scores: list[float], special: list[int], byte_ids: list[int], unknown: int, bpe: bool = True):
        self.pieces, self.scores, self.special, self.byte_ids, self.unknown, self.bpe = pieces, scores, special, byte_ids, unknown, bpe

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in n]
        scores = [sp.get_score(i) for i in n]
        special = [i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        byte_ids = [i for i in n if sp.is_byte(i)]
        whole = sum(s == int(s) for s in scores)  # BPE scores are ranks, unigram scores are logarithms
        return cls(pieces, scores, special, byte_ids, sp.unk_id(), whole > 0.99 * len(scores))


class Encoder:
    def __init__(self, model: Pieces):
        self.model = model
        aside = {*model.special, *model.byte_ids}
        self.ids = {p: i for i, p in enumerate(model.pieces) if i not in aside}
        self.bytes = {int(model.pieces[i][3:5], 16): i for i in model.byte_ids}
        self.letters = {p for p in self.ids if len(p) == 1}
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            tails.setdefault(p[-3:], set()).add(len(p))
        #: Lengths of pieces, long ones first, by the three letters that they end in.
        self.tails = {t: tuple(sorted(n | {1, 2}, reverse=True)) for t, n in tails.items() if len(t) == 3}
        self.strange = re.compile("[^" + "".join(re.escape(c) for c in sorted(self.letters)) + "]")
        self.follows: dict[tuple[str, str], bool] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.text_of = [p.replace(MARK, " ") for p in model.pieces]
        for b, i in self.bytes.items():
            self.text_of[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in model.special:
            self.text_of[i] = "" if i != model.unknown else " ⁇ "

    def merged(self, word: str) -> list[str]:
        """BPE by its definition: again and again, of all neighbours that form a piece, the best-scored, then leftmost."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.model.scores
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score[i], a, parts[a] + parts[b]))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, a, whole = heapq.heappop(heap)
            if parts[a] is None or after[a] >= len(parts) or parts[a] + parts[after[a]] != whole:
                continue
            b = after[a]
            parts[a], parts[b], after[a] = whole, None, after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p is not None]

    def may_follow(self, pair: tuple[str, str]) -> bool:
        if len(self.follows) > REMEMBERED:
            self.follows.clear()
        self.follows[pair] = out = self.merged(pair[0] + pair[1]) == [p for p in pair if p]
        return out

    def strange_ids(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")] if self.bytes else [self.model.unknown]

    def walk(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of different words of known letters, sorted: one depth-first pass over their trie."""
        out: dict[str, list[int]] = {}
        ids, follows, bpe, score, tails = self.ids, self.follows, self.model.bpe, self.model.scores, self.tails
        last, best, previous = [""], [0.0], ""
        for word in words:
            shared = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            previous = word
            for end in range(shared + 1, len(word) + 1):
                found, top = "", -1e300
                for length in tails.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    start = end - length
                    if start < 0 or (piece := word[start:end]) not in ids:
                        continue
                    if bpe:
                        pair = (last[start], piece)
                        ok = follows.get(pair)
                        if ok is None:
                            ok = self.may_follow(pair)
                        if ok:
                            found = piece
                            break
                    elif best[start] + score[ids[piece]] > top:
                        found, top = piece, best[start] + score[ids[piece]]
                last.append(found)
                best.append(top)
            back, at = [], len(word)
            while at:
                piece = last[at]
                if not piece:
                    raise ValueError(f"no segmentation of {word!r}")
                back.append(ids[piece])
                at -= len(piece)
            out[word] = back[::-1]
        return out

    def words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of different words as bytes. Letters without a piece part a word and become bytes."""
        parts = {w: re.split(f"({self.strange.pattern})", w) if self.strange.search(w) else None for w in words}
        plain = {w for w, p in parts.items() if p is None} | {x for p in parts.values() if p for x in p[::2] if x}
        runs = {w for w in plain if self.model.bpe and MARK in w[1:]}  # pieces of blanks share one score; rare
        found = self.walk(sorted(plain - runs)) | {w: [self.ids[p] for p in self.merged(w)] for w in runs}
        done = {}
        for w, p in parts.items():
            ids = found[w] if p is None else [i for k, x in enumerate(p) if x for i in (self.strange_ids(x) if k % 2 else found[x])]
            done[w] = np.array(ids, "<u4").tobytes()
        return done

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        split: list[list[str] | list[list[str]]] = []
        firsts, laters, odd = set(), set(), set()
        for text in texts:
            lines = [x.split(" ") for x in text.split("\n")]
            if MARK in text or not all(all(x) for x in lines):
                chunks = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []
                odd.update(chunks)
                split.append(chunks)
            else:
                laters.add(lines[0][0])
                for x in lines:
                    laters.update(x[1:])
                firsts.update(x[0] for x in lines[1:])
                split.append(lines)
        new_first = self.words(firsts.difference(self.first))
        new_later = {w[1:]: b for w, b in self.words({MARK + w for w in laters.difference(self.later)}).items()}
        odd_ids = self.words(odd)
        first, later = self.first, self.later
        first.update(new_first)
        later.update(new_later)
        newline = np.array(self.strange_ids("\n") if "\n" not in self.letters else [self.ids["\n"]], "<u4").tobytes()
        out = []
        for x in split:
            if not x or isinstance(x[0], str):
                out.append(b"".join(map(odd_ids.__getitem__, x)))
            else:
                head = later[x[0][0]] + b"".join(map(later.__getitem__, x[0][1:]))
                out.append(newline.join([head, *(first[y[0]] + b"".join(map(later.__getitem__, y[1:])) for y in x[1:])]))
        for table, new in ((first, new_first), (later, new_later)):
            for w in new:
                if len(w) > REMEMBERED_LENGTH:
                    del table[w]
        return out

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of ids: marks are spaces again, byte pieces are joined, the first space goes."""
        text = "".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids))
        if not text.isascii() and re.search("[\udc80-\udcff]", text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.removeprefix(" ")


@cache
def _encoder(key: int) -> list[Encoder]:
    return []


def encoder(model: Pieces) -> Encoder:
    """The worker's encoder of this model; kept while the worker lives."""
    kept = _encoder(zlib.crc32("\n".join(model.pieces).encode()))
    kept or kept.append(Encoder(model))
    return kept[0]


def _groups(texts: list[str]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= TRIE_CHARS:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of each whole text; with ``keep_ids`` the ids; with ``decoded`` the crc32 of the decoded
    text's UTF-8 bytes and whether it equals the text.

    Null and empty texts have no ids; very long texts are encoded whole; a space symbol of the model's own (U+2581)
    in a text reads as a space, as in the library; null doc_ids and repeated rows are rows of their own; an empty
    table gives no rows; other columns are not read.
    """
    model = Pieces.read(model_path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())] if decoded else []
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []

    def run(batches):
        worker = encoder(model)
        for batch in batches:
            docs, rows = iter(batch.column(0).to_pylist()), []
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                for text, ids in zip(group, worker.encode(group), strict=True):
                    row = (next(docs), len(ids) // 4, zlib.crc32(ids))
                    if decoded:
                        back = worker.decode(ids)
                        row += (zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text)
                    rows.append(row + ((np.frombuffer(ids, "<u4").astype(np.int32),) if keep_ids else ()))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, n_tokens long, ids_crc32 long" + (", decoded_crc32 long, round_trip boolean" if decoded else "") + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` (null ids: null text)."""
    model = Pieces.read(model_path)

    def run(batches):
        worker = encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else worker.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
