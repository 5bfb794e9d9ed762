"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, length-normalised, with exception phrases.

The lexicon is learned from labelled documents. An entry is a word's beginning or a whole word; its weight is the
log-odds of the entry's presence in toxic and other documents. Phrases around entries that only occur in
documents labelled as not toxic become exceptions; a phrase list can add more. The score is a logistic
function of the weight found per word and of the number of hits, fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import common

#: Labelled rows that the lexicon and the score are fitted on, at most (chosen by a hash of doc_id).
TRAINING_ROWS = 20_000
#: Entries and learned exceptions of a lexicon, at most.
LEXICON_ENTRIES, EXCEPTIONS = 2_000, 2_000
#: Entries are word beginnings of these lengths and whole words of up to WORD letters.
SHORTEST, LONGEST, WORD = 3, 8, 24

# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK_ALIKE = "аевкмнорстухіјѕӏԁɡαβεικνορτυχ"
LATIN = "aebkmhopctyxijsldgabeiknoptux"
# Signs written for letters inside words, and the letters.
SIGNS = "0134578@$"
LETTERS = "oieastbas"


class _Table(dict):
    """Letters and digits stay, look-alikes become Latin, all else a space."""

    def __missing__(self, c: int) -> int | str:
        out = chr(c) if chr(c).isalnum() or chr(c) in "@$" or unicodedata.combining(chr(c)) else " "
        self[c] = out
        return out


_TABLE = _Table({ord(a): b for a, b in zip(LOOK_ALIKE, LATIN, strict=True)})
_SIGNS = str.maketrans(SIGNS, LETTERS)
_MIXED = re.compile(r"[^\s0-9@$][0-9@$]|[0-9@$][^\s0-9@$]")
_SIGN = re.compile(r"[0-9@$]")


def _read(word: str) -> str:
    """A word with its signs read as letters, if it holds letters and few digits."""
    return word.translate(_SIGNS) if _SIGN.search(word) and any(c.isalpha() for c in word) and sum(c.isdigit() for c in word) <= 4 else word


def fold(text: str) -> str:
    """Words of a text, each with one space before it and one after the last: NFKC, lower case, look-alike letters
    made Latin, and signs inside words that also hold letters read as letters."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    if _MIXED.search(text):
        text = " ".join(map(_read, text.split()))
    return " " + " ".join(text.replace("@", " ").replace("$", " ").split()) + " "


def entries_of(word: str) -> list[str]:
    return [f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ([f" {word} "] if len(word) <= WORD else [])


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: Of 1, log(1 + weight per 1000 words), log(1 + hits) and the heaviest hit: the logistic's coefficients.
    coefficients: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.0)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, None
        if lexicon.weights:
            self.automaton = ahocorasick.Automaton()
            for phrase in lexicon.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            for entry, weight in lexicon.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, tuple[int, float]]:
        """{where the word starts: (end, weight)}; of several entries at a word the heaviest counts; exceptions taken out."""
        found: dict[int, tuple[int, float]] = {}
        spared = []
        if self.automaton is not None:
            for end, (length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end + 1))
                elif start not in found or weight > found[start][1]:
                    found[start] = (end + 1, weight)
        # from left to right: how far exceptions that have begun reach
        spared.sort()
        reach = n = 0
        for start in sorted(found) if spared else ():
            while n < len(spared) and spared[n][0] <= start:
                reach, n = max(reach, spared[n][1]), n + 1
            if found[start][0] <= reach:
                del found[start]
        return found

    def features(self, folded: str) -> tuple[float, ...]:
        weights = [w for _, w in self.hits(folded).values()]
        words = max(1, folded.count(" ") - 1)
        return math.log1p(1000 * sum(weights) / words), math.log1p(len(weights)), max(weights, default=0.0)

    def score(self, text: str | None) -> float:
        bias, *weights = self.lexicon.coefficients
        odds = bias + sum(w * x for w, x in zip(weights, self.features(fold(text or "")), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic (boolean) of labelled, not held-out documents; a hash of doc_id chooses ``limit`` of them."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """folded and toxic of each different folded text, told apart by 128 bits; it is toxic if any of its copies is."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(t or "") for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["folded", "toxic"])

    folded = rows.mapInArrow(run, "folded string, toxic boolean")
    return folded.groupBy(F.xxhash64("folded").alias("h1"), F.xxhash64(F.lit(1), "folded").alias("h2")).agg(F.any_value("folded").alias("folded"), F.max("toxic").alias("toxic")).select("folded", "toxic")


def _counted(texts: DataFrame, of, keep: int) -> DataFrame:
    """Different texts with each key, toxic and other; a task sums its own rows first."""

    def count(batches):
        counts, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for folded, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                counts[toxic].update(of(folded))
        keys = ["", *(counts[0].keys() | counts[1].keys())]
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"key": part, "bad": [counts[1][x] if x else n[1] for x in part], "fine": [counts[0][x] if x else n[0] for x in part]})

    return texts.mapInArrow(count, "key string, bad long, fine long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).where(F.col("bad") + F.col("fine") >= keep)


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), limit: int = TRAINING_ROWS) -> Lexicon:
    """Fit a lexicon. What reaches the driver is bounded: LEXICON_ENTRIES entries, EXCEPTIONS phrases and
    four numbers for each of at most ``limit`` rows. Without toxic or without other labelled rows it is empty."""
    rows = common.cut(training_rows(docs, labels, limit))
    texts = common.cut(distinct_texts(rows))
    counted = common.cut(_counted(texts, lambda folded: {e for w in set(folded.split()) for e in entries_of(w)}, 5))
    total = counted.where("key = ''").first()
    if total is None or not total["bad"] or not total["fine"]:
        return Lexicon(coefficients=(-4.0, 0.0, 0.0, 0.0))
    bad, fine = float(total["bad"]), float(total["fine"])
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("fine") + 0.5) / (fine + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("fine") + 0.5))
    strong = counted.where("key <> ''").withColumn("weight", weight).where((F.col("weight") > 1.5) & (weight / spread > 4) & (F.col("bad") >= 5))
    found = strong.orderBy(F.desc(weight / spread), "key").limit(LEXICON_ENTRIES).collect()
    support = {r["key"]: r["bad"] for r in found}
    #: Beginnings that nearly always go on in one and the same way say no more than what they go on to.
    dull = {k[:n] for k, n_bad in support.items() for n in range(2, len(k)) if n_bad >= 0.9 * support.get(k[:n], math.inf)}
    weights: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["key"]), r["key"])):
        shorter = max((weights[r["key"][:n]] for n in range(2, len(r["key"])) if r["key"][:n] in weights), default=0.0)
        if r["key"] not in dull and r["weight"] > shorter + 0.7:  # else a shorter beginning says as much
            weights[r["key"]] = r["weight"]
    lexicon = Lexicon(weights, tuple(fold(x) for x in exceptions))

    def phrases(folded: str, matcher=[]) -> set[str]:  # noqa: B006  one matcher for a task
        matcher or matcher.append(lexicon.matcher())
        out = set()
        for start in matcher[0].hits(folded):
            end = folded.index(" ", start + 1)
            before, after = folded.rfind(" ", 0, start) if start else 0, folded.find(" ", end + 1)
            out |= {folded[start : end + 1], folded[before : end + 1], folded[start : after + 1] if after > 0 else folded[start : end + 1]}
        return out

    spared = _counted(texts, phrases, 3).where("key <> '' AND bad = 0 AND fine >= 3").orderBy(F.desc("fine"), "key").limit(EXCEPTIONS).collect()
    lexicon.exceptions += tuple(r["key"] for r in spared)

    def features(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            out = [(*matcher.features(fold(text or "")), float(toxic)) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()) for c in (zip(*out, strict=True) if out else ((), (), (), ()))], ["x", "y", "z", "toxic"])

    data = rows.mapInArrow(features, "x double, y double, z double, toxic double").toPandas().to_numpy()
    lexicon.coefficients = logistic(data[:, :3], data[:, 3])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * len(y) * 1e-3 * np.eye(len(w)), x.T @ (y - p) - ridge * len(y) * 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of each row.

    Null and empty texts score as texts without hits; very long texts are matched whole, in one pass; null doc_ids
    and repeated rows are rows of their own; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out and score all rows: doc_id, held_out, score, predicted."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
