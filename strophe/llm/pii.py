"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a
classifier trained on the result decides.

One pass over the texts finds candidates: spans by the plain patterns (base spans, always kept) and looser ones.
Each candidate carries the votes of five labelers (format, gazetteer, context, variety, edges) and hashed
features of the span and its neighbours. The reliability of each labeler is estimated by expectation-
maximisation over counts of vote patterns of the whole corpus; the patterns' posteriors are the soft labels from
which a naive Bayes span classifier is summed up, again over the whole corpus. It decides the loose candidates.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm import common

#: Kinds in the order of results; the last two only come from the method.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE_KINDS = 4
#: Buckets that span features are hashed to.
FEATURES = 1024
#: Characters on either side of a span that context labelers read.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The plain pattern can only start at the first digit of a run, so looking behind changes no match and spares rescans.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z]{2,12}(?![A-Za-z])"), " at |[\\[(] ?at"),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), ":"),
    (3, re.compile(r"(?<![0-9A-Za-z(+])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"), None),
    (4, re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"), None),
    (5, re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|M|Mme|Señor|Señora|Sr|Sra)\.? [A-ZÀ-ÖØ-Þ][\w'-]{1,30}(?: [A-ZÀ-ÖØ-Þ][\w'-]{1,30})?"), "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Sra?|Monsieur|Madame|M)\\.? "),
)
# Words near a span that speak for a kind, and words that speak against any.
FOR_KIND = (
    ("mail", "contact", "write", "schreib", "écri", "correo", "@"),
    ("ip", "server", "host", "address", "adresse", "client", "login", "connect"),
    ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "pay"),
    ("phone", "call", "tel", "mobile", "fax", "ruf", "appel", "llam", "contact"),
    ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth", "credential"),
    ("dear", "signed", "said", "by", "von", "par", "por"),
)
AGAINST = ("version", "isbn", "issn", "page", "figure", "table", "chapter", "section", "order no", "sha", "commit", "hash", "doi")
# Common top-level domains, country calling codes by first digits, and first digits of card issuers.
DOMAINS = frozenset("com org net edu gov int io co info biz de fr es it uk eu us ca ch at nl be se no dk fi pl pt ru jp cn in br mx ar au nz".split())
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ISSUERS = ("2", "34", "35", "36", "37", "38", "4", "5", "6")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the plain patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """More candidates by place, none of which touches a base span. They may overlap until the classifier has decided."""
    found = []
    has_digit = bool(_DIGIT.search(text))
    for kind, pattern, needs in _LOOSE:
        if kind in (1, 3, 4) and not has_digit or needs and not re.search(needs, text):
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if kind != 4 or re.search("[0-9]", m[0])]
    if has_digit:
        found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19]
    out, used = [], sorted((a, b) for _, a, b in taken)
    k = 0
    for a, b, kind in sorted(found):
        while k < len(used) and used[k][1] <= a:
            k += 1
        if not (k < len(used) and used[k][0] < b):
            out.append((kind, a, b))
    return out


def apart(spans: list[dict]) -> list[dict]:
    """Base spans, and of loose ones that overlap the first by start, end and kind; sorted by kind and start."""
    out, ends = [s for s in spans if s["base"]], 0
    for s in sorted((s for s in spans if not s["base"]), key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= ends:
            out.append(s)
            ends = s["end"]
    return sorted(out, key=lambda s: (s["kind"], s["start"]))


def votes(text: str, kind: int, a: int, b: int, base: bool) -> str:
    """One of +, - and 0 of each labeler."""
    value, near = text[a:b], text[max(0, a - NEAR) : a].lower()
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == 2:
        form = "+" if luhn(digits) else "-"
    elif kind == 4:
        form = "+" if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", value) or (re.search("[a-z]", value) and re.search("[A-Z]", value) and digits) else "-"
    else:
        form = "+" if base else "0"
    if kind == 0:
        known = "+" if re.split(r"[^A-Za-z]+", value.lower())[-1] in DOMAINS else "-"
    elif kind == 2:
        known = "+" if digits.startswith(ISSUERS) else "-"
    elif kind == 3:
        known = "+" if value[0] == "+" and digits.startswith(COUNTRIES) else "0"
    elif kind == 1:
        known = "-" if digits.startswith("0") else "0"
    else:
        known = "0"
    context = "-" if any(w in near for w in AGAINST) else "+" if any(w in near for w in FOR_KIND[kind]) else "0"
    variety = "0" if len(digits) < 6 else "-" if len(set(digits)) <= 2 or digits in "01234567890123456789" else "+"
    edges = "-" if a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum() else "+"
    return form + known + context + variety + edges


def features(text: str, kind: int, a: int, b: int) -> list[int]:
    """Hashed features of a span: kind, length, its shape, and what stands on either side."""
    value, left = text[a:b], text[max(0, a - NEAR) : a].split()
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-zß-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", value))))[:32]
    side = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c
    raw = (f"k{kind}", f"n{kind}:{min(64, b - a).bit_length()}", f"s{kind}:{shape}", f"l{kind}:{side(text[a - 1]) if a else '^'}", f"r{kind}:{side(text[b]) if b < len(text) else '$'}", f"w{kind}:{left[-1].lower()[:16] if left else ''}", f"d{kind}:{sum(c.isdigit() for c in value)}")
    return [zlib.crc32(x.encode()) % FEATURES for x in raw]


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id and spans (kind, start, end, base, votes, features)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])

    def find(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
                out.append([{"kind": k, "start": a, "end": b, "base": plain, "votes": votes(text, k, a, b, plain), "features": features(text, k, a, b)} for k, a, b, plain in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean,votes:string,features:array<int>>>")


@dataclass
class Model:
    """Posterior of each (kind, votes), reliability of labelers by kind, and the classifier's weights by feature."""

    posterior: dict[tuple[int, str], float]
    reliability: dict[int, list[dict[str, tuple[float, float]]]]
    bias: float = 0.0
    weights: tuple[float, ...] = (0.0,) * FEATURES


def estimate(counts: dict[tuple[int, str], int], rounds: int = 60) -> Model:
    """Expectation-maximisation for each kind: labelers vote independently given the truth; starts from the majority."""
    model = Model({}, {})
    for kind in sorted({k for k, _ in counts}):
        seen = {v: n for (k, v), n in counts.items() if k == kind}
        truth = {v: min(0.9, max(0.1, 0.5 + 0.2 * (v.count("+") - v.count("-")))) for v in seen}
        for _ in range(rounds):
            total = sum(seen.values())
            share = (sum(n * truth[v] for v, n in seen.items()) + 1) / (total + 2)
            table = []
            for j in range(len(next(iter(seen)))):
                sums = {c: [0.5, 0.5] for c in "+-0"}
                for v, n in seen.items():
                    sums[v[j]][1] += n * truth[v]
                    sums[v[j]][0] += n * (1 - truth[v])
                all0, all1 = (sum(s[y] for s in sums.values()) for y in (0, 1))
                table.append({c: (s[0] / all0, s[1] / all1) for c, s in sums.items()})
            truth = {v: 1 / (1 + math.exp(min(500.0, math.log((1 - share) / share) + sum(math.log(table[j][c][0] / table[j][c][1]) for j, c in enumerate(v))))) for v in seen}
        model.posterior |= {(kind, v): p for v, p in truth.items()}
        model.reliability[kind] = table
    return model


def train(found: DataFrame) -> Model:
    """Fit on all candidates. The driver gets a count for each kind and vote pattern (6 x 243 at most) and two
    sums for each of FEATURES buckets."""
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    counts = {(r["kind"], r["votes"]): r["count"] for r in spans.groupBy("kind", "votes").count().collect()}
    model = estimate(counts)
    if not counts:
        return model
    posterior = F.create_map(*[F.lit(x) for (k, v), p in sorted(model.posterior.items()) for x in (f"{k}{v}", p)])
    soft = spans.select(F.explode("features").alias("f"), posterior[F.concat(F.col("kind").cast("string"), "votes")].alias("p"))
    sums = {r["f"]: (r["yes"], r["n"] - r["yes"]) for r in soft.groupBy("f").agg(F.sum("p").alias("yes"), F.count("*").alias("n")).collect()}
    yes, no = (sum(n * (p if y else 1 - p) for key, n in counts.items() for p in [model.posterior[key]]) for y in (1, 0))
    model.bias = math.log((yes + 1) / (no + 1))
    model.weights = tuple(math.log((sums[f][0] + 0.5) / (yes + 1)) - math.log((sums[f][1] + 0.5) / (no + 1)) if f in sums else 0.0 for f in range(FEATURES))
    return model


def decide(found: DataFrame, model: Model) -> DataFrame:
    """Keep base spans and loose candidates that the classifier finds likelier than not, of overlapping ones the first: doc_id, spans (kind, start, end, base, p)."""
    weights = F.array(*[F.lit(w) for w in model.weights])  # folded to one constant
    odds = lambda s: F.aggregate(s["features"], F.lit(model.bias), lambda a, f: a + F.get(weights, f))
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds(s)))))).alias("p")))
    kept = found.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["p"] >= 0.5)).alias("spans"))

    def settle(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([apart(s) for s in batch.column(1).to_pylist()], batch.schema.field(1).type)], ["doc_id", "spans"])

    return kept.mapInArrow(settle, kept.schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, sorted by kind and start; a row for each row of ``docs``.

    Null and empty texts have no spans; very long texts are read whole; offsets count code points, the end is
    exclusive; null doc_ids and repeated rows are rows of their own; an empty table gives no rows; other columns
    are not read.
    """
    found = common.cut(candidates(docs))
    return decide(found, train(found))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    n = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    return spans.select("doc_id", *n, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; other columns stay as they are.

    Two passes over the texts, the first to train, the second to decide and replace in place, so no text is
    shuffled. Overlapping spans of different kinds are replaced as one, named after the first. Null texts stay null.
    """
    model = train(common.cut(candidates(docs)))
    at = docs.columns.index("text")

    def replaced(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        loose = [s for s in (loose_spans(text, base) if text else []) if model.bias + sum(model.weights[f] for f in features(text, *s)) >= 0]
        spans = [(s["kind"], s["start"], s["end"]) for s in apart([{"kind": k, "start": a, "end": b, "base": n < len(base)} for n, (k, a, b) in enumerate(base + loose)])]
        if not spans:
            return text
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
            if a >= done:
                out += [text[done:a], f"<{KINDS[kind]}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            text = pa.array([replaced(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
