import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.operators import spans


def test_alignment_equals_plain_search(spark):
    rng = random.Random(3)
    lines = []
    for k in range(60):
        text = "".join(rng.choice("ab 夜,") for _ in range(rng.randint(0, 14)))
        cut = lambda: [p for p in "".join(c + ("|" if rng.random() < 0.4 else "") for c in text).split("|") if rng.random() < 0.9]
        lines.append((k, text, cut(), [w for w in cut() if w.strip()] + (["zz"] if k % 9 == 0 else []), "extra"))
    lines += [(100, "a b c " * 20_000, ["a", "b", "c"] * 20_000, ["a b", "c"] * 20_000, "x"), (101, None, ["a"], ["a"], "x"), (102, "a", None, ["a"], "x"), (103, "aa", ["", "aa"], [""], "x")]
    frame = spark.createDataFrame(lines, "k int, text string, ours array<string>, theirs array<string>, idx string")
    rows = spans.align_tokens(frame, ["k"], "ours", "theirs").collect()
    for k, text, ours, theirs, _ in lines[:60]:
        a, b = spans.spans_of(text, ours), spans.spans_of(text, theirs)
        got = sorted((r for r in rows if r.k == k), key=lambda r: r.idx)
        assert [r.surface for r in got] == ours
        for r, s in zip(got, a, strict=True):
            met = [j for j, t in enumerate(b) if s and t and t["start"] < s["stop"] and s["start"] < t["stop"]]
            same = next((j for j, t in enumerate(b) if s and t == s), None)
            assert (r.start, r.first, r.last, r.same) == (s and s["start"], met[0] if met else None, met[-1] if met else None, same)
    long = [r for r in rows if r.k == 100]
    assert len(long) == 60_000 and sum(r.same is not None for r in long) == 20_000 and not [r for r in rows if r.k in (101, 102)]
    assert [(r.surface, r.start) for r in rows if r.k == 103] == [("", None), ("aa", 0)]


def test_spans_of_all_lines_of_a_batch_are_those_of_each():
    rng = random.Random(7)
    texts = ["a b", "ab", " a  b ", "", "夜 é𝄞x", "aa a", "a\u00a0b", "ab ab", "x"]
    surfaces = [["ab"], ["a", "", "b"], ["a", "b"], [], ["夜", "é", "𝄞x"], ["a", "a", "a"], ["a\u00a0b"], ["a", "b", "b", "a"], [None, "x"]]
    for _ in range(200):
        texts.append("".join(rng.choice("ab é夜 \t") for _ in range(rng.randint(0, 20))))
        surfaces.append(texts[-1].split() if rng.random() < 0.7 else [rng.choice(["a", "b a", "é", ""]) for _ in range(rng.randint(0, 5))])
    start, stop, firsts = spans._spans_of_all(pa.array(["skipped", *texts]).slice(1), pa.array([["s"], *surfaces]).slice(1))
    for k, (text, tokens) in enumerate(zip(texts, surfaces, strict=True)):
        here = slice(firsts[k], firsts[k + 1])
        want = [(-1, -1) if s is None else (s["start"], s["stop"]) for s in spans.spans_of(text, tokens)]
        assert list(zip(start[here].tolist(), stop[here].tolist(), strict=True)) == want


def test_annotate_takes_each_of_two_lines_of_one_key_by_itself(spark):
    frame = spark.createDataFrame([(1, "a b", ["a", "b"], [("a", "x")]), (1, "a c", ["a"], [("a", "y")])], "k int, text string, old array<string>, new array<struct<surface:string,morph:string>>")
    alone = spark.createDataFrame([("b", "z")], "surface string, morph string")
    got = sorted((r.idx, r.surface, r.morph, r.how) for r in spans.annotate(frame, ["k"], "old", "new", alone).collect())
    assert got == [(0, "a", "x", "context"), (0, "a", "y", "context"), (1, "b", "z", "alone")]


def test_offsets_allow_only_blanks_between(spark):
    rows = [("君 の　名は", ["君", "の", "名は"]), ("a-b", ["a", "b"]), ("ab", ["a", "", "b"]), ("", []), ("x", ["xyz"]), (None, ["a"]), ("aab", ["ab"])]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s array<string>").coalesce(1).select(spans.aligned_offsets(F.col("t"), F.col("s"))).collect()]
    assert got == [[0, 2, 4], None, [0, 1, 1], [], None, None, None]


def test_annotate(spark):
    morph = "array<struct<surface:string,morph:string>>"
    frame = spark.createDataFrame([(1, "今夜は 夜", ["今夜", "は", "夜", "x"], [("今", "ima"), ("夜は", "yoha"), (" ", "blank"), ("夜", "yoru")]), (2, "a", ["a"], [("a", None)])], f"k int, text string, old array<string>, new {morph}")
    alone = spark.createDataFrame([("は", "wa"), ("夜", "night")], "surface string, morph string")
    got = {(r.k, r.surface): (r.morph, r.how) for r in spans.annotate(frame, ["k"], "old", "new", alone).collect()}
    assert got == {(1, "今夜"): (None, "unknown"), (1, "は"): ("wa", "alone"), (1, "夜"): ("yoru", "context"), (1, "x"): (None, "unknown"), (2, "a"): (None, "context")}


WORDS = "array<struct<char_start:long,char_end:long,start_sec:double,end_sec:double>>"


def test_timelines(spark):
    good = [(0, 1, 1.0, None), (1, 2, 1.5, 1.4)]
    lines = [
        (1, 0, "ab", 1.0, 3.0, good), (1, 1, "cd", 1.0, None, [(0, 1, 2.0, None), (0, 2, 2.5, None)]), (1, 2, " ", 2.0, None, None), (1, 3, "ef", 5.0, 4.0, None), (1, 4, "gh", -1.0, None, good), (1, 5, "ij", 99.0, None, None),
        (1, 6, "kl", None, None, None), (1, 7, "mn", 9.0, None, [(0, 2, 9.0, None)]), (1, 8, "ab", 1.0, None, [(0, 3, 1.0, None)]), (2, 0, "x", float("nan"), None, None), (3, 0, "y", 4.0, None, []),
    ]
    frame = spark.createDataFrame(lines, f"song_id int, line_idx int, text string, start_sec double, end_sec double, words {WORDS}")
    lengths = spark.createDataFrame([(1, 10.0), (2, None)], "song_id int, duration_sec double")
    out = spans.build_timelines(frame, lengths)
    rows = {(r.song_id, r.line_idx): r for r in out.collect()}
    times = {k: (r.place, r.start_ms, r.end_ms, r.mended) for k, r in rows.items()}
    assert times == {
        (1, 0): (0, 1000, 3000, None), (1, 1): (1, 1000, 5000, None), (1, 8): (2, 1000, 5000, None), (1, 3): (3, 5000, 9000, "end"), (1, 7): (4, 9000, 10000, None), (1, 4): (5, None, None, "invalid"), (1, 5): (6, None, None, "over"), (1, 6): (7, None, None, None),
        (2, 0): (0, None, None, "invalid"), (3, 0): (0, 4000, None, None),
    }
    assert [tuple(w) for w in rows[1, 0].words] == [(0, 1, 1000, 1500), (1, 2, 1500, 3000)] and [tuple(w) for w in rows[1, 7].words] == [(0, 2, 9000, 10000)]
    assert not rows[1, 1].words and not rows[1, 8].words and not rows[1, 4].words and rows[1, 0].id != rows[1, 8].id and len({r.id for r in rows.values()}) == len(rows)
    summary = {r.song_id: (r.lines, r.precision, r.n_invalid, r.n_over, r.n_end) for r in spans.timeline_summary(out).collect()}
    assert summary == {1: (8, "word", 1, 1, 1), 2: (1, "none", 1, 0, 0), 3: (1, "line", 0, 0, 0)}


def plain_segments(text, segments):
    silent = lambda part: all(c.isspace() or c in spans.SILENT or (ord(c) < 128 and not c.isalnum()) for c in part)
    out = sorted(([*s] for s in segments if 0 <= s[0] < s[1] <= len(text)), key=lambda s: s[0])
    for k, s in enumerate(out):
        if k == 0 and silent(text[: s[0]]):
            s[0] = 0
        if k and out[k - 1][1] < s[0] and silent(text[out[k - 1][1] : s[0]]):
            out[k - 1][1] = s[0]
        if k and out[k - 1][3] is not None and out[k - 1][3] > s[2] > out[k - 1][2]:
            out[k - 1][3] = s[2]
    if out and silent(text[out[-1][1] :]):
        out[-1][1] = len(text)
    return [tuple(s) for s in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(80):
        text = "".join(rng.choice("ab、 !夜") for _ in range(rng.randint(0, 12)))
        starts = rng.sample(range(14), rng.randint(0, 4))
        rows.append((k, text, [(s, s + rng.randint(0, 4), rng.choice([1.0, 2.0, 3.0]), rng.choice([None, 1.5, 4.0])) for s in starts]))
    frame = spark.createDataFrame(rows, "k int, text string, s array<struct<start:long,stop:long,time_sec:double,end_sec:double>>")
    got = {r.k: [tuple(s) for s in r.out] for r in frame.select("k", spans.normalized_segments(F.col("text"), F.col("s")).alias("out")).collect()}
    assert got == {k: plain_segments(text, s) for k, text, s in rows}


def test_display_units(spark):
    lines = [(1, "ab", 1.0, 5.0), (2, "ab", 1.0, None), (3, "ab", None, None), (4, "", 1.0, 2.0), (5, "ab", -1.0, None), (6, "ab", 1.0, 1.0), (7, "ab", 1.0, 5.0), (8, "ab", 1.0, 5.0), (9, "ab", 1.0, 5.0), (10, "ab", 1.0, 2.5)]
    unit = [
        (1, 0, 1, 1.0, 2.0, "lrc"), (1, 1, 2, 2.0, 3.0, "lrc"), (1, 1, 2, 2.1, 3.0, "manual"), (1, 0, 2, 1.0, None, "manual"), (1, 0, 2, 0.0, 9.0, "guess"), (2, 0, 1, 1.0, 2.0, "lrc"), (3, 0, 2, 0.0, 2.0, "lrc"), (4, 0, 0, 1.0, 2.0, "lrc"), (5, 0, 2, 1.0, 2.0, "lrc"),
        (6, 0, 2, 1.0, 2.0, "lrc"), (7, 0, 2, 1.0, 2.0, "lrc"), (7, 0, 2, 1.0, 2.5, "lrc"), (8, 0, 1, 1.0, 2.0, "lrc"), (8, 1, 2, 1.5, 3.0, "lrc"), (9, 0, 2, 1.0, None, "lrc"), (10, 0, 2, 1.0, 3.0, "lrc"),
    ]
    got = spans.display_units(spark.createDataFrame(lines, "k int, text string, time_sec double, end_sec double"), spark.createDataFrame(unit, "k int, char_start long, char_end long, start_sec double, end_sec double, source string"), ["k"])
    rows = {r.k: r for r in got.collect()}
    assert {k: r["mode"] for k, r in rows.items()} == {1: "karaoke", 2: "line", 3: "karaoke", 4: "line", 5: "plain", 6: "line", 7: "line", 8: "line", 9: "line", 10: "line"}
    assert [tuple(u) for u in rows[1].units] == [(0, 1, 1.0, 2.0, "lrc"), (1, 2, 2.1, 3.0, "manual")] and rows[2].units is None
