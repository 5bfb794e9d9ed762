import numpy as np
import pytest

from strophe.llm import chat, topk

SCHEMA = "vec_id long, embedding array<float>, label int, row string, q string"


def brute(rows, k=5, every=50):
    ok = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=12) * rng.choice([0.02, 0.3, 2.0])]) for k in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (None, [1.0] * 12), (403, []), (404, [float("inf")] * 12), (405, [3.0, 1.0]), (150, [0.5] * 12), (150, [0.5] * 12)]
    rows += [(k, rows[7][1]) for k in range(500, 540)]
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    for size in (64, 100_000):
        monkeypatch.setattr(topk, "CANDIDATES", size)
        monkeypatch.setattr(topk, "QUERIES", 4)
        got = sorted(tuple(r) for r in topk.top_k(frame, frame.vec_id % 50 == 0).collect())
        assert got == brute(rows)


def test_top_k_refuses_what_overflows(spark):
    frame = spark.createDataFrame([(0, [1e9, 1e9], 1, "x", "y"), (1, [1e9, 1e9], 1, "x", "y")], SCHEMA)
    with pytest.raises(OverflowError):
        topk.top_k(frame, frame.vec_id % 50 == 0)


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", "y"), (1, [0.5, 0.5], 1, "x", "y")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(frame, frame.vec_id % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(frame.limit(0), frame.vec_id % 50 == 0).count() == 0


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, c], 7: [(None, None)], 8: [a, b, ("user", "x" * 100_000)]}
    rows = [(k, n, *t, "extra", 9) for k, turns in logs.items() for n, t in enumerate(turns)] + [(None, 0, "user", "alone", "extra", 9), (None, 0, "user", "hi", "extra", 9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, n_turns long")
    got = {(r.conv_id, r.n_turns): r.text for r in chat.render(frame).collect()}
    assert set(got) == {(3, 3), (5, 1), (6, 2), (7, 1), (8, 3), (None, 1)}
    assert got[6, 2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n" and got[7, 1] == "<|im_start|>\n<|im_end|>\n"
    assert got[None, 1] == "<|im_start|>user\nalone<|im_end|>\n"
    assert chat.render(frame.limit(0)).count() == 0
