import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import history

LOG = "band long, member long, at long, id long, action string, source string, part string"


def entries(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.randrange(5), rng.randrange(40), k, "reject" if rng.random() < 0.15 else "put", rng.choice([*history.SOURCES, "other", None]), f"p{k}") for k in range(n)]


def plain(rows):
    """One entry after another: what holds and what became of each."""
    state, out = {}, {}
    rank = lambda r: 2 if r[4] == "reject" else history.SOURCES.index(r[5]) if r[5] in history.SOURCES else 0
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        held = state.get(r[:2])
        if held and r[4] == "put" and held[4] == "reject" and r[5] != "manual":
            out[r[3]] = "rejected"
        elif held and r[4] == "put" and held[4] == "put" and rank(held) > rank(r):
            out[r[3]] = "kept"
        else:
            state[r[:2]], out[r[3]] = r, "updated" if held else "inserted"
    return state, out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_entries_equal_one_after_another(spark, seed):
    rows = entries(seed)
    frame = spark.createDataFrame(rows, LOG)
    state, out = plain(rows)
    assert {r.id: r.outcome for r in history.put_outcomes(frame, ["band", "member"]).collect()} == out
    assert sorted(map(tuple, history.holding(frame, ["band", "member"]).collect()), key=str) == sorted(state.values(), key=str)
    assert {r.id for r in history.members(frame, ["band", "member"]).collect()} == {r[3] for r in state.values() if r[4] == "put"}


def test_upsert_by_batches_and_by_a_stream_equals_all_at_once(spark, tmp_path):
    rows = entries(7)
    state, _ = plain(rows)
    want = sorted(state.values(), key=str)
    read = lambda p: sorted(map(tuple, spark.read.schema(LOG).parquet(str(p)).drop("bucket").collect()), key=str)
    parts = [spark.createDataFrame(rows[k : k + 100], LOG) for k in (0, 100, 200)]
    for part in (parts[2], parts[0], parts[0], parts[1]):  # in any order, one of them twice
        history.upsert(spark, str(tmp_path / "batch"), part, ["band", "member"], 8)
    assert read(tmp_path / "batch") == want
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(lambda df, _: history.upsert(df.sparkSession, str(tmp_path / "stream"), df, ["band", "member"], 8)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert query.exception() is None and read(tmp_path / "stream") == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "batch").rglob("*.parquet")}
    history.upsert(spark, str(tmp_path / "batch"), spark.createDataFrame([(0, 0, 99, 999, "reject", "manual", "x")], LOG), ["band", "member"], 8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "batch").rglob("*.parquet")}
    assert len({p.parent for p in before.keys() ^ after.keys()}) == 1  # one bucket was written
    assert (0, 0, 99, 999, "reject", "manual", "x") in read(tmp_path / "batch")


def test_versions_and_as_of(spark):
    log = spark.createDataFrame([(1, 10, 1, "a", "x"), (1, 20, 2, "a", "y"), (1, 20, 3, "b", "z"), (2, 15, 4, None, "x")], "song_id int, at int, id int, content string, source string")
    out = history.version_history(log)
    rows = {(r.song_id, r.version_no): (r.valid_from, r.valid_to, r.kind, r.changed, r.is_current) for r in out.collect()}
    assert rows == {(1, 1): (10, 20, "attached", None, False), (1, 2): (20, 20, "replaced", False, False), (1, 3): (20, None, "replaced", True, True), (2, 1): (15, None, "attached", None, True)}
    at = lambda t: {(r.song_id, r.version_no) for r in history.as_of(out, F.lit(t)).collect()}
    assert at(5) == set() and at(10) == {(1, 1)} and at(19) == {(1, 1), (2, 1)} and at(20) == {(1, 3), (2, 1)}


def test_provenance(spark):
    facts = spark.createDataFrame([("song", 1, "title", "tag", 0.5, 1, 1), ("song", 1, "title", "user", 1.0, 2, 2), ("song", 1, "year", "tag", None, 1, 3)], "entity_type string, entity_id int, field string, source string, confidence double, at int, id int")
    assert {(r.field, r.source, r.at) for r in history.provenance(facts).collect()} == {("title", "user", 2), ("year", "tag", 1)}


def test_corrections(spark):
    schema = "line_id int, at int, id int, action string, tokens array<string>, text string, artist string, title string"
    log = spark.createDataFrame(
        [(1, 1, 1, "save", ["a"], "one", "A", "T"), (1, 2, 2, "save", ["b"], "one", "A", "T"), (2, 1, 3, "save", ["c"], " ｔｗｏ", "A", "T"), (3, 1, 4, "save", ["d"], "x", "A", "T"), (3, 3, 5, "revert", None, "x", "A", "T"), (4, 1, 6, "save", [], "y", "A", "T"), (5, 1, 7, "save", ["e"], "one", "A", "T")], schema)
    now = history.corrections_as_of(log)
    assert {r.line_id: r.tokens for r in now.collect()} == {1: ["b"], 2: ["c"], 5: ["e"]}
    assert {r.line_id: r.tokens for r in history.corrections_as_of(log, F.lit(1)).collect()} == {1: ["a"], 2: ["c"], 3: ["d"], 5: ["e"]}
    lines = spark.createDataFrame([(10, 0, "one", "A", "T"), (11, 1, "two", "A", "T"), (12, 2, "one", "A", "T"), (13, 3, "one", "B", "T"), (14, 4, "three", "A", "T"), (5, 9, "one", "A", "T")], "line_id int, line_idx int, text string, artist string, title string")
    got = {r.line_id: (r.tokens, r.old_line_id, r.moved) for r in history.restored(now, lines).collect()}
    # of two corrections of one text the last line's; all lines take it, the first keeps it; its own line is left as it is
    assert got == {10: (["e"], 5, True), 12: (["e"], 5, False), 11: (["c"], 2, True)}
