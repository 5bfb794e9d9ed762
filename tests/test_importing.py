import random

import pytest

from strophe.operators import importing

FILE = "place long, path string, title string, artist string, album string, isrc string, mbid string, duration_sec double, size long, mtime double, unsupported string"
SONG = "id long, path string, title string, artist string, album string, isrc string, mbid string, duration_sec double, size long, mtime double"


def plain_plan(files, songs):
    """One file after another."""
    norm = lambda t: (t or "").lower().replace(" ", "")
    ident = lambda r: (norm(r["artist"]), norm(r["title"])) if norm(r["artist"]) and norm(r["title"]) else None
    code = lambda r, f: "".join(c for c in (r[f] or "").upper() if c.isalnum())

    def differ(a, b):
        for f, why in (("isrc", "code"), ("mbid", "recording")):
            if code(a, f) and code(b, f) and code(a, f) != code(b, f):
                return why
        if norm(a["album"]) != norm(b["album"]):
            return "version"
        x, y = a["duration_sec"], b["duration_sec"]
        return "duration" if x and y and x > 0 and y > 0 and abs(x - y) > 3 else None

    out, new = {}, []
    for f in sorted(files, key=lambda r: r["place"]):
        at = [s for s in songs if s["path"] and s["path"] == f["path"]]
        same = next((s for s in songs if code(f, "isrc") and code(s, "isrc") == code(f, "isrc")), None) or next((s for s in songs if code(f, "mbid") and code(s, "mbid") == code(f, "mbid")), None)
        known = [s for s in songs if ident(f) and ident(s) == ident(f)]
        if at:
            s = at[-1]
            stamp = s["size"] == f["size"] and s["mtime"] is not None and f["mtime"] is not None and abs(s["mtime"] - f["mtime"]) < 2
            out[f["place"]] = ("have", s["id"], "unrecorded" if s["size"] is None else "unchanged" if stamp or f["size"] is None else "changed", None)
        elif f["unsupported"] or not (f["title"] or "").strip():
            out[f["place"]] = ("skip", None, f["unsupported"] or "no title", None)
        elif any(n["path"] == f["path"] for n in new):
            out[f["place"]] = ("batch", None, None, f["path"])
        elif same:
            out[f["place"]] = ("duplicate", same["id"], "same code" if code(f, "isrc") and code(same, "isrc") == code(f, "isrc") else "same recording", None)
        elif any(differ(s, f) is None for s in known):
            out[f["place"]] = ("duplicate", next(s["id"] for s in known if differ(s, f) is None), "same version", None)
        elif ident(f) and any(ident(n) == ident(f) and differ(n, f) is None for n in new):
            out[f["place"]] = ("batch", None, None, next(n["path"] for n in new if ident(n) == ident(f) and differ(n, f) is None))
        else:
            new.append(f)
            out[f["place"]] = ("new", known[0]["id"] if known else None, differ(known[0], f) if known else None, None)
    return out


def invented(seed, n, first=0):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [
        {"path": f"/a/{rng.randrange(60)}", "title": pick("Song", "song ", "Other", "Third", None, " "), "artist": pick("A", "B", ""), "album": pick("", "", "Live", "Demo"), "isrc": pick("", "", "", None, f"jp-{rng.randrange(9)}"), "mbid": pick("", "", f"M{rng.randrange(9)}"),
         "duration_sec": pick(None, 0.0, 100.0, 102.0, 104.0, 106.0, 120.0), "size": pick(None, 1, 2), "mtime": pick(None, 5.0, 6.5, 9.0)} for _ in range(n)
    ]


def frames(spark, files, songs):
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in FILE.split(", ")) for f in files], FILE), spark.createDataFrame([tuple(s[c.split()[0]] for c in SONG.split(", ")) for s in songs], SONG)


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_equals_one_file_after_another(spark, seed):
    songs = [s | {"id": k} for k, s in enumerate(invented(seed, 25))]
    files = [f | {"place": k, "unsupported": "codec" if k % 17 == 0 else None, "path": f["path"] if f["path"] in {s["path"] for s in songs} else f"/b/{k}"} for k, f in enumerate(invented(seed + 10, 150))]
    files += [files[1] | {"place": 200}, files[4] | {"place": 201}, files[7] | {"place": 202}]  # files that are found twice
    got = {r.place: (r.action, r.song_id, r.reason, r.first_path) for r in importing.import_plan(*frames(spark, files, songs)).collect()}
    assert got == plain_plan(files, songs)
    assert {a for a, *_ in got.values()} == {"have", "skip", "batch", "duplicate", "new"}


def test_plan_of_nothing(spark):
    f, s = frames(spark, [], [])
    assert importing.import_plan(f, s).count() == 0 and importing.sync_plan(f, s, s.selectExpr("id", "path", "true AS removed")).count() == 0


def test_a_missing_song_is_claimed_once(spark):
    song = {"title": "Song", "artist": "A", "album": "", "isrc": "", "mbid": "", "duration_sec": 100.0, "size": 1, "mtime": 5.0}
    songs = [song | {"id": 1, "path": "/m/1"}, song | {"id": 2, "path": "/m/2", "title": "Gone"}, song | {"id": 3, "path": "/m/3", "title": "Back"}, song | {"id": 4, "path": "/m/4", "title": "Same"}, song | {"id": 5, "path": "/m/5", "title": "Changed"}, song | {"id": 6, "path": "/m/6", "title": "Old", "size": None}]
    files = [{"place": k, "unsupported": None} | song | f for k, f in enumerate([{"path": "/n/2"}, {"path": "/n/1"}, {"path": "/m/3", "title": "Back"}, {"path": "/m/4", "title": "Same"}, {"path": "/m/5", "title": "Changed", "size": 9}, {"path": "/m/6", "title": "Old"}, {"path": "/n/x", "title": "Fresh"}])]
    f, s = frames(spark, files, songs)
    got = sorted((r.bucket, r.path or "", r.song_id or 0, r.from_path or "") for r in importing.sync_plan(f, s, s.selectExpr("id", "path", "id = 3 AS removed")).collect())
    assert got == sorted([("moved", "/n/2", 1, "/m/1"), ("to_review", "/n/1", 1, ""), ("gone", "", 2, "/m/2"), ("returned", "/m/3", 3, ""), ("unchanged", "/m/4", 4, ""), ("changed", "/m/5", 5, ""), ("unrecorded", "/m/6", 6, ""), ("to_review", "/n/x", 0, "")])


def test_watched_folders(spark):
    paths = ["/music/a/x.flac", "/music/a/y.flac", "/music/b/x.flac", "/music/z.flac", "/lone/deep/one/x.flac", "/many/1/x", "/many/2/x", "/gone/x.flac", "/big/in/1/a", "/big/in/2/a", "/big/in/1/sub/a", "x.flac", None]
    there = ["/music", "/music/a", "/music/b", "/music/c", "/lone", "/lone/deep", "/lone/deep/one", "/many", *[f"/many/{k}" for k in range(1, 8)], "/big", "/big/in", "/big/in/1", "/big/in/2", "/big/in/1/sub"]
    frame = lambda v: spark.createDataFrame([(p,) for p in v], "path string")
    got = sorted(map(tuple, importing.watched_folders(frame(paths), frame(there)).collect()))
    # /music has no parent of its own, so its folders stay; two of /many's seven aren't half; /big/in takes its two, which its own depth covers further down
    assert got == sorted([("/music", 1, "audio", 1), ("/music/a", 1, "audio", 2), ("/music/b", 1, "audio", 1), ("/lone/deep/one", 1, "audio", 1), ("/many/1", 1, "audio", 1), ("/many/2", 1, "audio", 1), ("/big/in", 3, "parent", 2)])
    barred = sorted(r.path for r in importing.watched_folders(frame(paths), frame(there), frame(["/big/in", "/many/1"])).collect())
    assert "/big/in" not in barred and "/many/1" not in barred and {"/big/in/1", "/big/in/2", "/big/in/1/sub", "/many/2"} <= set(barred)


def library(spark, rows, shift=0):
    make = spark.createDataFrame
    return {
        "songs": make([(i + shift, t, a, al + shift if al else None, p) for i, t, a, al, p in rows["songs"]], "id long, title string, artist string, album_id long, path string"),
        "albums": make([(i + shift, *r) for i, *r in rows["albums"]], "id long, title string, artist string"),
        "people": make([(i + shift, n) for i, n in rows["people"]], "id long, name string"),
        "lines": make([(i + shift, s + shift, t) for i, s, t in rows["lines"]], "id long, song_id long, text string"),
        "credits": make([(s + shift, p + shift, r) for s, p, r in rows["credits"]], "song_id long, person_id long, role string"),
        "plays": make([(s + shift, n) for s, n in rows["plays"]], "song_id long, seconds long"),
    }


def test_merging_twice_adds_nothing(spark):
    mine = {"songs": [(1, "A", "X", 1, "/a"), (5, "B", "X", None, "/b")], "albums": [(1, "Al", "X")], "people": [(7, "Ann")], "lines": [(3, 1, "la")], "credits": [(1, 7, "composer")], "plays": [(1, 9)]}
    theirs = {
        "songs": [(1, "a", "x", 1, "/other"), (2, "C", "Y", 2, "/c"), (3, "C!", "y", 2, "/c2"), (4, "D", "Y", 1, "/b"), (6, "E", "", 3, "/e"), (100_000, "", "", None, "")], "albums": [(1, "AL", "x"), (2, "New", "Y"), (3, "New", "y"), (9, "unused", "u")],
        "people": [(1, "ANN"), (2, "Ben"), (3, "ben")], "lines": [(1, 1, "no"), (2, 2, "yes"), (9, 6, "yes too")], "credits": [(2, 1, "composer"), (2, 2, "lyricist"), (2, 3, "lyricist"), (1, 2, "composer")], "plays": [(2, 4), (2, 4), (4, 1)],
    }
    once = importing.merge_libraries(library(spark, mine), library(spark, theirs, 1000))
    rows = {k: sorted(map(tuple, v.collect()), key=str) for k, v in once.items()}
    assert rows["songs"] == sorted([(1, "A", "X", 1, "/a"), (5, "B", "X", None, "/b"), (6, "C", "Y", 2, "/c"), (7, "E", "", 2, "/e"), (8, "", "", None, "")], key=str)
    assert rows["albums"] == [(1, "Al", "X"), (2, "New", "Y")] and rows["people"] == [(7, "Ann"), (8, "Ben")]
    assert rows["lines"] == [(3, 1, "la"), (4, 6, "yes"), (5, 7, "yes too")] and rows["plays"] == [(1, 9), (6, 4), (6, 4)]
    assert rows["credits"] == [(1, 7, "composer"), (6, 7, "composer"), (6, 8, "lyricist")]
    named = {k: v for k, v in theirs.items() if k != "songs"} | {"songs": [s for s in theirs["songs"] if s[1] and s[2]]}
    merged = {k: v.checkpoint() for k, v in importing.merge_libraries(library(spark, mine), library(spark, named, 1000)).items()}
    again = importing.merge_libraries(merged, library(spark, named, 1000))
    assert all(sorted(map(str, again[k].collect())) == sorted(map(str, merged[k].collect())) for k in merged)
