import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from strophe.functions import kana, measures
from strophe.functions import text as X
from strophe.operators import frequency, lexical, library, plays, resolve, rhyme, search, timeline
from strophe.plans import stream
from strophe.sources import lyrics, tabular
from strophe.streaming import listening

LINES = "song_id long, artist string, language string, line_idx long, text string"


@pytest.fixture(scope="module")
def mini(spark):
    rows = [
        (1, "a", "en", 0, "The night is long, the night is cold"),
        (1, "a", "en", 1, "Sing with the wind"),
        (1, "a", "en", 2, "Sing with the wind"),
        (2, "b", "en", 0, "The wind, the wind"),
        (3, "a", "en", 0, "100% of_it"),
    ]
    return spark.createDataFrame(rows, LINES).cache()


def test_stream_marks_gaps_and_repeats(mini):
    rows = stream.stream(mini).orderBy("song_id", "line_idx", "idx").collect()
    first = [r for r in rows if (r.song_id, r.line_idx) == (1, 0)]
    assert [r.lemma for r in first] == "the night is long the night is cold".split() and [r.gap_before for r in first] == [False] * 4 + [True] + [False] * 3
    assert {r.line_idx for r in rows if r.song_id == 1 and r.repeat} == {2}
    assert [r.pos for r in rows if r.song_id == 3] == ["NUM", "ADP", "ADP"]


def test_frequency_units(mini):
    t = stream.stream(mini)
    raw = {r.lemma: r for r in frequency.frequency(t).collect()}
    once = {r.lemma: r for r in frequency.frequency(t, "distinct_lines").collect()}
    assert (raw["wind"].freq, once["wind"].freq, raw["wind"].songs) == (4, 3, 2) and raw["wind"].repeat_share == 0.25
    assert raw["the"].surfaces == "the The"


def test_ngrams_stop_at_marks(mini):
    words = {r.words: r.freq for r in frequency.ngrams(stream.stream(mini), 2, min_freq=1, min_songs=1).collect()}
    assert words["the wind"] == 4 and "long the" not in words and "wind the" not in words


def plain_dispersion(seq, songs):
    n, sizes = len(seq), {s: songs.count(s) for s in songs}
    out = {}
    for w in set(seq):
        at = [i for i, x in enumerate(seq) if x == w]
        f, v = len(at), n / len(at)
        arf = sum(min(b - a, v) for a, b in zip(at, at[1:] + [at[0] + n], strict=True)) / v
        dp = 0.5 * sum(abs(sum(songs[i] == s for i in at) / f - size / n) for s, size in sizes.items())
        rel = [sum(songs[i] == s for i in at) / size for s, size in sizes.items()]
        mean = sum(rel) / len(rel)
        sd = math.sqrt(sum((x - mean) ** 2 for x in rel) / len(rel))
        out[w] = (f, dp, max(0, 1 - sd / mean / math.sqrt(len(rel) - 1)), arf)
    return out


def test_dispersion_equals_a_loop(spark):
    rng = random.Random(1)
    rows, seq, songs = [], [], []
    for s in sorted(rng.sample(range(0, 400_000), 25)):
        for line in range(rng.randint(1, 4)):
            words = [rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randint(1, 9))]
            rows.append((s, "x", "en", line, " ".join(words)))
            seq += words
            songs += [s] * len(words)
    got = {r.lemma: (r.freq, r.dp, r.juilland_d, r.arf) for r in frequency.dispersion(stream.stream(spark.createDataFrame(rows, LINES)), ["lemma"]).collect()}
    for w, want in plain_dispersion(seq, songs).items():
        assert got[w] == pytest.approx(want)


def test_mattr_and_mtld(spark):
    rows = spark.createDataFrame([(1, "x", "en", 0, "aaaa bbbb aaaa cccc")], LINES)
    of = lambda w: lexical.mattr(stream.stream(rows), w).first().mattr
    assert of(4) == 0.75 and of(5) is None and of(2) == 1.0 and of(3) == pytest.approx(5 / 6)
    assert lexical.mtld_of(["x"] * 10) == 2.0 and lexical.mtld_of([str(k) for k in range(20)]) is None


def test_measures(spark):
    row = spark.range(1).select(measures.chi2_p(F.lit(3.841459)).alias("p"), measures.g2(*[F.lit(float(x)) for x in (10, 20, 30, 40)]).alias("g")).first()
    assert row.p == pytest.approx(0.05, abs=1e-6)
    cells, n = [10, 20, 30, 40], 100
    e = [30 * 40 / n, 30 * 60 / n, 70 * 40 / n, 70 * 60 / n]
    assert row.g == pytest.approx(2 * sum(o * math.log(o / x) for o, x in zip(cells, e, strict=True)))


def test_kwic_of_a_very_long_line(spark):
    text = "  " + "abc, " * 60_000 + "night\tof \u3000 dawn " + "xyz " * 40_000
    rows = spark.createDataFrame([(1, "a", "en", 0, text), (1, "a", "en", 1, " night"), (1, "a", "en", 2, "(night)  ")], LINES)
    hits = search.kwic(rows, ("night",)).orderBy("line_idx").collect()
    assert [r.left + r.keyword + r.right for r in hits] == [text, " night", "(night)  "]
    assert [r.keyword for r in hits][:2] == ["night", "night"] and hits[0].left.endswith("abc, ")


def test_kwic_rebuilds_the_line(mini):
    hits = search.kwic(mini, ("night", "with+the"), cross_line=False).collect()
    texts = {(r.song_id, r.line_idx): r.text for r in mini.collect()}
    assert len(hits) == 4 and all(r.left + r.keyword + r.right == texts[r.song_id, r.line_idx] for r in hits)
    assert {r.keyword for r in hits} == {"night", "with the"}
    assert [r.repeat_count for r in search.kwic(mini, ("wind",), dedup=True).orderBy("song_id").collect()] == [2, 2]


def plain_matches(tokens, items):
    """All ways from each place, the longest taken, from left to right."""

    def ends(at, rest):
        if not rest:
            return {at}
        (holds, least, most), out, k = rest[0], set(), 0
        while True:
            if k >= least:
                out |= ends(at + k, rest[1:])
            if (most is not None and k >= most) or at + k >= len(tokens) or not holds(tokens[at + k]):
                return out
            k += 1

    out, at = [], 0
    while at < len(tokens):
        n = max(ends(at, items), default=at) - at
        if n:
            out.append((at, n))
        at += max(1, n)
    return out


NOUN, ADP = (lambda t: t["pos"] == "NOUN"), (lambda t: t["pos"] == "ADP")
B = lambda t: t["lemma"].startswith("b")  # noqa: E731  of a dict and of a column


@pytest.mark.parametrize(
    "items",
    [
        [(ADP, 1, 1), (NOUN, 1, 1)], [(NOUN, 1, None)], [(B, 1, 1), (ADP, 0, None), (NOUN, 1, 1)], [(NOUN, 2, 2)], [(ADP, 0, 1), (NOUN, 1, 2), (B, 0, 1)], [(ADP, 0, None), (B, 1, 1), (NOUN, 0, 2), (ADP, 1, None)], [(B, 0, 1), (B, 2, 3), (ADP, 0, 3)],
        [(ADP, 0, 2), (B, 1, 2), (ADP, 2, 3), (B, 0, None)], [(ADP, 2, None), (NOUN, 1, 1), (ADP, 0, 1), (B, 1, 1)],
    ],
)
def test_token_patterns_equal_all_ways(spark, items):
    import random

    rng = random.Random(9)
    lines = [(1, "a", k, " ".join(rng.choice(["bab", "ba", "abcd", "bcde", "x", ","]) for _ in range(rng.randint(1, 14)))) for k in range(60)]
    rows = spark.createDataFrame(lines, "song_id long, artist string, line_idx long, text string")
    got = {}
    for r in search.pattern_search(rows, [search.Item(*i) for i in items]).collect():
        got.setdefault(r.line_idx, []).append((r.start, r.length))
    tokens = {r.line_idx: [t.asDict() for t in r.tokens] for r in stream.tokenized(rows).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: m for k, t in tokens.items() if (m := plain_matches(t, items))}


def test_token_patterns_by_words(spark, mini):
    hits = search.pattern_search(mini, [search.word("in"), search.ANY, search.Item(search.like("n.*ht"))]).collect()
    assert {r.matched for r in hits} <= {"in the night", "in night"}
    long = spark.createDataFrame([(1, "a", 0, "go on " * 5_000)], "song_id long, artist string, line_idx long, text string")
    assert search.pattern_search(long, [search.word("go"), search.word("on")]).count() == 5_000
    assert search.pattern_search(mini, [search.word("wind")], dedup=True).count() <= search.pattern_search(mini, [search.word("wind")]).count()


def test_token_patterns_within_one_another(spark):
    rows = spark.createDataFrame([(1, "a", 0, "worthless worthless worthless, night in worthless"), (1, "a", 1, "go in")], "song_id long, artist string, line_idx long, text string")
    places = lambda items, **how: sorted((r.start, r.length, r.matched) for r in search.pattern_search(rows, items, **how).collect())
    two = [search.word("worthless"), search.Item(lambda t: t["pos"] == "NOUN")]
    assert places(two) == [(0, 2, "worthless worthless")]
    assert places(two, overlap=True) == [(0, 2, "worthless worthless"), (1, 2, "worthless worthless")]
    assert places([search.word("worthless", most=None)], overlap=True) == [(0, 3, "worthless worthless worthless"), (1, 2, "worthless worthless"), (2, 1, "worthless"), (6, 1, "worthless")]


@pytest.mark.parametrize("items", [[], [search.ANY], [search.word("a", least=3, most=2)], [search.word("a", least=0)], [search.word("a")] * 11])
def test_bad_token_patterns(mini, items):
    with pytest.raises(ValueError):
        search.pattern_search(mini, items)


def test_full_text_treats_signs_as_they_are(mini):
    assert search.full_text(mini, "100%").count() == 1 and search.full_text(mini, "f_").count() == 1 and search.full_text(mini, "%%%").count() == 0
    assert search.full_text(mini, "WIND").count() == 3


def test_scripts(spark):
    c = X.script_counts(F.lit("君きみキミｷﾐ々ーLove１!"))
    row = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert row.asDict() == {"kanji": 2, "hiragana": 2, "katakana": 5, "latin": 4, "other": 2}
    assert spark.range(1).select(X.is_japanese(F.lit("ー"))).first()[0] is False


def test_kana(spark):
    row = spark.range(1).select(kana.to_katakana(F.lit("きみとx")).alias("k"), kana.to_hiragana(F.lit("キミー")).alias("h")).first()
    assert tuple(row) == ("キミトx", "きみー")
    assert kana.vowels_of("キャット") == ["a", "Q", "o"] and kana.vowels_of("シンー") == ["i", "N", "i"] and kana.vowels_of("x") is None and kana.vowels_of("ネェ") == ["e", "e"]


def test_rhyme_rates(spark):
    rows = [(1, k, f"line {k}", list(v)) for k, v in enumerate(["ao", "eo", "ai", "eo"])]
    out = {r.k: r for r in rhyme.adjacent_rates(spark.createDataFrame(rows, "song_id long, line_idx long, text string, vowels array<string>"), 2).collect()}
    assert (out[1].pairs, out[1].rhymes, out[1].baseline) == (3, 1, 0.5) and out[2].rhymes == 0 and out[2].baseline == pytest.approx(1 / 6)
    lines = spark.createDataFrame(rows, "song_id long, line_idx long, text string, vowels array<string>")
    assert rhyme.pattern(lines, "o").count() == 3 and sum(r.share for r in rhyme.vowel_counts(lines).collect()) == pytest.approx(1)


def test_streaks():
    assert plays.streak([100, 99, 98, 96], 100) == 3 and plays.streak([99, 98, 96], 100) == 2 and plays.streak([98, 97], 100) == 0


def test_line_spans(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, "a"), (1, 1, 1.0, "b"), (1, 2, 0.5, "c"), (1, 3, 3.0, "d"), (1, 4, 60.0, "e")], "song_id long, line_idx long, time_sec double, text string")
    durations = spark.createDataFrame([(1, 62.0)], "song_id long, duration_sec double")
    got = [(r.end_sec, r.kind) for r in timeline.line_spans(rows, durations).orderBy("line_idx").collect()]
    assert got == [(3.0, "next_line"), (3.0, "next_line"), (3.0, "next_line"), (8.0, "estimated"), (62.0, "track_end")]
    loops = timeline.loop_regions(timeline.line_spans(rows), spark.createDataFrame([(1, 0, -50.0, -50.0)], "song_id long, line_idx long, start_delta double, end_delta double")).orderBy("line_idx").first()
    assert (loops.start_sec, loops.end_sec) == (0.0, 0.3)


def test_line_issues_look_at_the_latest_time(spark):
    rows = spark.createDataFrame([(1, 0, 10.0, "a"), (1, 1, 5.0, "b"), (1, 2, 8.0, "c"), (1, 3, 10.0, "a"), (1, 4, None, "[00:01.0]x"), (1, 5, 50.0, "y" * 90)], "song_id long, line_idx long, time_sec double, text string")
    got = [(r.issues, r.confidence) for r in timeline.line_issues(rows).orderBy("line_idx").collect()]
    assert got == [("", 0.8), ("non_monotonic", 0.2), ("non_monotonic", 0.2), ("stacked_duplicate", 0.5), ("leftover_markup", None), ("very_long_line,long_gap", 0.7)]


def test_translations_align(spark):
    lines = spark.createDataFrame([(1, 0, 1.0, "a"), (1, 1, 2.0, "b")], "song_id long, line_idx long, time_sec double, text string")
    good = spark.createDataFrame([(1, 1.02, "A"), (1, 1.99, "B")], "song_id long, time_sec double, translation string")
    assert [(r.line_idx, r.translation) for r in timeline.align_translations(lines, good).orderBy("line_idx").collect()] == [(0, "A"), (1, "B")]
    assert timeline.align_translations(lines, good.withColumn("time_sec", F.col("time_sec") + 0.5)).count() == 0


def test_collaboration(spark):
    credits = spark.createDataFrame([(1, 1, "performer", 0), (1, 1, "composer", 0), (1, 2, "composer", 1), (2, 3, "performer", 0)], "song_id long, person_id long, role string, position long")
    assert [tuple(r) for r in library.collaboration_edges(credits).collect()] == [(1, 2, 1)]
    assert {(r.person_id, r.steps) for r in library.ego_graph(library.collaboration_edges(credits), 1).collect()} == {(1, 0), (2, 1)}


def test_lrc(spark):
    text = "[ti:x]\n[offset:500]\n作詞：who\n[00:10.00][00:30.00]chorus\n[00:05.50]first <00:06.00>word\nplain"
    got = [(r.time_sec, r.text) for r in lyrics.lrc_lines(spark.createDataFrame([(1, text)], "song_id long, text string")).orderBy("line_idx").collect()]
    assert got == [(5.0, "first word"), (9.5, "chorus"), (29.5, "chorus"), (None, "plain")]


def test_srt_words_and_formats(spark):
    srt = "1\n00:00:01,500 --> 00:00:02,000\n<i>Hi</i>\n\n2\n00:01:00,000 --> 00:01:01,250\nthere\n"
    got = [(r.time_sec, r.end_sec, r.text) for r in lyrics.srt_lines(spark.createDataFrame([(1, srt)], "song_id long, text string")).orderBy("line_idx").collect()]
    assert got == [(1.5, 2.0, "Hi"), (60.0, 61.25, "there")]
    words = lyrics.word_timings(spark.createDataFrame([(1, "[100,900]he(100,300)llo(400,600)")], "song_id long, text string")).collect()
    assert [(r.word, r.start_ms, r.end_ms) for r in words] == [("he", 100, 400), ("llo", 400, 1000)]
    kinds = spark.createDataFrame([(srt,), ("[00:01.00]a",), ("<tt xml>",), ("[1,2]a(1,2)",), ("x",)], "t string").select(lyrics.format_of(F.col("t"))).collect()
    assert [r[0] for r in kinds] == ["srt", "lrc", "ttml", "word_timed", "text"]
    raw = spark.createDataFrame([("夜".encode("cp932"),), ("夜".encode(),), ("夜".encode("utf-16"),), (None,)], "b binary").select(lyrics.decoded("b")).collect()
    assert [r[0] for r in raw] == ["夜", "夜", "夜", None]


def test_tables_in_and_out(spark, tmp_path):
    songs = spark.createDataFrame([("1", "a, \"b\"", "x", "2000", "", "", "p")], tabular.SONGS)
    songs.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "s"))
    back = tabular.read_songs(spark, str(tmp_path / "s"))
    assert back.first().title == 'a, "b"'
    assert sorted(r.title for r in tabular.upsert(back, songs.withColumn("title", F.lit("new"))).collect()) == ["new"]
    notes = spark.createDataFrame([(1, "word\x1fback"), (2, "word\x1fother")], "id long, flds string")
    out = tabular.learning(notes, spark.createDataFrame([(1, 3)], "nid long, reps long")).first()
    assert (out.notes, out.cards, out.studied) == (2, 1, True)


def test_dictionary(spark):
    banks = spark.createDataFrame([('[["食べる","たべる","v","v1",5,["eat"],1,""],["たべる","","","",1,["x"],2,""]]',)], "value string")
    terms = tabular.dictionary_terms(banks)
    words = spark.createDataFrame([("食べました",), ("たべる",)], "word string").withColumn("forms", tabular.base_forms(F.col("word")))
    got = {(r.word, r.term, r.nth) for r in tabular.dictionary_lookup(words, terms).collect()}
    assert got == {("食べました", "食べる", 1), ("たべる", "たべる", 1), ("たべる", "食べる", 2)}


def test_matching(spark):
    tracks = spark.createDataFrame([(1, "Night Song", "A", 200.0, "k")], "id long, title string, artist string, duration_sec double, k string")
    found = spark.createDataFrame([(7, "Night Song (Live)", "A", 201.0, "k"), (8, "Other", "B", 100.0, "k")], tracks.schema)
    got = {r.c_id: (r.decision, r.rank) for r in resolve.score_pairs(tracks, found, "k").collect()}
    assert got[7] == ("accept", 1) and got[8][0] == "fail"
    roots = spark.createDataFrame([("/m",), ("/m/a",)], "root string")
    assert resolve.longest_prefix(spark.createDataFrame([("/m/a/x.mp3",)], "path string"), roots).first().root == "/m/a"
    assert [tuple(r) for r in resolve.relinks(spark.createDataFrame([(1, "x"), (2, "y")], "id long, k string"), spark.createDataFrame([(5, "x"), (6, "y"), (7, "y")], "id long, k string"), "k").collect()] == [(1, 5)]


def test_corrections(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b")], "song_id long, line_idx long, token_idx long, surface string")
    fixes = spark.createDataFrame([(1, 1, 1, [("old",)]), (1, 1, 2, [("new",), ("er",)])], "song_id long, line_idx long, saved long, tokens array<struct<surface:string>>")
    assert sorted((r.line_idx, r.token_idx, r.surface) for r in resolve.apply_corrections(tokens, fixes).collect()) == [(0, 0, "a"), (1, 0, "new"), (1, 1, "er")]


SAMPLES = "user_id long, at timestamp, song_id long, state string, position_sec double, duration_sec double"


def samples(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(20):  # 19 s of song 1, to its end
        rows.append((1, t0 + dt.timedelta(seconds=k), 1, "playing", float(k), 20.0))
    for k in range(3):  # too short
        rows.append((1, t0 + dt.timedelta(seconds=30 + k), 2, "playing", float(k), 200.0))
    for k in [0, 1, 2, 3, 4, 5, 6, 60, 61]:  # a gap of 54 s does not count
        rows.append((1, t0 + dt.timedelta(seconds=100 + k), 3, "playing", float(k), 200.0))
    rows.append((1, t0 + dt.timedelta(seconds=170), 3, "ended", 61.0, 200.0))
    return spark.createDataFrame(rows, SAMPLES)


def test_plays_of_samples(spark):
    got = [(r.song_id, r.listened_sec, r.completed) for r in listening.plays_of(samples(spark)).orderBy("started").collect()]
    assert got == [(1, 19.0, True), (3, 7.0, False)]


def test_plays_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    samples(spark).coalesce(1).write.parquet(path)
    stream_ = spark.readStream.schema(SAMPLES).parquet(path)
    query = listening.track(stream_).writeStream.format("memory").queryName("plays_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.song_id, r.listened_sec, r.completed) for r in spark.table("plays_out").orderBy("started").collect()]
    assert got == [(1, 19.0, True), (3, 7.0, False)]


def test_corpus_object(spark, sf_dir):
    from strophe.corpus import Corpus
    from strophe.plans.scope import Subcorpus
    from strophe.sources import tables

    corpus = Corpus.at(spark, sf_dir)
    english = corpus.within(Subcorpus(languages=("en",)))
    assert 0 < english.lines.count() < corpus.lines.count() and english.keyness(corpus.within(Subcorpus(languages=("fr",))), limit=5).count() == 10
    assert corpus.without(tables.removed_songs(spark, sf_dir)).songs.count() < corpus.songs.count()
    assert corpus.kwic("the", limit=3).count() == 3 and corpus.overview().count() == 1


def test_archived_runs_repeat(spark, sf_dir):
    from strophe.corpus import Corpus
    from strophe.operators import runs

    corpus = Corpus.at(spark, sf_dir)
    made = [runs.archive(corpus.frequency(limit=20).orderBy("lemma", "pos"), "frequency", {"limit": 20}, "everything", corpus.snapshot()).first() for _ in range(2)]
    assert made[0].run_id == made[1].run_id and made[0].result_hash == made[1].result_hash


def test_token_table_is_written_once_and_again_when_documents_change(spark, tmp_path):
    from strophe.plans import stream
    from strophe.sources import tables, token_table

    def write(texts):
        rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return sorted(map(tuple, token_table.token_table(spark, str(tmp_path)).collect()))

    first = write(["one two, three\none two, three", None, ""])
    assert first == sorted(map(tuple, stream.stream(tables.lines(spark, str(tmp_path))).collect())) and len(first) == 6
    known = len(token_table._WRITTEN)
    assert len(token_table.token_table(spark, str(tmp_path)).collect()) == 6 and len(token_table._WRITTEN) == known
    assert len(write(["four"])) == 1 and write([]) == []


def test_next_later_line_equals_a_plain_walk(spark):
    rng = random.Random(12)
    rows = [(s, k * 2, float(t), "x") for s in range(6) for k, t in enumerate([rng.randrange(400) if s < 4 else 400 - j // 3 for j in range(300)])]
    got = {(r.song_id, r.line_idx): r._end for r in timeline.next_later(spark.createDataFrame(rows, "song_id int, line_idx int, time_sec double, text string")).collect()}
    for s in range(6):
        lines = [r for r in rows if r[0] == s]
        for k, r in enumerate(lines):
            assert got[s, r[1]] == next((x[2] for x in lines[k + 1 :] if x[2] > r[2]), None)


def test_lines_move_before_they_are_taken_apart(spark):
    lines = spark.createDataFrame([(1, 0, "a-b c"), (1, 1, "a-b c"), (1, 2, " "), (1, 3, "...")], "song_id long, line_idx long, text string")
    out = stream.stream(lines)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.index("Window") :]
    assert [tuple(r) for r in out.orderBy("line_idx", "idx").select("line_idx", "idx", "token_idx", "surface", "repeat", "gap_before").collect()] == [
        (n, i, t, s, n == 1, g) for n in (0, 1) for i, t, s, g in ((0, 0, "a", False), (1, 2, "b", True), (2, 3, "c", False))
    ]


def test_token_table_keeps_songs_whole(spark, sf_dir):
    from strophe.sources import token_table

    files = token_table.token_table(spark, sf_dir).select("song_id", F.col("_metadata.file_path").alias("f")).distinct()
    assert files.groupBy("song_id").count().where("count > 1").isEmpty() and files.select("f").distinct().count() > 1


def test_stream_of_signs_and_other_scripts(spark):
    from strophe.plans import scope

    lines = spark.createDataFrame([(1, "s", "x", 0, "Aé1, 12 -- 猫 is, 😀  x"), (1, "s", "x", 1, " ... "), (1, "s", "x", 2, "Aé1, 12 -- 猫 is, 😀  x")], "song_id long, artist string, language string, line_idx long, text string")
    rows = [(r.line_idx, r.idx, r.token_idx, r.surface, r.lemma, r.pos, r.repeat, r.gap_before) for r in stream.stream(lines).orderBy("line_idx", "idx").collect()]
    one = [(0, 0, "Aé1", "aé1", "ADP", False), (1, 2, "12", "12", "NUM", True), (2, 5, "猫", "猫", "ADP", True), (3, 6, "is", "is", "ADP", False), (4, 10, "x", "x", "ADP", True)]
    assert rows == [(n, *r[:5], n == 2, r[5]) for n in (0, 2) for r in one]
    jp = stream.stream(lines, scope.Scope(jp_only=True)).where("line_idx = 0").collect()
    assert [(r.idx, r.token_idx, r.surface, r.gap_before) for r in jp] == [(0, 5, "猫", False)]


@pytest.mark.parametrize("most", [0, 200_000])
def test_known_passages_whether_they_are_broadcast_or_not(spark, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_ROWS", most)
    lines = spark.createDataFrame([(1, "A b c d e"), (1, "x a b, c D"), (2, "b c d"), (3, "a b"), (4, None)], "song_id long, text string")
    passages = spark.createDataFrame([(7, "a b c d"), (8, "c d e f; b c d"), (9, "q")], "item_id long, text string")
    out = search.known_passages(lines, passages, 3)
    assert sorted(map(tuple, out.collect())) == [(1, 7, 2), (1, 8, 2), (2, 7, 1), (2, 8, 1)]
    # few passages: lines' sequences are looked up before they move
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()) == (most > 0)


def test_counts_within_songs_and_lines_move_no_tokens(spark, sf_dir):
    from pyspark.sql import Window

    from strophe.sources import token_table

    tokens = token_table.token_table(spark, sf_dir)
    for rows in (tokens.groupBy("lemma", "song_id").count(), tokens.withColumn("next", F.lead("lemma").over(Window.partitionBy("song_id", "line_idx").orderBy("idx")))):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
