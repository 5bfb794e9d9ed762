import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strophe.llm import common, line_dedup, ngram_join, pii, quality, toxicity


def measures(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    tri = list(zip(words, words[1:], words[2:], strict=False))
    n, rep = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            rep |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_measures_equal_brute_force(docs_of, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(k, "".join(rng.choices(["a ", "b ", "c ", "\n", "#", "dé ", "x\ty "], k=rng.randint(0, 90)))) for k in range(100, 200)]
    out = quality.assess(docs_of(rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(out) == len(rows)
    for r in out:
        want = measures(r.text)
        assert tuple(r)[2:7] == want, r.text[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_cascade_order_does_not_change_the_verdict(docs_of, prose):
    rows = [(k, prose(k, 90)) for k in range(20)] + [(k, prose(k, 90).replace(" ", "# ")) for k in range(20, 30)] + [(30, prose(30, 90).upper())]
    docs = docs_of(rows)
    rules = quality.text_rules()
    ordered = quality.cascade_order(docs, rules)
    assert {r.name for r, _, _ in ordered} == {r.name for r in rules}
    assert [p / c for _, c, p in ordered] == sorted((p / c for _, c, p in ordered), reverse=True)
    kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert kept == set(range(20)) == {r.doc_id for r in quality.measure(docs).where(quality.verdict(rules[::-1]).isNull()).collect()} == {r.doc_id for r in quality.keep_good(docs).collect()}
    assert quality.assess(docs.limit(0)).count() == 0


def test_a_long_run_without_blanks_is_read_once(docs_of, prose):
    import time
    docs = docs_of([(1, prose(1, 80) + " " + "0" * 1_000_000), (2, "#" * 1_000_000), (3, "... " * 200_000)])
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols) for r in quality.assess(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1][1] > 1_000_000 and got[2] == (1, 1_000_000, 1_000_000) and got[3] == (200_000, 600_000, 0)


def test_keep_good_keeps_columns_named_like_measures(docs_of, prose):
    docs = docs_of([(1, prose(1, 90)), (2, "short")]).withColumn("n_words", F.lit("mine")).withColumn("n_symbols", F.lit(7))
    assert [(r.doc_id, r.n_words, r.n_symbols) for r in quality.keep_good(docs).collect()] == [(1, "mine", 7)]
    assert quality.keep_good(docs).columns == docs.columns


def closed(links, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = closed(real, {x for e in real for x in e})
    assert {r.node: r.root for r in common.components(frame).collect()} == want
    assert common.components(frame.limit(0)).count() == 0


def grams(text, n=5):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("block", [4, 256])
def test_join_equals_brute_force(docs_of, odd_rows, prose, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    rows = list(odd_rows)
    for group in range(6):
        base = prose(900 + group, 150).split(" ")
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
            rows.append((100 * group + 50 + k, " ".join(words)))
    sets = [grams(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    top = closed(near, range(len(rows)))
    members = {}
    for k, t in top.items():
        members.setdefault(t, []).append(rows[k][0])
    smallest = {t: min((d for d in m if d is not None), default=None) for t, m in members.items()}
    want = sorted((str(rows[k][0]), str(smallest[top[k]]), sum(k in e for e in near)) for k in range(len(rows)))
    docs = docs_of(rows)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.join(docs).collect()) == want
    kept = sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([str(smallest[t]) for t in members if sets[t]] + [str(d) for (d, _), s in zip(rows, sets, strict=True) if not s])


def test_keep_one_keeps_one_row_of_repeated_and_unnamed_rows(docs_of, prose):
    rows = [(None, prose(1)), (None, prose(1)), (3, prose(2)), (3, prose(2)), (3, prose(3)), (2, prose(3)), (4, prose(4)), (None, prose(4)), (None, None), (None, None)]
    got = sorted((str(r.doc_id), r.text or "") for r in ngram_join.keep_one(docs_of(rows)).collect())
    assert got == sorted([("None", prose(1)), ("3", prose(2)), ("2", prose(3)), ("4", prose(4)), ("None", ""), ("None", "")])


def test_join_of_nothing(docs_of):
    assert ngram_join.join(docs_of([])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def norm(line):
    return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def similar_pairs(lines):
    """Pairs of normalised lines by edit similarity alone."""
    texts = sorted(lines)
    split = [x.split() for x in texts]
    return [(texts[i], texts[j]) for i, a in enumerate(split) for j, b in enumerate(split[:i]) if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-9 and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]


def test_line_dedup_equals_brute_force(docs_of, prose, spark):
    rng = random.Random(8)
    lines = [" ".join(prose(k, 40).split()) for k in range(30)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "new" + rng.choice("abcdefghijklmnopqrst") * 3
            line = " ".join(words)
            text.append(line.upper() + "!" if rng.random() < 0.2 else line)
        rows.append((d, "\n".join([*text, "short line", ""])))
    docs = docs_of(rows)
    names = {norm(x) for _, t in rows for x in t.split("\n") if norm(x)}
    assert {r.norm for r in line_dedup.split_lines(docs).collect()} == names
    group, seen, want = closed(similar_pairs(names), names), {}, {}
    for d, t in rows:
        kept = []
        for x in t.split("\n"):
            g = group.get(norm(x))
            if g is None or g not in seen:
                kept.append(x)
            if g is not None:
                seen.setdefault(g, d)
        want[d] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == want


def linked_pairs(docs):
    lines = common.cut(line_dedup.split_lines(docs))
    text = {r.k1: r.norm for r in lines.select("k1", "norm").collect()}
    return [(text[r.a], text[r.b]) for r in line_dedup.linked(lines, line_dedup.frequencies(docs)).collect()], set(text.values())


def test_line_links_are_similar_and_few_are_missed(docs_of, spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(4000)]
    lines = []
    for n in (5, 6, 7, 9, 10, 12, 14, 15, 20, 25, 50, 100):
        for _ in range(25):  # each as far from the other as similar lines can be
            words = rng.choices(vocabulary, k=n)
            changed = list(words)
            for _ in range(n // 5):
                at, how = rng.randrange(len(changed)), rng.random()
                if how < 0.6:
                    changed[at] = rng.choice(vocabulary)
                elif how < 0.8 and len(changed) > 4:
                    del changed[at]
                else:
                    changed.insert(at, rng.choice(vocabulary))
            lines += [words, changed]
    found, names = linked_pairs(docs_of([(k, " ".join(w)) for k, w in enumerate(lines)]))
    similar = {frozenset(p) for p in similar_pairs(names)}
    assert {frozenset(p) for p in found} <= similar and len(similar) > 200
    top = closed(found, names)
    connected = sum(top[a] == top[b] for a, b in similar)
    print([(len(a.split()), len(b.split())) for a, b in similar if top[a] != top[b]])
    assert connected >= 0.98 * len(similar)


def test_changed_long_words_among_short_ones_lose_no_link(docs_of, spark):
    rng = random.Random(22)
    short = "a an the of to in we he it is on at by had have was not and but for my so us no do go me up".split()
    longer = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 9))) for _ in range(4000)]
    for n, changed in ((5, 1), (6, 1), (10, 2), (15, 3)):
        lines = []
        for _ in range(60):
            at = rng.sample(range(n), changed)
            words = [rng.choice(longer) if k in at else rng.choice(short) for k in range(n)]
            lines += [words, [rng.choice(longer) if k in at else w for k, w in enumerate(words)]]
        found, names = linked_pairs(docs_of([(k, " ".join(w)) for k, w in enumerate(lines)]))
        similar = {frozenset(p) for p in similar_pairs(names)}
        top = closed(found, names)
        connected = sum(top[a] == top[b] for a, b in similar)
        print(n, changed, connected / len(similar))
        assert {frozenset(p) for p in found} <= similar and len(similar) >= 50 and connected >= 0.98 * len(similar)


def test_lines_left_out_by_a_block_head_are_compared(docs_of, spark):
    shared = "one two three four five six seven"
    lines = [f"{shared} {' '.join(f'{c}{k}' for k in range(9))}" for c in "abcdef"]
    lines += [x.replace("8", "9") for x in lines]
    found, names = linked_pairs(docs_of(list(enumerate(lines))))
    assert closed(found, names) == closed(similar_pairs(names), names)


def test_long_lines_of_a_common_run_that_have_other_words_are_not_verified(docs_of, spark, monkeypatch):
    rng, met = random.Random(23), []
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(4000)]
    passage = rng.choices(vocabulary, k=40)
    lines = [passage + rng.choices(vocabulary, k=120) for _ in range(12)]
    lines.append([*lines[0][:-9], *lines[1][-9:]])
    plain = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *more: met.append(pairs.distinct().count()) or plain(pairs, *more))
    found, names = linked_pairs(docs_of([(k, " ".join(w)) for k, w in enumerate(lines)]))
    assert {frozenset(p) for p in found} == {frozenset((" ".join(lines[0]), " ".join(lines[-1])))} and sum(met) < 5


def test_hot_lines_are_dealt_once(docs_of, spark, prose):
    line = " ".join(prose(3, 30).split())
    rows = [(k, f"{line}\n{prose(k + 100, 12)}") for k in range(150)] + [(200, line.rsplit(" ", 1)[0] + " other")]
    got = {r.doc_id: r.n_lines_removed for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert got == {k: int(k > 0) for k, _ in rows}


def test_short_and_unspaced_lines_are_deduplicated(spark, tmp_path, docs_of):
    from strophe.llm import queries

    chinese = "今天天气很好我们一起去公园散步吧"
    rows = [(1, "All rights reserved\n\n---\n" + chinese), (2, "all rights reserved.\n\n---\n" + chinese.replace("散", "跑")), (3, "All rights deserved\n你好\n你好"), (4, "你好"), (5, "---\n\n完全不同的另一行文字在这里")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines_removed, r.text) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "\n---"), 3: (1, "All rights deserved\n你好"), 4: (1, ""), 5: (0, rows[4][1])}


def test_line_dedup_odd_rows(docs_of, odd_rows, prose):
    got = line_dedup.dedup_lines(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r.places for r in got} == {"z"} and {r.text for r in got if r.doc_id in (1, 2)} == {None, ""}
    assert [r.text for r in got if r.doc_id == 6] == [""] and [r.text for r in got if r.doc_id == 5] == [prose(5)] * 2
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_frequent_runs_are_counted_over_all_lines(docs_of):
    often = lambda k: "of all that is" if k % 40 == 0 else "on a very good" if k % 500 == 0 else f"u{k} v{k} w{k} x{k}"
    docs = docs_of([(k, f"{often(k + 1)} y{k} z{k} q{k}") for k in range(12_000)])
    rare = int(line_dedup.RARE_SHARE * 12_000)
    counts = line_dedup.with_runs(line_dedup.split_lines(docs)).select(F.explode("runs").alias("x")).groupBy("x").count().where(F.col("count") > rare).collect()
    table = line_dedup.frequencies(docs)
    assert {r["count"] for r in counts} == {300} and {r["x"] % line_dedup.TABLE: (300 // rare).bit_length() for r in counts} == {k: n for k, n in enumerate(table) if n}


def test_simhash_by_definition(docs_of, prose):
    docs = docs_of([(1, prose(3, 64)), (2, prose(4, 400).replace("\n", " ")), (3, "of it to be or no")])
    rows = line_dedup.split_lines(docs).select("k1", F.split("norm", " ").alias("w"))
    got = {r.k1: r.h for r in line_dedup.simhash(rows).collect()}
    hashes = {}
    for r in rows.select("k1", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("x")).collect():
        hashes[r.k1] = [x for w, x in zip(r.w, r.x, strict=True) for _ in range(line_dedup.LONG if len(w) > 3 else 1)]
    assert {k: h & (2**64 - 1) for k, h in got.items()} == {k: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in xs) > len(xs)) for k, xs in hashes.items()}


def test_words_are_told_apart_in_verification(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"], 1), (["a", "b"], ["b", "a"], 1), (["a"] * 5, ["a"] * 7, 1), ([], ["a"], 1)], "a array<string>, b array<string>, m int")
    assert [r[0] for r in frame.select(line_dedup.within("a", "b", F.col("m"))).collect()] == [True, False, False, True]


def plain_spans(text):
    """The contract's patterns, word for word."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "@", ".", "@b.c", "1", "25", "4539578763621486", "1.2.3.4", "+1 (", ")", " ", "-", "é", "x@y", "256."], k=rng.randint(0, 30)))
        got = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
        assert sorted(got) == sorted(plain_spans(text)), text


def test_pii_digest(docs_of, odd_rows):
    rows = odd_rows + [(k, f"token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" mail me{k}@mail.example.com or call +1 (212) 555-{1000 + k}. ip 10.0.0.{k}") for k in range(50, 90)] + [(90, "version 1.2.3.4 " * 20)]
    docs = docs_of(rows)
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        base = plain_spans(texts[0] or "")
        order = [f"{k}:{a}:{b}" for kind in pii.KINDS for k, a, b in sorted(base, key=lambda s: s[1]) if k == kind]
        assert r.base_sha256 == hashlib.sha256(",".join(order).encode()).hexdigest() and set(order) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS[:4]]
        if r.doc_id and 50 <= r.doc_id < 90:
            assert "secret:" in r.spans
    done = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert done[60] == 'token = "<secret>" mail <email> or call <phone>. ip <ip>' and done[1] is None and done[2] == ""
    assert pii.digest(pii.find(docs_of([]))).count() == 0 and pii.redact(docs_of([])).count() == 0


def test_loose_spans_of_any_length_and_overlap():
    long = "aZ9" * 200
    assert pii.loose_spans(f"key {long} end", []) == [(4, 4, 604)]
    assert pii.loose_spans("a" * 99 + " at host.com", []) == [(0, 0, 111)]
    span = lambda k, a, b, base: {"kind": k, "start": a, "end": b, "base": base}
    first, second, third = span(3, 0, 9, False), span(4, 5, 30, False), span(2, 30, 40, True)
    assert pii.apart([third, second, first]) == [third, first] and pii.apart([third, second]) == [third, second]
    assert not pii.loose_spans(f"{long}===x" + "-" * 50_000 + "é" + "_" * 50_000, [(4, 0, 603)])


def test_estimate_finds_the_good_labeler():
    rng = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = lambda p: "+" if (rng.random() < p) == truth else "-"
        counts[0, vote(0.95) + vote(0.9) + vote(0.55)] += 1
    table = pii.estimate(counts).reliability[0]
    assert table[0]["+"][1] > 0.85 and table[0]["+"][0] < 0.15 and abs(table[2]["+"][1] - table[2]["+"][0]) < 0.25


def test_fold():
    assert toxicity.fold("Іdi0t, 1D10T!  ЅСUМ") == " idiot idiot scum " and toxicity.fold("") == "  "
    assert toxicity.fold("in 2024 a 12345678abc") == " in 2024 a 12345678abc "


def test_toxicity_counts_do_not_depend_on_partitions(docs_of, prose):
    rows = [(k, prose(k % 30) + (" Rottenword" if k % 3 else "")) for k in range(90)] + [(None, None), (None, "")]
    texts = docs_of(rows).select("text", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)).alias("toxic"))
    of = lambda folded: set(folded.split())
    one, many = (sorted(map(tuple, toxicity._counted(toxicity.distinct_texts(texts.repartition(n)), of, 1).collect())) for n in (1, 13))
    assert one == many and sum(one[0][1:]) == len({toxicity.fold(t or "") for _, t in rows})


def test_toxicity(docs_of, prose, spark):
    bad = ["rottenword", "vilething", "nastyname"]
    rows, labels = [], []
    for k in range(400):
        text, toxic = prose(k, 60), k % 4 == 0
        if toxic:
            text = text.replace("\n", f" {bad[k % 3]} {bad[(k + 1) % 3]}\n")
        rows.append((k, text))
        labels.append((k, 1, int(toxic), "x"))
    rows += [(None, "text"), (1001, None), (1002, ""), (1003, "r0ttenw0rd vіlething " * 3), (1003, "r0ttenw0rd vіlething " * 3), (1004, prose(1, 40_000))]
    labels += [(None, 1, 1, "x"), (5, 1, None, "x"), (7, 1, 0, "x")]
    docs, label_rows = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.score_documents(docs, label_rows).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert all(r.predicted for r in got if r.doc_id == 1003) and not any(r.predicted for r in got if r.doc_id in (1001, 1002, 1004))
    lexicon = toxicity.learn(docs, label_rows, exceptions=("rottenword vilething",))
    assert lexicon.matcher().hits(toxicity.fold("a rottenword vilething b")) == {}
    assert toxicity.score_documents(docs.limit(0), label_rows).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, label_rows.limit(0)).collect()} == {0}


def test_toxicity_of_long_words_and_many_exceptions_takes_linear_time():
    import time

    lexicon = toxicity.Lexicon({" bad": 1.0, " badge": 2.0, " vile ": 1.0}, (" badger ", " vile bad "), (-4.0, 1.0, 1.0, 0.0))
    matcher, began = lexicon.matcher(), time.perf_counter()
    assert toxicity.fold("a1 b " + "x" * 1_000_000).startswith(" ai b xxx")
    assert len(matcher.hits(" " + "badger bad " * 50_000)) == 50_000
    assert time.perf_counter() - began < 5
    # every exception against every hit
    rng = random.Random(4)
    for _ in range(200):
        text = " " + " ".join(rng.choices(["bad", "badger", "vile", "good", "badly"], k=12)) + " "
        plain = toxicity.Lexicon(lexicon.weights).matcher().hits(text)
        spans = [(i, i + len(e)) for e in lexicon.exceptions for i in range(len(text)) if text.startswith(e, i)]
        assert matcher.hits(text) == {s: h for s, h in plain.items() if not any(a <= s and h[0] <= b for a, b in spans)}
    for text in ("b4d sh1t", "a@b", "1234567a", "x $5", "p@$$w0rd 12 a1b2c3d4e5", "\tq1\n"):
        old = re.sub(r"\S*[0-9@$]\S*", lambda m: m[0].translate(toxicity._SIGNS) if any(c.isalpha() for c in m[0]) and sum(c.isdigit() for c in m[0]) <= 4 else m[0], text)
        assert toxicity.fold(text) == " " + " ".join(old.replace("@", " ").replace("$", " ").split()) + " "
