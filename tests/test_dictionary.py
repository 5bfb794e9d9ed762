import itertools

import pytest
from pyspark.sql import functions as F

from strophe.functions import inflection, kana
from strophe.operators import dictionary


def plain_forms(word, rules):
    """Breadth first, one word at a time."""
    out, k = [(word, 0, ())], 0
    while k < len(out):
        form, conditions, trace = out[k]
        for r in rules:
            hit = form == r.inflected if r.whole else form.endswith(r.inflected)
            if hit and (conditions == 0 or conditions & r.conditions_in) and (r.place, form) not in trace:
                out.append((form[: len(form) - len(r.inflected)] + r.deinflected, r.conditions_out, ((r.place, form), *trace)))
        k += 1
    return out


WORDS = ["食べました", "打ち込んでいませんでした", "行かなかった", "甘えてる", "書かせられたくなかった", "来られる", "赤くなかった", "して", "ない", "x", "泳いでしまいました"]


@pytest.mark.parametrize("language", ["japanese", "english"])
def test_forms_equal_a_plain_walk(spark, language):
    rules = getattr(inflection, f"{language}_rules")(spark)
    words = WORDS if language == "japanese" else ["walkingly", "nationables", "runnesses", "ed", "butterier", "s", "wholly", "able", "nationablers"]
    rows = dictionary.deinflected(spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "word string"), rules).collect()
    table = sorted(rules.collect(), key=lambda r: r.place)
    for w in words:
        got = sorted((r for r in rows if r.word == w), key=lambda r: r.place)
        assert [(r.form, r.conditions, tuple((s.place, s.text) for s in r.trace)) for r in got] == plain_forms(w, table)
        assert [r.place for r in got] == list(range(len(got)))
    assert max(len(r.trace) for r in rows) >= 3 and {r.word for r in rows} == set(words)


def test_known_chains(spark):
    rows = dictionary.deinflected(spark.createDataFrame([(w,) for w in WORDS], "word string"), inflection.japanese_rules(spark)).select("word", "form", dictionary.rule_names(F.col("trace")).alias("rules")).collect()
    found = {(r.word, r.form): r.rules for r in rows}
    assert found["食べました", "食べる"] == ["-ます", "-た"]
    assert found["打ち込んでいませんでした", "打ち込む"] == ["-て", "-いる", "-ます", "negative past"]
    assert found["行かなかった", "行く"] == ["negative", "-た"] and found["書かせられたくなかった", "書く"] == ["causative", "passive", "-たい", "negative", "-た"]
    assert ("来られる", "来る") in found and ("赤くなかった", "赤い") in found and ("泳いでしまいました", "泳ぐ") in found


def test_rules_in_circles_end_and_rules_that_grow_raise(spark):
    words = spark.createDataFrame([("ab",)], "word string")
    circle = inflection.rule_table(spark, [("x", False, "b", "c", "k", "k"), ("y", False, "c", "b", "k", "k")], {"k": ()})
    assert [r.form for r in dictionary.deinflected(words, circle).orderBy("place").collect()] == ["ab", "ac", "ab"]
    grows = inflection.rule_table(spark, [("x", False, "b", "bb", "k", "k")], {"k": ()})
    with pytest.raises(RuntimeError):
        dictionary.deinflected(words, grows, 5)
    with pytest.raises(ValueError):
        inflection.rule_table(spark, [("x", False, "", "b", "k", "k")], {"k": ()})
    assert inflection.condition_flags({"a": (), "v": ("a", "b"), "b": (), "all": ("v", "c"), "c": ()}) == {"a": 1, "b": 2, "c": 4, "v": 3, "all": 7}
    with pytest.raises(ValueError):
        inflection.condition_flags({"a": ("b",), "b": ("a",)})


def test_variants(spark):
    rows = dictionary.variants(spark.createDataFrame([(w,) for w in ["ウツ", "漢字", "ｶﾞｯｺｳ", "tabeta", "すっっごーい", "", None, "ウツ", "がく", "⼈", "㌔", "ーっー"]], "text string")).collect()
    found = {(r.text, r.variant): r.chains for r in rows}
    by = {t: [r.variant for r in sorted((r for r in rows if r.text == t), key=lambda r: r.place)] for t in {r.text for r in rows}}
    assert by["漢字"] == ["漢字"] and by[""] == [""] and found["ウツ", "うつ"] == [["kana"]] and None not in by
    assert by["ｶﾞｯｺｳ"][:2] == ["ｶﾞｯｺｳ", "ガッコウ"] and found["ｶﾞｯｺｳ", "がっこう"] == [["half width", "kana"]]
    assert found["tabeta", "たべた"] == [["alphabet"]] and found["tabeta", "ｔａｂｅｔａ"] == [["width"]]
    assert {"すっごーい", "すごい", "スゴイ"} <= set(by["すっっごーい"]) and found["がく", "がく"] == [["combining"]] and found["⼈", "人"] == [["radicals"]] and found["㌔", "キロ"] == [["compatibility"]]
    assert by["ーっー"][0] == "ーっー" and all(len(set(v)) == len(v) for v in by.values())


def test_romanised_words():
    for said, written in {"kyou": "きょう", "gakkou": "がっこう", "shinbun": "しんぶん", "kon'ya": "こんや", "matcha": "まtちゃ", "ji": "じ", "fune": "ふね", "ｋａ": "か", "KA-": "かー", "日本go": "日本ご"}.items():
        assert kana.hiragana_of(said) == written


TERMS = "id string, term string, reading string, term_conditions long, dictionary int, score double, frequency_order double, content boolean, forms_of array<struct<form:string,rules:array<string>>>"


def test_lookup(spark):
    flags = inflection.condition_flags(inflection.JAPANESE_CONDITIONS)
    terms = spark.createDataFrame(
        [
            ("1", "食べる", "たべる", flags["v1"], 1, 5.0, 0.0, True, []), ("2", "食べる", "たべる", flags["v1"], 2, 1.0, 0.0, True, []), ("3", "食べ", "たべ", 0, 1, 9.0, 0.0, True, []),
            ("4", "食", "しょく", 0, 1, 1.0, 0.0, True, []), ("5", "喰べる", "たべる", flags["v1"], 1, 1.0, 0.0, False, [("食べる", ["old"])]), ("6", "食", "じき", 0, 1, 1.0, 0.0, True, None), ("7", "食べました", "", 0, 3, 0.0, 0.0, True, []), ("8", "食べる", "くえる", flags["v5"], 1, 1.0, 0.0, True, []),
        ], TERMS)
    rules = inflection.japanese_rules(spark)

    def look(text, mode, **more):
        out = dictionary.lookup(spark.createDataFrame([(text,), (text,), ("",), (None,)], "text string"), terms, rules, mode, **more)
        return [(r.term, r.reading, r.original, r.rules, r.ids) for r in out.orderBy("text", "nth").collect()]

    group = look("食べました。", "group")
    assert group[0] == ("食べました", "食べました", "食べました", [[]], ["7"])  # no rule beats two
    assert group[1] == ("食べる", "たべる", "食べました", [["-ます", "-た"]], ["1", "2"])
    assert [g[:3] for g in group[2:]] == [("食べ", "たべ", "食べ"), ("食", "しょく", "食"), ("食", "じき", "食")]
    assert [g[4] for g in look("食べました。", "split")] == [["7"], ["1"], ["2"], ["3"], ["4"], ["6"]] == [g[4] for g in look("食べました。", "simple")]
    assert look("食べました。", "term")[-1][4] == ["4", "6"] and len(look("食べました", "group", limit=2)) == 2
    led = look("喰べた", "group")
    assert led[0] == ("食べる", "たべる", "喰べた", [["-た", "old"]], ["1", "2"]) and led[1][4] == ["8"]  # what a form leads to may be of any class
    assert not look("喰べた", "group", redirects=0)
    # by reading, from a spelling in Latin letters
    assert look("tabeta", "group")[0][:3] == ("食べる", "たべる", "tabeta")
    with pytest.raises(ValueError):
        look("食", "other")


def test_occurrences(spark):
    flags = inflection.condition_flags(inflection.JAPANESE_CONDITIONS)
    lines = [["甘え", "て", "もう", "一", "歩"], ["甘え", "てる", "様"], ["打ち込ん", "で", "い", "ませ", "ん", "でし", "た"], ["今夜", "は"], ["夜", "と", "", "夜"], ["駆け", "て"], [], ["走っ", "走っ", "て"] * 3]
    rows = spark.createDataFrame(list(enumerate(lines)), "line int, surfaces array<string>")
    targets = spark.createDataFrame([("甘える", flags["v1"]), ("打ち込む", flags["v5"]), ("夜", 0), ("駆ける", 0), ("走る", flags["v5"])], "target string, term_conditions long")
    got = sorted(tuple(r) for r in dictionary.occurrences(rows, targets, inflection.japanese_rules(spark), ["line"]).collect())
    assert got == sorted([(0, "甘える", 0, 2), (1, "甘える", 0, 2), (2, "打ち込む", 0, 7), (4, "夜", 0, 1), (4, "夜", 3, 4), *[(7, "走る", 3 * k + 1, 3 * k + 3) for k in range(3)]])


def test_spans(spark):
    surfaces = ["ab", "", "cde", "fghijklmnop", "qrstuvwxyz", "a" * 20, "b"]
    got = {tuple(r) for r in dictionary.spans_of(spark.createDataFrame([(1, surfaces)], "k int, surfaces array<string>"), ["k"]).collect()}
    want = {(1, a, b, "".join(surfaces[a:b])) for a, b in itertools.combinations(range(len(surfaces) + 1), 2) if surfaces[a] and len("".join(surfaces[a:b])) <= 16}
    assert got == want


def test_occurrences_go_from_the_targets_back(spark, monkeypatch):
    flags = inflection.condition_flags(inflection.ENGLISH_CONDITIONS)
    rules, targets = inflection.english_rules(spark), spark.createDataFrame([("bake", flags["any"]), ("stable", flags["n"]), ("use", flags["v"]), ("y" * 16, 0)], "target string, term_conditions long")
    back = {tuple(r) for r in dictionary.inflections(targets, rules).collect()}
    words = spark.createDataFrame([(w,) for w in {w for w, _ in back} | {"bakings", "bakely", "users", "stables", "stabler", "usely", "usesed", "y" * 17}], "word string")
    forms = dictionary.deinflected(words, rules).join(targets, F.col("form") == F.col("target")).where("conditions = 0 OR conditions & term_conditions <> 0")
    assert back == {tuple(r) for r in forms.select("word", "target").distinct().collect() if len(r.word) <= 16} and {("bakings", "bake"), ("stables", "stable"), ("users", "use")} <= back
    monkeypatch.setattr(dictionary, "deinflected", None)  # not each run of tokens' forms
    lines = spark.createDataFrame([(1, ["baking", "us", "ed", "stab", "les", None, "used"])], "line int, surfaces array<string>")
    got = sorted(tuple(r) for r in dictionary.occurrences(lines, targets, rules, ["line"], processors=()).collect())
    assert got == [(1, "bake", 0, 1), (1, "stable", 3, 6), (1, "use", 1, 3), (1, "use", 6, 7)]
