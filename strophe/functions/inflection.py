"""Rule tables of inflected endings: what an ending may come from, and which rules may follow one another.

A rule takes ``inflected`` at the end of a word (or as the whole word) for ``deinflected``. It applies to a word that no rule has touched or
whose conditions share a bit with ``conditions_in``; the word it gives has ``conditions_out``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

RULES = "transform string, place long, whole boolean, inflected string, deinflected string, conditions_in long, conditions_out long"

Rule = tuple[str, bool, str, str, str, str]


def condition_flags(conditions: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """A bit for each condition without parts, in their order; the others are the union of their parts, which may have parts too."""
    flags = {name: 1 << k for k, name in enumerate(n for n, parts in conditions.items() if not parts)}
    while len(flags) < len(conditions):
        ready = {n: parts for n, parts in conditions.items() if n not in flags and all(p in flags for p in parts)}
        if not ready:
            raise ValueError("conditions that are parts of each other, or unknown parts")
        flags |= {n: sum({flags[p] for p in parts}) if len(parts) == 1 else _union(flags[p] for p in parts) for n, parts in ready.items()}
    return flags


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


def flags_of(flags: dict[str, int], names: str) -> int:
    """Bits of names parted by blanks; unknown ones have none."""
    return _union(flags.get(n, 0) for n in names.split())


def rule_table(spark: SparkSession, rules: list[Rule], conditions: dict[str, tuple[str, ...]]) -> DataFrame:
    """(transform, whole, inflected, deinflected, conditions in, conditions out) as a table; their order is the order they are tried in."""
    flags = condition_flags(conditions)
    if any(not inflected and not whole for _, whole, inflected, *_ in rules):
        raise ValueError("a rule of an empty ending")
    rows = [(t, k, whole, a, b, flags_of(flags, before), flags_of(flags, after)) for k, (t, whole, a, b, before, after) in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


# ---- English-like endings ----

ENGLISH_CONDITIONS = {"n": (), "np": (), "v": (), "vp": (), "adj": (), "adv": (), "any": ("n", "np", "v", "vp", "adj", "adv")}
# Transform, ending, ending it comes from, conditions before and after.
_ENGLISH = (
    ("plural", "ies", "y", "np", "n"), ("plural", "es", "e", "np", "n"), ("plural", "s", "", "np", "n"),
    ("past", "ied", "y", "vp adj", "v"), ("past", "ed", "e", "vp adj", "v"), ("past", "ed", "", "vp adj", "v"),
    ("-ing", "ing", "e", "vp adj n", "v"), ("-ing", "ing", "", "vp adj n", "v"),
    ("-ly", "ily", "y", "adv", "adj"), ("-ly", "bly", "ble", "adv", "adj"), ("-ly", "ly", "", "adv", "adj"),
    ("-able", "able", "e", "adj", "v"), ("-able", "able", "", "adj", "v"),
    ("-tion", "ation", "ate", "n", "v"), ("-tion", "tion", "te", "n", "v"),
    ("-ness", "iness", "y", "n", "adj"), ("-ness", "ness", "", "n", "adj"),
    ("-er", "er", "e", "n adj", "v adj"), ("-er", "er", "", "n adj", "v adj"),
)


def english_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [(t, False, a, b, before, after) for t, a, b, before, after in _ENGLISH], ENGLISH_CONDITIONS)


# ---- Japanese, from the rows of the kana table ----

JAPANESE_CONDITIONS = {
    "v1": (), "v5": (), "vk": (), "vs": (), "adj-i": (), "-te": (), "-ta": (), "-masu": (), "-nai": (), "-ba": (), "-tai": (),
    "v": ("v1", "v5", "vk", "vs"),
}
# Last kana of the dictionary form, the same consonant with a, i, e and o, and how the te-form begins.
GODAN = (
    ("う", "わ", "い", "え", "お", "っ"), ("く", "か", "き", "け", "こ", "い"), ("ぐ", "が", "ぎ", "げ", "ご", "い"), ("す", "さ", "し", "せ", "そ", "し"), ("つ", "た", "ち", "て", "と", "っ"),
    ("ぬ", "な", "に", "ね", "の", "ん"), ("ぶ", "ば", "び", "べ", "ぼ", "ん"), ("む", "ま", "み", "め", "も", "ん"), ("る", "ら", "り", "れ", "ろ", "っ"),
)
VOICED = "ぐぬぶむ"


def _japanese() -> Iterator[Rule]:
    def forms(stem_a: str, stem_i: str, stem_e: str, stem_o: str, te: str, base: str, kind: str, long_passive: bool) -> Iterator[Rule]:
        """All forms of one row of verbs."""
        t, d = (te[:-1] + "だ", te) if te.endswith("で") else (te[:-1] + "た", te)
        passive = "られる" if long_passive else "れる"
        causative = "させる" if long_passive else "せる"
        yield "-て", False, d, base, "-te", kind
        yield "-た", False, t, base, "-ta", kind
        yield "-たら", False, t + "ら", base, "", kind
        yield "-たり", False, t + "り", base, "", kind
        yield "-ます", False, stem_i + "ます", base, "-masu", kind
        yield "-たい", False, stem_i + "たい", base, "adj-i -tai", kind
        yield "-そう", False, stem_i + "そう", base, "", kind
        yield "-なさい", False, stem_i + "なさい", base, "", kind
        yield "negative", False, stem_a + "ない", base, "adj-i -nai", kind
        yield "-ず", False, stem_a + "ず", base, "", kind
        yield "passive", False, stem_a + passive, base, "v1", kind
        yield "causative", False, stem_a + causative, base, "v1", kind
        yield "-ば", False, stem_e + "ば", base, "-ba", kind
        yield "volitional", False, stem_o + "う", base, "", kind
        yield "stem", False, stem_i, base, "", kind

    for u, a, i, e, o, te in GODAN:
        yield from forms(a, i, e, o, te + ("で" if u in VOICED else "て"), u, "v5", False)
        yield "potential", False, e + "る", u, "v1", "v5"
        yield "imperative", False, e, u, "", "v5"
    yield from (rule for rule in forms("", "", "れ", "よ", "て", "る", "v1", True) if rule[2])
    yield "imperative", False, "ろ", "る", "", "v1"
    # the two verbs whose stems change
    yield from forms("し", "し", "すれ", "しよ", "して", "する", "vs", False)
    yield "passive", False, "される", "する", "v1", "vs"
    yield "causative", False, "させる", "する", "v1", "vs"
    for kana, kanji in ((("こ", "き", "くれ", "こよ", "きて"), "くる"), (("来", "来", "来れ", "来よ", "来て"), "来る")):
        yield from forms(*kana, kanji, "vk", True)
    # the verb of going, which has its own te-form
    for going in ("行", "い"):
        for end in ("って", "った", "ったら"):
            yield "-" + end[1:], True, going + end, going + "く", "-te" if end == "って" else "-ta" if end == "った" else "", "v5"
    # adjectives, and what follows other forms
    for end, name, before in (("くない", "negative", "adj-i -nai"), ("かった", "-た", "-ta"), ("くて", "-て", "-te"), ("ければ", "-ば", "-ba"), ("く", "adverb", ""), ("さ", "-さ", ""), ("そう", "-そう", ""), ("すぎる", "-すぎる", "v1")):
        yield name, False, end, "い", before, "adj-i"
    for end, name, before in (("ました", "-た", "-ta"), ("ません", "negative", ""), ("ましょう", "volitional", ""), ("まして", "-て", "-te"), ("ませんでした", "negative past", "-ta")):
        yield name, False, end, "ます", before, "-masu"
    for form in "てで":
        for end, name, before in (("いる", "-いる", "v1"), ("る", "-いる", "v1"), ("しまう", "-しまう", "v5"), ("おく", "-おく", "v5"), ("ある", "-ある", "v5"), ("くる", "-くる", "vk"), ("いく", "-いく", "v5"), ("ください", "-ください", "")):
            yield name, False, form + end, form, before, "-te"
    for said, form in (("ちゃう", "て"), ("じゃう", "で"), ("ちまう", "て"), ("じまう", "で")):
        yield "-しまう", False, said, form, "v5", "-te"


def japanese_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, list(_japanese()), JAPANESE_CONDITIONS)
