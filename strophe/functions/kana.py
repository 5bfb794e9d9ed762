"""Kana: script conversion as expressions, and morae of a reading."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))

# Katakana by vowel; small letters in their own lists.
ROWS = {"a": "アカガサザタダナハバパマヤラワ", "i": "イキギシジチヂニヒビピミリヰ", "u": "ウクグスズツヅヌフブプムユルヴ", "e": "エケゲセゼテデネヘベペメレヱ", "o": "オコゴソゾトドノホボポモヨロヲ"}
SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "a", "ュ": "u", "ョ": "o", "ヮ": "a"}
VOWEL = {c: v for v, cs in ROWS.items() for c in cs} | SMALL


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def vowels_of(reading: str | None) -> list[str] | None:
    """The vowel of each mora of a kana reading: N for ん, Q for っ, the vowel before for a long mora; None if it holds anything else."""
    if not reading:
        return None
    out: list[str] = []
    text = [chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in reading]
    for k, c in enumerate(text):
        if c == "ン":
            out.append("N")
        elif c == "ッ":
            out.append("Q")
        elif c == "ー":
            last = next((v for v in reversed(out) if v not in "NQ"), None)
            if last is None:
                return None
            out.append(last)
        elif c in SMALL and k and text[k - 1] in VOWEL and text[k - 1] not in SMALL and SMALL[c] != VOWEL[text[k - 1]]:
            out[-1] = SMALL[c]
        elif c in VOWEL:
            out.append(VOWEL[c])
        else:
            return None
    return out


@F.pandas_udf(ArrayType(StringType()))
def vowels(reading: pd.Series) -> pd.Series:
    return reading.map(vowels_of)


def rhyme_tail(vowel_array: Column, k: int) -> Column:
    """The last ``k`` vowels, null with fewer."""
    return F.when(F.size(vowel_array) >= k, F.array_join(F.slice(vowel_array, -k, k), ""))


# ---- other spellings of a word, for looking it up ----

#: Full-width signs by their half-width ones, kana that are composed with a sound mark, and characters for radicals, by Unicode's own tables.
_HALF = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF66, 0xFF9E)}
_MARKS = {"\u3099": "ﾞ", "\u309a": "ﾟ"}
_COMPOSED = {unicodedata.normalize("NFD", chr(c)): chr(c) for c in range(0x3041, 0x30FF) if len(unicodedata.normalize("NFD", chr(c))) == 2}
_RADICALS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2E80, 0x2FD6) if len(unicodedata.normalize("NFKC", chr(c))) == 1}
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _NARROW)
EMPHATIC = "っッー"


def _replaced(c: Column, pairs: dict[str, str], only: str) -> Column:
    """All of ``pairs`` in turn, in texts that match ``only``."""
    return F.when(c.rlike(only), reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)).otherwise(c)


def full_width_kana(c: Column) -> Column:
    """Half-width katakana as full-width ones; a sound mark goes into the kana before it."""
    half = {v: k for k, v in _HALF.items()}
    pairs = {half[base[0]] + _MARKS[base[1]]: full for base, full in _COMPOSED.items() if base[0] in half}
    return F.translate(_replaced(c, pairs, "[ﾞﾟ]"), "".join(_HALF), "".join(_HALF.values()))


def composed(c: Column) -> Column:
    """Kana and combining sound marks as one character."""
    return _replaced(c, _COMPOSED, "[\u3099\u309a]")


def radicals(c: Column) -> Column:
    return F.translate(c, "".join(_RADICALS), "".join(_RADICALS.values()))


def compatible(c: Column) -> Column:
    """Squared words and units as the words they stand for."""
    return F.when(c.rlike("[\u3300-\u33ff]"), reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), _SQUARED.items(), c)).otherwise(c)


_SQUARED = {chr(x): unicodedata.normalize("NFKC", chr(x)) for x in range(0x3300, 0x3400)}


def narrow(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def wide(c: Column) -> Column:
    return F.translate(c, _NARROW, _WIDE)


def spoken_hiragana(c: Column) -> Column:
    """Katakana as hiragana; long signs become the vowel that they lengthen, a long o being written with u. ヵ and ヶ stay."""
    out = F.translate(c, "".join(k for k in KATAKANA if k not in "ヵヶ"), "".join(h for h in HIRAGANA if h not in "ゕゖ"))
    for vowel, sign in zip("aiueo", "あいうえう", strict=True):
        row = "".join(chr(ord(k) - 0x60) for k, v in VOWEL.items() if v == vowel)
        out = F.regexp_replace(out, f"(?<=[{row}]ー{{0,15}})ー", sign)
    return out


def collapsed(c: Column, whole: bool) -> Column:
    """Runs of one emphatic sign within a word as one sign, or (``whole``) none at all; at either end they stay."""
    part = lambda n: F.regexp_extract(c, f"(?s)^([{EMPHATIC}]*)(.*?)([{EMPHATIC}]*)$", n)
    middle = F.regexp_replace(part(2), f"[{EMPHATIC}]", "") if whole else F.regexp_replace(part(2), f"([{EMPHATIC}])\\1+", "$1")
    return F.when(c.rlike(f"[{EMPHATIC}]") & (part(2) != ""), F.concat(part(1), middle, part(3))).otherwise(c)


def _syllables() -> dict[str, str]:
    """Romanised syllables by rows of consonants and vowels, and what is written otherwise."""
    rows = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
    small_y, small_v = {"a": "ゃ", "i": "ぃ", "u": "ゅ", "e": "ぇ", "o": "ょ"}, {"a": "ぁ", "i": "ぃ", "u": "ぅ", "e": "ぇ", "o": "ぉ"}
    out = {consonant + vowel: sign for consonant, signs in rows.items() for vowel, sign in zip("aiueo", signs, strict=True)}
    for consonant, signs in rows.items():
        if consonant:
            out |= {f"{consonant}y{vowel}": ("じ" if consonant == "z" else signs[1]) + s for vowel, s in small_y.items()}
    out |= {said + vowel: sign + s for said, sign in (("sh", "し"), ("ch", "ち"), ("cy", "ち"), ("j", "じ"), ("jy", "じ")) for vowel, s in small_y.items()}
    out |= {said + vowel: sign + s for said, sign in (("f", "ふ"), ("v", "ゔ"), ("q", "く"), ("kw", "く"), ("gw", "ぐ"), ("sw", "す"), ("zw", "ず"), ("tw", "と"), ("dw", "ど"), ("hw", "ふ"), ("wh", "う"), ("ts", "つ"), ("l", ""), ("x", "")) for vowel, s in small_v.items()}
    out |= {said + vowel: sign + s for said, sign in (("th", "て"), ("dh", "で"), ("vy", "ゔ")) for vowel, s in small_y.items()}
    # Syllables outside of these rows.
    return out | {
        "shi": "し", "chi": "ち", "ji": "じ", "zi": "じ", "fu": "ふ", "vu": "ゔ", "qu": "く", "whu": "う", "wu": "う", "tsu": "つ", "ya": "や", "yu": "ゆ", "yo": "よ", "ye": "いぇ", "wa": "わ", "wi": "うぃ", "we": "うぇ", "wo": "を", "wyi": "ゐ", "wye": "ゑ",
        "ca": "か", "ci": "し", "cu": "く", "ce": "せ", "co": "こ", "xtsu": "っ", "ltsu": "っ", "xtu": "っ", "ltu": "っ", "xya": "ゃ", "lya": "ゃ", "xyu": "ゅ", "lyu": "ゅ", "xyo": "ょ", "lyo": "ょ", "xwa": "ゎ", "lwa": "ゎ", "n'": "ん", "nn": "ん", "xn": "ん", "n": "ん", "-": "ー",
    }


_SYLLABLES = _syllables()


def hiragana_of(text: str | None) -> str | None:
    """Latin letters (of any width) that spell Japanese syllables as hiragana, the longest first; doubled consonants as っ; other signs stay."""
    if text is None:
        return None
    low = "".join(unicodedata.normalize("NFKC", c).lower() if c in _WIDE or c in _NARROW else c for c in text)
    out, k = [], 0
    while k < len(low):
        n = next((n for n in (4, 3, 2, 1) if low[k : k + n] in _SYLLABLES), 0)
        if low[k] == low[k + 1 : k + 2] and low[k] in "qvlxkgszjtdhfbpmyrwc":
            n, sign = 1, "っ"
        else:
            sign = _SYLLABLES[low[k : k + n]] if n else low[k]
        out.append(sign)
        k += n or 1
    return "".join(out)


@F.pandas_udf(ArrayType(StringType()))
def hiragana_of_latin(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [hiragana_of(t) for t in ts])
