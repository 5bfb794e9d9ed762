"""Text expressions: scripts, language, literal search, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges. Two classifiers with different ranges, as the two uses differ.
JAPANESE = "[ぁ-んァ-ヶｦ-ｿ一-鿿㐀-䶿]"
SCRIPTS = {
    "kanji": r"[々〆〇㐀-䶿一-鿿豈-﫿\x{20000}-\x{2FFFF}]",
    "hiragana": r"[ぁ-ゟ]",
    "katakana": r"[゠-ヿㇰ-ㇿｦ-ﾟ]",
    "latin": r"[A-Za-zＡ-Ｚａ-ｚÀ-ÖØ-öø-ɏ]",
}


def is_japanese(c: Column) -> Column:
    return c.rlike(JAPANESE)


def script_counts(c: Column) -> dict[str, Column]:
    """Characters of each script; other is the rest."""
    out = {name: F.regexp_count(c, F.lit(pattern)) for name, pattern in SCRIPTS.items()}
    return out | {"other": F.length(c) - sum(out.values(), F.lit(0))}


def contains(c: Column, literal: str) -> Column:
    """``literal`` as it stands, without regard to case."""
    return F.lower(c).contains(F.lit(literal.lower()))


def strip_tags(html: Column) -> Column:
    """The text of an HTML page: scripts and tags out, blanks made one."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def matching_key(name: Column) -> Column:
    """A key under which spellings of a name meet: lower case, bracketed parts and all but letters and digits out."""
    bare = F.regexp_replace(F.lower(name), r"[(\[（【][^)\]）】]*[)\]）】]", "")
    key = F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")
    return F.when(key == "", F.regexp_replace(F.lower(name), r"\s+", "")).otherwise(key)
