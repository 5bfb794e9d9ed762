"""Whole-text encoding with the ``tokenizers`` library, one word at a time.

Both vocabularies used here never merge across a word start, so a text's ids are its words' ids in order.
A task encodes each different word once, keeps it in a bounded table and joins bytes for the rest.
Texts that do not split safely go to the library whole, so ids equal ``Tokenizer.encode`` for every text.
"""

from __future__ import annotations

import re
import struct

#: Different words a worker remembers in each of two generations: beyond it the older one goes, and of it what is met again comes along.
REMEMBERED_WORDS = 350_000
#: Words longer than this are not remembered.
REMEMBERED_LENGTH = 64


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 letters stay, others follow from 256."""
    stay = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(stay))}
    return {b: chr(b) for b in stay} | moved


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """``encode(text)`` gives little-endian unsigned 32-bit ids of a whole text as bytes.

    ``kind`` is "byte" (byte-level words that begin with their space) or "word" (lower-case words that end
    with a mark; white space is dropped); ``of`` chooses it from the tokenizer's own description.
    ``special_as_text`` takes the strings of special tokens in a text for ordinary text; without it they are
    their tokens, as the library has it by itself.
    """

    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")

    #: What str.split() takes for white space and the library's classes do not.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def __init__(self, spec: str, kind: str | None = None, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = special_as_text
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content and not (special_as_text and t.special)]
        #: Strings that send a text to the library whole.
        self.apart = [*self.SEPARATORS, *added]
        self.model = self.whole.model
        self.kind = kind or self.of(spec)
        self.letters = byte_letters()
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.older: dict[int, dict[str, bytes]] = {0: {}, 1: {}}
        self.newline = self.plain("\n") if self.kind == "byte" else b""

    @staticmethod
    def of(spec: str) -> str:
        import json

        d = json.loads(spec)
        norm, pre, model = d.get("normalizer"), d.get("pre_tokenizer") or {}, d.get("model") or {}
        if model.get("type", "BPE") == "BPE" and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "byte"
        if model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return "word"
        return "whole"

    def plain(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def letters_only(self, word: str) -> bytes:
        """One pre-token, straight to the model."""
        return packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def forget(self) -> None:
        if len(self.first) + len(self.later) > REMEMBERED_WORDS:
            self.older = {0: self.first, 1: self.later}
            self.first, self.later = {}, {}

    def word(self, table: dict[str, bytes], older: dict[str, bytes], w: str, make) -> bytes:
        """``w`` from the tables or made; short ones are remembered."""
        ids = table.get(w)
        if ids is None:
            ids = older.get(w)
            if ids is None:
                ids = make(w)
            if len(w) <= REMEMBERED_LENGTH:
                table[w] = ids
        return ids

    def learn(self, table: dict[str, bytes], words: set[str], before: str) -> dict[str, bytes]:
        """``table``, or where it lacks very long words a view of it with them."""
        long: dict[str, bytes] = {}
        older = self.older[1 if before else 0]
        byte = self.kind == "byte"
        stem = (lambda w: self.letters_only(before + w)) if byte else self.letters_only
        for w in words:
            ids = older.get(w)
            if ids is None:
                m = self.SIMPLE.fullmatch(w)
                if m is None:
                    ids = self.plain(before + w)
                else:
                    ids = self.word(table, older, m[1] if byte else m[1].lower(), stem)
                    if m[2]:  # signs behind a word are a pre-token of their own, as at the start of a text
                        ids += self.word(self.first, self.older[0], m[2], self.plain)
            (table if len(w) <= REMEMBERED_LENGTH else long)[w] = ids
        return table | long if long else table

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.apart):
            return self.plain(text)
        self.forget()
        if self.kind == "word":
            words = text.split()
            if missing := set(words).difference(self.first):
                return b"".join(map(self.learn(self.first, missing, "").__getitem__, words))
            return b"".join(map(self.first.__getitem__, words))
        if self.kind == "byte":
            lines = [x.split(" ") for x in text.split("\n")]
            # safe where single spaces or newlines part the words and nothing else does
            if all(all(x) for x in lines) and sum(map(len, lines)) == len(text.split()):
                firsts, laters = {x[0] for x in lines}, {w for x in lines for w in x[1:]}
                first, later = self.first, self.later
                if missing := firsts.difference(first):
                    first = self.learn(first, missing, "")
                if missing := laters.difference(later):
                    later = self.learn(later, missing, " ")
                get = later.__getitem__
                return self.newline.join([first[x[0]] + b"".join(map(get, x[1:])) for x in lines])
        return self.plain(text)


_encoders: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """The worker's encoder of this tokenizer; kept while the worker lives."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = WordEncoder(spec, special_as_text=False)
    return _encoders[key]


def read_spec(path: str) -> str:
    """The tokenizer's file, read on the driver (1.7 MB at most here) and sent along with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()
