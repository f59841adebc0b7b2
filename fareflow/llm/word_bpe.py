"""Text pieces of a word-end BPE tokenizer file, shared by packing and encoding.

The tokenizer composes code points (NFC), lowers case and drops white space,
so what lies between white space is encoded apart from the rest: one entry
per distinct chunk suffices.  Special strings are matched in the raw text
before anything else; they hold no white space, so a chunk with one is
simply encoded as it is.
"""

from __future__ import annotations

import json
import re

import regex

#: Separators that ``str.split`` knows beyond Unicode white space.
_NOT_WHITE = regex.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\p{White_Space}]+")


def chunks(text: str) -> list[str]:
    """What Unicode white space separates."""
    return _CHUNK.findall(text) if _NOT_WHITE.search(text) else text.split()


# The tokenizer's word pattern, for text of Latin-1 letters in lower case.
_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


def words(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes apart from each other.

    In Latin-1 text without special strings these are its words: composing
    changes nothing there, and lower case is one code point for one.  Other
    texts are parted at white space only.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            return _WORD.findall(text.lower())
        except UnicodeEncodeError:
            pass
    return chunks(text)


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
