"""Words of dirty texts: markup, entities, wrong encodings, invisible characters, case and punctuation aside."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[^<>]{0,300}>")
_MOJIBAKE = re.compile(r"(?:[ÂÃâÅÄÎÏ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2})+")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_WORD = re.compile(r"[^\W_]+")


def _decoded(m: re.Match) -> str:
    """UTF-8 that was read as Windows-1252, decoded again where that is possible."""
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()


def tidy(text: str) -> str:
    """Text without markup and encoding damage; words stay apart."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text and ";" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if "Ã" in text or "â" in text or "Â" in text:
            text = _MOJIBAKE.sub(_decoded, text)
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text


def clean(text: str) -> str:
    """Tidy text in lower case."""
    return tidy(text).lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the clean text."""
    return _WORD.findall(clean(text))
