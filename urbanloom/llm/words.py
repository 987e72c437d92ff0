"""Words of a text, independent of case, punctuation, spacing, line breaks and the encoding of characters."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

_ZERO_WIDTH = re.compile("[­​-‏⁠﻿︀-️]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t]*)?(?=[^\W\d_])")
_MARKS = re.compile("[" + "".join(map(re.escape, filter(unicodedata.combining, map(chr, range(sys.maxunicode + 1))))) + "]+")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
# a lead byte of UTF-8 and what may follow it, read as Windows-1252 or Latin-1
_LEAD = "Â-ô"
_TAIL = "\u0080-¿" + "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_MISREAD = re.compile(f"[{_LEAD}][{_TAIL}]{{1,3}}")


def _bytes(text: str) -> bytes:
    return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in text)


def _reread(m: re.Match) -> str:
    try:
        return _bytes(m[0]).decode("utf-8")
    except UnicodeError:
        return m[0]


def repair(text: str) -> str:
    """``text`` with UTF-8 that was read as Windows-1252 or Latin-1 (once or twice) read again."""
    for _ in range(2):
        if not _MISREAD.search(text):
            return text
        text = _MISREAD.sub(_reread, text)
    return text


def plain(text: str) -> str:
    """Lower-case text without entities, accents, invisible characters and the hyphens inside words."""
    if text.isascii():
        if "&" in text:
            text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
        if text.isascii():
            return _HYPHEN.sub("", text.lower())
    text = repair(_ENTITY.sub(lambda m: html.unescape(m[0]), text))
    text = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKD", text).casefold())
    return _HYPHEN.sub("", _MARKS.sub("", text))


def words(text: str | None) -> list[str]:
    """Words (runs of letters and digits) of ``plain`` text; none for null, empty and blank texts."""
    return _WORD.findall(plain(text)) if text else []
