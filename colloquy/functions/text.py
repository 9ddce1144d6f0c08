"""Text expressions. Character classes are spelled out because `\\s` and `.` differ between engines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters of ECMAScript white space, and any character but a line end. The dot of Java
# would also end at U+0085, that of other engines not at all or elsewhere.
WHITESPACE = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SAME_LINE = r"[^\n\r\x{2028}\x{2029}]"
LINE_END = r"[\n\r\x{2028}\x{2029}]"

# Markup escapes in the order they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>"))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE_CHARACTERS)) == ""


def escape_markup(text: Column) -> Column:
    for found, put in ESCAPES:
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def any_of(text: Column, keywords, whole_words: bool = False) -> Column:
    """True when `text` contains one of `keywords` as a plain substring, or as a word if asked."""
    if not keywords:
        return F.lit(False)
    hit = F.lit(False)
    for i, keyword in enumerate(keywords):
        if whole_words:
            one = text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(keyword)}(?![\p{{L}}\p{{N}}_])")
        else:
            one = F.contains(text, F.lit(keyword))
        hit = one if i == 0 else hit | one
    return hit
