"""Text expressions: literal and regular-expression replacement, cleaning for matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the cleaning rule.
BRACKETED = r"\[[^\]\n]*\]|\([^)\n]*\)|\{[^}\n]*\}"
NOT_ALLOWED = r"[^ \-_A-Za-z0-9]+"
BLANK_LIKE = "-_"


def replace_literal(text: Column, find: str, put: str) -> Column:
    """All occurrences; an empty `find` changes nothing."""
    return F.replace(text, F.lit(find), F.lit(put)) if find else text


def _replacement(put: str, shift: int) -> str:
    """Turn \\1..\\9 and \\& into Java group references moved on by `shift`, the rest into literal text."""
    def java(match):
        token = match.group(0)
        if token in ("$", "\\$"):
            return token.replace("\\", "\\\\").replace("$", "\\$")
        if token[1:] in tuple("123456789"):
            return f"${int(token[1:]) + shift}"
        if token == "\\&":
            return f"${shift}"
        return "\\\\" if token == "\\\\" else "\\\\" + token[1:]
    return re.sub(r"\\.|\\$|\$", java, put, flags=re.S)


def _shift_back_references(pattern: str, shift: int) -> str:
    return re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + shift}" if m[1] in "123456789" else m[0], pattern, flags=re.S)


def replace_regex(text: Column, pattern: str, put: str, every: bool = False) -> Column:
    """Replace the first match (or `every` one). The dot matches a line end; \\1 and \\& refer to groups.

    Spark replaces every match, so the first one is taken together with all text before it.
    """
    if every:
        return F.regexp_replace(text, "(?s)" + pattern, _replacement(put, 0))
    first = rf"(?s)\A(.*?)({_shift_back_references(pattern, 2)})"
    return F.regexp_replace(text, first, "$1" + _replacement(put, 2))


def clean_text(text: Column) -> Column:
    """Lower-case, without bracketed parts and unusual characters, - and _ as blanks, blanks squeezed."""
    text = F.regexp_replace(F.lower(text), BRACKETED, "")
    text = F.regexp_replace(text, NOT_ALLOWED, "")
    text = F.translate(text, BLANK_LIKE, " " * len(BLANK_LIKE))
    return F.trim(F.regexp_replace(text, " {2,}", " "))
