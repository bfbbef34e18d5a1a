"""RE2 patterns for the JVM's engine.

The rules' patterns mean code points and ASCII classes, and case-blind ones fold as Unicode does. The places where
java.util.regex reads a pattern differently are rewritten: word boundaries and blanks are ASCII, `$` is the very end, a
dot stops at newlines only.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary before a word character, and one after. In our patterns every boundary touches one.
_BEFORE, _AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_BLANK = r"\t\n\f\r "


_WORD_NEXT = re.compile(r"(?:\((?:\?:)?)*(?:\w|\\[dw])")


@cache
def jvm(pattern: str) -> str:
    """The pattern for java.util.regex."""
    out, i, inside = ["(?du)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if inside and pair == r"\s":
                out.append(_BLANK)
            elif inside and pair == r"\S":
                out.append(r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}")
            elif pair == r"\b" and not inside:
                out.append(_BEFORE if _WORD_NEXT.match(pattern, i + 2) else _AFTER)
            else:
                out.append({r"\s": f"[{_BLANK}]", r"\S": f"[^{_BLANK}]"}.get(pair, pair))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            c = r"\["
        elif c == "]" and inside:
            inside = False
        elif c == "$" and not inside:
            c = r"\z"
        elif c == "&" and inside:
            c = r"\&"
        out.append(c)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(jvm(pattern))


def first_match(text: Column, pattern: str) -> Column:
    """The leftmost match, '' if none."""
    return F.coalesce(F.regexp_substr(text, F.lit(jvm(pattern))), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0, most: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(group))
    return F.slice(found, 1, most) if most else found
