"""Answer text: canonical form and comparison, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASE_BLIND = "UTF8_LCASE"


def normalize_answer(text: Column) -> Column:
    """Canonical form of a free-text answer; NULL stays NULL.

    Blanks at the ends go first and only blanks, so a leading tab survives as one
    blank: tabs and line ends turn into blanks after the trim, and runs of blanks
    then shrink to one.
    """
    trimmed = F.lower(F.trim(text))
    blanks_only = F.translate(trimmed, "\t\n\r", "   ")
    return F.regexp_replace(blanks_only, " {2,}", " ")


def comparable_answer(text: Column) -> Column:
    """Normal form in which two answers are equal exactly when they are ``=`` as
    padded strings, where blanks at the end do not count."""
    return F.rtrim(normalize_answer(text))


def is_answer_valid(answer: Column, best: Column) -> Column:
    """True when both texts have the same canonical form; a NULL on either side is false."""
    return F.coalesce(comparable_answer(answer) == comparable_answer(best), F.lit(False))


def text_key(value: Column, ci: bool = False) -> Column:
    """A string as a comparison key: blanks at the end ignored, case too if ``ci``."""
    key = F.rtrim(value)
    return F.collate(key, _CASE_BLIND) if ci else key


def like_expression(pattern: str) -> str:
    """A LIKE pattern with bracket classes as a regular expression for the whole value.

    ``%`` is any run, ``_`` any character, ``[a-c]`` one of a class, ``[^a-c]`` one outside it; in a class all
    else stands for itself, as do ``^`` not in front and ``-`` at either end.  No character is in an empty class
    ``[]`` and every one outside it.  A bracket that is never closed makes the pattern match nothing.
    """
    out, at = [], 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c != "[":
            out.append(_literal(c))
        else:
            end = pattern.find("]", at)
            if end < 0:
                return _NOTHING
            outside = pattern.startswith("^", at)
            out.append(_char_class(pattern[at + outside : end], outside))
            at = end + 1
    return "(?s)\\A" + "".join(out) + "\\z"


_NOTHING = "(?!)"


def _literal(c: str) -> str:
    return c if c.isalnum() or c.isspace() else "\\x{%x}" % ord(c)


def _char_class(members: str, outside: bool) -> str:
    if not members:
        return "." if outside else _NOTHING
    parts, at = [], 0
    while at < len(members):
        first, last = members[at], members[at + 2 : at + 3]
        if members[at + 1 : at + 2] == "-" and last:
            # A range that runs backwards holds nothing.
            parts += [f"{_literal(first)}-{_literal(last)}"] if first <= last else []
            at += 3
        else:
            parts.append(_literal(first))
            at += 1
    if not parts:
        return "." if outside else _NOTHING
    return f"[{'^' * outside}{''.join(parts)}]"


def like_anywhere(value: Column, part: str, ci: bool = False) -> Column:
    """``value LIKE '%part%'`` with ``%``, ``_`` and bracket classes in ``part`` kept as wildcards.

    Without brackets it is a plain LIKE, which Spark can turn into a search for a substring.  A backslash is a plain character
    in ``part``, though Spark's pattern needs two for one.
    """
    if ci:
        value, part = F.lower(value), part.lower()
    if "[" in part:
        return value.rlike(like_expression(f"%{part}%"))
    return value.like("%" + part.replace("\\", "\\\\") + "%")
