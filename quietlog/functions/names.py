"""Predicates over topic names."""

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Escapes that both dialects read alike, and flags of RE2.
_ESCAPES = "dDwWsSbBAztnrfavQE"
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_GROUP = re.compile(r"\(\?P?<([A-Za-z][A-Za-z0-9]*)>")
_REPEAT = re.compile(r"[*+?]|\{[0-9]+(?:,[0-9]*)?\}")
_PROPERTY = re.compile(r"[pP](?:\{\^?[A-Za-z_]+\}|[A-Z])")
_NAMED_CLASS = re.compile(r"\[:(\^?)([a-z]+):\]")
# POSIX classes of RE2 and their java.util.regex names.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}


class InvalidSearch(ValueError):
    """A search pattern that cannot be compiled."""


def is_system_topic(topic: Column) -> Column:
    """Names that begin with an underscore."""
    return topic.startswith("_")


def portable_regex(pattern: str) -> str:
    """Rewrite an RE2 pattern for java.util.regex, refusing what RE2 refuses.

    Reads the pattern token by token: escapes, classes, groups and repetitions.  In classes
    ``[`` and ``&`` are plain characters, as in RE2; the flag ``i`` also folds letters
    beyond ASCII.
    """
    out: list[str] = []
    i, repeated = 0, False

    def refuse(what: str):
        raise InvalidSearch(f"invalid search regex: {pattern!r}: {what}")

    def escape(i: int, in_class: bool) -> int:
        """Take the escape at ``i``; the position behind it."""
        rest = pattern[i + 1:]
        if not rest:
            refuse("it ends in a backslash")
        found = _PROPERTY.match(rest)
        if found:
            text = found[0].replace("{^", "{")
            out.append("\\" + (text if text == found[0] else ("P" if text[0] == "p" else "p") + text[1:]))
            return i + 1 + found.end()
        numbered = re.match(r"x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|0[0-7]{0,2}", rest)
        if numbered:
            out.append("\\" + (numbered[0] if numbered[0] != "0" else "00"))
            return i + 1 + numbered.end()
        if rest[0] in "QE" or rest[0].isalnum() and rest[0] not in (_ESCAPES.replace("b", "").replace("B", "") if in_class else _ESCAPES):
            if rest[0] == "Q" and not in_class:
                quoted, _, tail = rest[1:].partition("\\E")
                out.extend(re.escape(c) if not c.isalnum() else c for c in quoted)
                return len(pattern) - len(tail)
            refuse(f"unknown escape \\{rest[0]}")
        # java.util.regex reads \v as any vertical space
        out.append("\\x0B" if rest[0] == "v" else "\\" + rest[0])
        return i + 2

    def class_(i: int) -> int:
        """Take the class at ``i``; the position behind it."""
        out.append("[")
        i += 1
        if pattern[i:i + 1] == "^":
            out.append("^")
            i += 1
        first = True
        while first or pattern[i:i + 1] != "]":
            if i >= len(pattern):
                refuse("a class is not closed")
            named = _NAMED_CLASS.match(pattern, i)
            if named and named[2] in POSIX_CLASSES:
                java = POSIX_CLASSES[named[2]]
                out.append(java.replace("\\p", "\\P").replace("\\w", "\\W") if named[1] else java)
                i = named.end()
            elif named:
                refuse(f"unknown class {named[0]}")
            elif pattern[i] == "\\":
                i = escape(i, True)
            else:
                out.append("\\" + pattern[i] if pattern[i] in "[]&" else pattern[i])
                i += 1
            first = False
        out.append("]")
        return i + 1

    while i < len(pattern):
        c = pattern[i]
        repeat = _REPEAT.match(pattern, i)
        if repeat:
            if repeated:
                refuse("a repetition of a repetition")
            i = repeat.end()
            lazy = pattern[i:i + 1] == "?"
            out.append(repeat[0] + "?" * lazy)
            i += lazy
            repeated = True
            continue
        repeated = False
        if c == "\\":
            i = escape(i, False)
        elif c == "[":
            i = class_(i)
        elif pattern.startswith("(?", i):
            flags, group = _FLAGS.match(pattern, i), _GROUP.match(pattern, i)
            if flags:
                if "U" in flags[1] + (flags[2] or ""):
                    refuse("the flag U")
                off = "-" + flags[2].replace("i", "iu") if flags[2] else ""
                out.append("(?" + flags[1].replace("i", "iu") + off + flags[3])
                i = flags.end()
            elif group:
                out.append(f"(?<{group[1]}>")
                i = group.end()
            else:
                refuse("an unsupported group")
        else:
            out.append("\\{" if c == "{" else c)
            i += 1
    return "".join(out)


def check_regex(pattern: str) -> None:
    """Compile the pattern in Spark on one constant row, before any plan uses it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a Spark session is needed to compile a search pattern")
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except Exception as error:
        raise InvalidSearch(f"invalid search regex: {pattern!r}") from error


def search_predicate(topic: Column, search: str | None) -> Column | None:
    """Case-insensitive unanchored regex of the report search; None matches all."""
    query = (search or "").strip()
    if not query:
        return None
    pattern = "(?iu)" + portable_regex(query)
    check_regex(pattern)
    return topic.rlike(pattern)


def name_matcher(topic: Column, prefix: str | None = None, search: str | None = None,
                 regex: bool = False) -> Column | None:
    """Prefix (case-sensitive) and substring (any case) or regex (case-sensitive)."""
    prefix = (prefix or "").strip()
    search = (search or "").strip()
    predicate = None
    if search and regex:
        pattern = portable_regex(search)
        check_regex(pattern)
        predicate = topic.rlike(pattern)
    elif search:
        predicate = F.lower(topic).contains(F.lower(F.lit(search)))
    if prefix:
        starts = topic.startswith(prefix)
        predicate = starts if predicate is None else starts & predicate
    return predicate
