"""Text helpers as Spark Columns: line splitting, stripping, path parts, regex flags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registries import LANGUAGE_BY_EXTENSION

# Line terminators of a universal-newline text split, and the
# characters that count as white space.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
QUOTED_VALUE = r"['\"][^'\"]{4,}['\"]"
MASK = "'***MASKED***'"


def regex(pattern: str, flags: str = "") -> str:
    """A pattern in Java's dialect with Unix-line and Unicode semantics.

    ``d`` makes ``.``/``$`` know only LF and ``U`` makes ``\\s \\w \\b`` Unicode
    aware, which is what the patterns were written for.
    """
    return f"(?{flags}dU)" + pattern


def quoted(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw_lines(content: Column) -> Column:
    """Lines of a text; a trailing terminator leaves one empty last element."""
    return F.split(content, LINE_BREAK)


def lines(content: Column) -> Column:
    """Lines without the empty element after a trailing terminator; '' has none."""
    parts = raw_lines(content)
    return F.slice(parts, 1, line_count(content))


def line_count(content: Column) -> Column:
    """Number of lines: terminators, plus one for text after the last of them."""
    breaks = F.regexp_count(content, F.lit(LINE_BREAK))
    unfinished = (content != "") & ~content.rlike(f"(?:{LINE_BREAK})\\z")
    return breaks + unfinished.cast("int")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def snippet(line: Column, width: int) -> Column:
    return F.substring(strip(line), 1, width)


def masked_snippet(line: Column, width: int = 200) -> Column:
    """The stripped line with its quoted values replaced, cut to ``width``."""
    masked = F.regexp_replace(strip(line), QUOTED_VALUE, MASK)
    return F.substring(masked, 1, width)


def strictly_masked_snippet(line: Column, patterns, width: int = 200) -> Column:
    """As :func:`masked_snippet`, but what a pattern matched is masked as well."""
    hidden = strip(line)
    for pattern in patterns:
        hidden = F.regexp_replace(hidden, regex(pattern), "***MASKED***")
    return F.substring(F.regexp_replace(hidden, QUOTED_VALUE, MASK), 1, width)


def extension(path: Column) -> Column:
    """Text after the last dot of the whole path, null without a dot."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1))


def language(path: Column) -> Column:
    """Rule language of a path by its (case-sensitive) suffix."""
    by_language: dict[str, list[str]] = {}
    for suffix, name in LANGUAGE_BY_EXTENSION:
        by_language.setdefault(name, []).append(suffix)
    result = F
    for name, suffixes in by_language.items():
        result = result.when(ends_with_any(path, suffixes), name)
    return result.otherwise("any")


def ends_with_any(path: Column, suffixes) -> Column:
    condition = F.lit(False)
    for suffix in suffixes:
        condition = condition | path.endswith(suffix)
    return condition


def contains_any(text: Column, words) -> Column:
    condition = F.lit(False)
    for word in words:
        condition = condition | text.contains(word)
    return condition


def depth(path: Column) -> Column:
    """Number of path separators."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def mentions(text: Column, pattern: str, flags: str = "i") -> Column:
    return F.regexp_count(text, F.lit(regex(pattern, flags))).cast("bigint")

