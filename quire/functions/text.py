"""Text expressions on columns; all stay in the JVM. Patterns follow Python's notion of white space and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide the results.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = ".!?:;”’)"
JOINING = ",;:)–—-”’"
PARA_NUMBER = rf"(?U)^(\d{{1,3}})\.{SPACE}+(?=[A-Z“‘(])"
HEADING_NUMBER = rf"(?U)^(\d+(?:\.\d+)*){SPACE}+([^\s\x1c-\x1f].*)$"
SECTION_NUMBER = rf"(?U)^\d+(\.\d+)+{SPACE}+[^\s\x1c-\x1f]"


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def dehyphenate(text: Column) -> Column:
    """Undoes hyphenation within a block: word character, hyphen, white space, lower-case Latin letter."""
    return F.regexp_replace(text, rf"(?U)([\p{{L}}\p{{N}}_])-{SPACE}+([a-zà-ÿ])", "$1$2")


def ends_in(text: Column, chars: str) -> Column:
    return F.right(text, F.lit(1)).isin(*chars)


def first(text: Column, n: int = 1) -> Column:
    return F.substring(text, 1, n)


def starts_lower(text: Column) -> Column:
    return first(text).rlike(r"^\p{IsLowercase}")


def strip_hyphens(text: Column) -> Column:
    return F.rtrim(text, F.lit("-"))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def para_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PARA_NUMBER, 1), F.lit(""))


def is_numbered(text: Column) -> Column:
    return text.rlike(PARA_NUMBER)


def join_lines(lines: Column) -> Column:
    """One string of an array of lines; a hyphen at a line's end goes when the next line starts in lower case."""
    clean = F.filter(F.transform(lines, collapse), lambda x: x != "")
    return F.aggregate(
        clean,
        F.lit(""),
        lambda out, line: F.when(ends_in(out, "-") & starts_lower(line), F.concat(F.left(out, F.length(out) - 1), line)).when(out != "", F.concat(out, F.lit(" "), line)).otherwise(line),
    )


def extracted_at() -> Column:
    """Run time, UTC, to seconds, as 2025-01-31T12:00:00+00:00."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
