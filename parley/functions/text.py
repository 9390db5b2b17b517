"""String functions with Unicode white space and whole-match patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what counts as white space when trimming (fixed value)
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\p{Z}]"
#: the same characters, for Python: those named above, and all of Unicode's separators (categories Z*)
SPACE_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c)[0] == "Z")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def trim_end(x: Column) -> Column:
    return F.regexp_replace(x, rf"{SPACE}+\z", "")


def is_blank(x: Column) -> Column:
    """True for null, empty and white-space strings."""
    return F.coalesce(F.length(trim(x)) == 0, F.lit(True))


def upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000_000))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000_000))


def snake_to_pascal(x: Column) -> Column:
    """Parts between underscores, each with an upper first character; empty parts vanish."""
    return F.array_join(F.transform(F.filter(F.split(x, "_"), lambda p: p != ""), upper_first), "")


def snake_to_camel(x: Column) -> Column:
    return lower_first(snake_to_pascal(x))


def is_snake(x: Column) -> Column:
    return x.rlike(r"\A[a-z][a-z0-9_]*\z")


def is_pascal(x: Column) -> Column:
    return x.rlike(r"\A[A-Z][A-Za-z0-9]*\z")


def leading_spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.ltrim(x))


def lines(x: Column) -> Column:
    return F.split(F.regexp_replace(x, r"\r\n|\r", "\n"), "\n")


def replace_all(x: Column, values: dict[str, Column]) -> Column:
    """Literal replacements, one after the other in the order given."""
    for key, value in values.items():
        x = F.replace(x, F.lit(key), value)
    return x


def glob_pattern(glob: str) -> str:
    """A whole-match pattern: ** any folders, * within one, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return rf"\A{out}\z"
