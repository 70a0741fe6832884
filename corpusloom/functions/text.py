"""Text expressions; all of them are built-in functions and stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import SOLUTION_MARKER, SOLUTION_PATH


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_count(text: str | Column) -> Column:
    """Newlines plus one; null for null."""
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def occurrences(text: str | Column, sub: str) -> Column:
    """How often *sub* occurs without overlap; null for null."""
    t = _c(text)
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def head_lines(text: str | Column, n: int = 20) -> Column:
    """The first *n* lines of the text without white space at its ends."""
    return F.array_join(F.slice(F.split(F.regexp_replace(_c(text), r"^\s+|\s+$", ""), "\n"), 1, n), "\n")


def category(reason: str | Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(_c(reason), ":", 1)


def head(text: str | Column, n: int) -> Column:
    return F.left(_c(text), F.lit(n))


def tail(text: str | Column, n: int) -> Column:
    return F.right(_c(text), F.lit(n))


def first_filled(*texts: str | Column) -> Column:
    """The first text that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(_c(t), F.lit("")) for t in texts))


def record_name(number: str | Column, name: str | Column, prefix: str = "task", separator: str = "-") -> Column:
    """prefix-00042-name: the number padded to five digits (longer ones are kept), the name in lower case."""
    return F.concat(F.lit(prefix + separator), F.format_string("%05d", _c(number)), F.lit("-"), F.lower(_c(name)))


def replace_first(text: str | Column, old: str, new: str) -> Column:
    """*old* replaced once, at its first occurrence."""
    t = _c(text)
    at = F.instr(t, old)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit(new), F.substr(t, at + len(old)))).otherwise(t)


def record_number(task: str | Column) -> Column:
    """The number in a record name of either form, in any letter case and with white space around; null if none."""
    return F.nullif(F.regexp_extract(_c(task), r"^\s*[A-Za-z]+[-/](\d+)", 1), F.lit("")).cast("long")


def tidy_record_name(task: str | Column) -> Column:
    """A record name in lower case, with ``-`` throughout, without white space or a trailing `` 2``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(task))), r"\s+\d+$", ""), "/", "-")


def substitute(template: str, **values: str | Column) -> Column:
    """The template with each ``${name}`` replaced by a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), _c(value))
    return out


def wrap(text: str | Column, path: str = SOLUTION_PATH, marker: str = SOLUTION_MARKER) -> Column:
    """A shell script that writes the text to *path*."""
    return F.concat(F.lit(f"#!/bin/bash\ncat > {path} <<'{marker}'\n"), _c(text), F.lit(f"\n{marker}\n"))


def unwrap(script: str | Column, marker: str = SOLUTION_MARKER) -> Column:
    """What :func:`wrap` wrapped: from the first opening marker to the last closing one; null if there is none."""
    s, opening, closing = _c(script), f"<<'{marker}'\n", f"\n{marker}\n"
    first = F.instr(s, opening)
    last = F.length(s) - F.instr(F.reverse(s), closing[::-1]) + 1 - len(closing) + 1
    start = first + len(opening)
    return F.when((first > 0) & (F.instr(s, closing) > 0), F.substr(s, start, F.greatest(last - start, F.lit(0))))


def hash_bucket(text: str | Column, n: int) -> Column:
    """The SHA-256 of the text as one integer, modulo *n*, by folding its hexadecimal digits."""
    digits = F.split(F.sha2(_c(text), 256), "")
    digits = F.filter(digits, lambda d: d != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("long")) % n)
