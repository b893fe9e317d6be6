"""Column builders for text: lines, stripping, tokens, headers, math density, identities.

All are built-in expressions, so they stay in the JVM and take whole texts.
White space is what Python's ``str.isspace`` takes for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1C-\x1F]"
NOT_WS = r"[^\s\x1C-\x1F]"

# A line that holds one of these is a line of mathematics.
MATH_MARKERS = [
    "\\\\", "\\frac", "\\sum", "\\prod", "\\int", "\\mathbb", "\\mathcal", "\\operatorname", "\\oplus", "\\odot", "\\oslash", "\\otimes",
    "\\in", "\\to", "\\mapsto", "\\coloneqq", "\\leq", "\\geq", "\\neq", "\\subseteq", "^{", "_{",
]
# Fixed value: one dollar sign, text, one dollar sign.
INLINE_MATH = r"(?s)(?<!\$)\$(?!\$).+?\$(?!\$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def unified(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def file_lines(text: Column) -> Column:
    """Lines of a file read in text mode, without their ends; a null or empty text has none."""
    parts = F.split(unified(F.coalesce(text, F.lit(""))), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def joined(lines: Column, first: Column, last: Column, sep: str = "\n") -> Column:
    """Lines ``first`` to ``last`` (from 1, both included) as one text."""
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), sep)


def blank(line: Column) -> Column:
    return ~F.regexp_like(line, F.lit(rf"(?U){NOT_WS}"))


def n_tokens(line: Column) -> Column:
    return F.regexp_count(line, F.lit(rf"(?U){NOT_WS}+"))


def is_header(line: Column) -> Column:
    """One to six # signs, white space and a title."""
    return F.regexp_like(line, F.lit(rf"(?U)\A{WS}*#{{1,6}}{WS}+{NOT_WS}"))


def header_title(line: Column) -> Column:
    return F.regexp_extract(strip(line), rf"(?sU)\A#{{1,6}}{WS}+(.*)", 1)


def starts_display(line: Column) -> Column:
    return F.regexp_like(line, F.lit(rf"(?U)\A{WS}*\$\$"))


def math_density(text: Column) -> Column:
    """Share of lines that open, close or stand in a $$ block, hold $…$ or a marker."""
    marker = "|".join("\\Q" + m + "\\E" for m in MATH_MARKERS)

    def step(acc: Column, line: Column) -> Column:
        display = starts_display(line)
        hit = display | acc["inside"] | F.regexp_like(strip(line), F.lit(INLINE_MATH)) | F.regexp_like(line, F.lit(marker))
        return F.struct((acc["inside"] != display).alias("inside"), (acc["n"] + hit.cast("int")).alias("n"))

    def share(lines: Column) -> Column:
        return F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")), step, lambda a: a["n"] / F.size(lines))

    return let(F.split(text, "\n", -1), share)


def uuid_text(name: Column) -> Column:
    """The md5 of a name in the 8-4-4-4-12 form."""
    return F.regexp_replace(F.md5(name.cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def point_id(path: Column, chunk_type: Column, start: Column, end: Column) -> Column:
    """Identity of a stored chunk: its place, not its text."""
    return uuid_text(F.concat_ws(":", path, chunk_type, F.concat_ws("-", start.cast("string"), end.cast("string"))))


def chunk_id(path: Column, chunk_type: Column, start: Column, end: Column, symbol: Column) -> Column:
    """Stable across runs, so that links from methods to their class survive a new ingest."""
    return uuid_text(F.concat_ws(":", path, chunk_type, start.cast("string"), end.cast("string"), F.coalesce(symbol, F.lit(""))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def suffix(name: Column) -> Column:
    """Extension with its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(name, r"(?s)[^.].*(\.[^.]+)$", 1)
