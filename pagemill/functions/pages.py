"""What a page's blocks say of it: tables, clauses, headings, fonts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import strip

# How a numbered clause begins a line.
CLAUSE_LINES = [r"^\s*\d+\.\s", r"^\s*\d+\.\d+\s", r"^\s*\d+\.\d+\.\d+\s", r"^\s*[A-Z]\.\s", r"^\s*[IVX]+\.\s"]


def clean_table(text: Column, limit: int = 500) -> Column:
    """Control characters out, runs of blanks before a blank as one; at most
    limit characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.left(F.regexp_replace(t, r"[ \t]+(?=[ \t])", " "), F.lit(limit))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _indented(text: Column, first: int | None) -> Column:
    """Three lines or more whose indents differ by five or more."""
    raw = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    depth = F.transform(raw if first is None else F.slice(raw, 1, first), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", "")))
    some = F.filter(depth, lambda d: d > 0)
    return (F.size(raw) >= 3) & (F.size(some) >= 2) & (F.array_max(some) - F.array_min(some) >= 5)


def table_method(text: Column, raw_indent: bool = False) -> Column:
    """How a block shows itself as a table: tab_separated (two lines with a tab
    within, thirty characters in all), or, if raw_indent, aligned_columns (by
    default lines are stripped first and never differ); else null."""
    lines = _lines(text)
    able = (F.size(lines) >= 2) & (F.length(strip(text)) >= 30)
    tabbed = F.size(F.filter(lines, lambda x: x.contains("\t"))) >= 2
    out = F.when(able & tabbed, "tab_separated")
    return out.when(able & _indented(text, None), "aligned_columns") if raw_indent else out


def looks_tabular(text: Column, raw_indent: bool = False) -> Column:
    """The page inspection's looser test: two lines, one with a tab within."""
    lines = _lines(text)
    tabbed = F.exists(lines, lambda x: x.contains("\t"))
    return F.coalesce((F.size(lines) >= 2) & (tabbed | (_indented(text, 6) if raw_indent else F.lit(False))), F.lit(False))


def has_clauses(text: Column) -> Column:
    """A line that begins like a numbered clause."""
    return F.coalesce(F.concat(text, F.lit("\n")).rlike("(?m)(" + "|".join(CLAUSE_LINES) + ")"), F.lit(False))


def has_heading_line(text: Column) -> Column:
    """A line in capitals of 4 to 79 characters."""
    caps = lambda x: (F.length(x) < 80) & (F.length(x) > 3) & (F.upper(x) == x) & (F.lower(x) != x)
    return F.coalesce(F.exists(_lines(text), caps), F.lit(False))


def font_list(names: Column) -> Column:
    """Fonts by name; a page's list tells neither size nor use."""
    return F.transform(names, lambda n: F.struct(F.coalesce(n, F.lit("unknown")).alias("name"), F.lit(12.0).alias("size"), F.lit(0).alias("count"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))


def without_nulls(properties: Column) -> Column:
    """A file's properties that are set."""
    return F.map_filter(properties, lambda k, v: v.isNotNull())
