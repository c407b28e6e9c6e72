"""Markdown of formatted text: runs of one format, paragraphs, list items, tables and whole documents, as column expressions.

A run is a struct (text, bold, italic, strike, font, link, image). An element is a struct (kind, level, ordered, runs, rows): kind is
``paragraph`` (level: of its heading, 0 for text), ``item`` (level: how deep), ``table`` (rows: lists of cells), ``rule`` or ``contents``.
Nulls are empty or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# fixed values: fonts that stand for code
CODE_FONTS = ("Courier New", "Consolas", "Roboto Mono")


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _is(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _between(mark: Column | str, text: Column) -> Column:
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.concat(mark, text, mark)


def run_text(run: Column, plain: bool | Column = False) -> Column:
    """A run with its marks; ``plain`` leaves out those of bold, italic and struck text, but not of code and links."""
    plain = F.lit(plain) if isinstance(plain, bool) else plain
    raw = F.regexp_replace(_some(run["text"]), r"\r\n?", "\n")
    code = _is(run["font"].isin(*CODE_FONTS))
    stars = F.when(plain, "").otherwise(F.concat(F.when(_is(run["bold"]), "**").otherwise(""), F.when(_is(run["italic"]), "*").otherwise("")))
    struck = F.when(~plain & _is(run["strike"]), "~~").otherwise("")
    text = F.when(code, _between("`", raw)).otherwise(F.regexp_replace(raw, r"([\\*_`\[\]])", r"\\$1"))
    marked = _between(struck, _between(stars, text))
    linked = F.when(_some(run["link"]) != "", F.concat(F.lit("["), marked, F.lit("]("), run["link"], F.lit(")"))).otherwise(marked)
    return F.when(_is(run["image"]), "![image]()").when(raw == "", "").otherwise(linked)


def inline(runs: Column, plain: bool | Column = False) -> Column:
    return _some(F.array_join(F.transform(runs, lambda r: run_text(r, plain)), ""))


def paragraph(level: Column, runs: Column) -> Column:
    """A paragraph, or the heading of its level (six at most); blank ones are empty."""
    level = F.least(F.coalesce(level, F.lit(0)), F.lit(6))
    text = inline(runs, level > 0)
    return F.when(strip(text) == "", "").when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)


def item(level: Column, ordered: Column, runs: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.coalesce(level, F.lit(0))), F.when(_is(ordered), "1. ").otherwise("- "), inline(runs))


def table(rows: Column) -> Column:
    """The first row is the head; line ends in cells become spaces, bars are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(_some(c), "\n", " "), r"\|", r"\\|")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(F.transform(r, cell)), F.lit("\n"), line(F.transform(r, lambda _: F.lit("---"))))).otherwise(line(F.transform(r, cell))))
    return _some(F.array_join(body, "\n"))


def element(e: Column) -> Column:
    """An element's text; null for kinds that have none."""
    return (
        F.when(e["kind"] == "paragraph", paragraph(e["level"], e["runs"]))
        .when(e["kind"] == "item", item(e["level"], e["ordered"], e["runs"]))
        .when(e["kind"] == "table", table(e["rows"]))
        .when(e["kind"] == "rule", "---")
        .when(e["kind"] == "contents", "<!-- Table of Contents -->")
    )


def document(elements: Column) -> Column:
    """A whole document: an element a line, no more than one blank line together."""
    joined = F.array_join(F.filter(F.transform(elements, element), lambda t: t.isNotNull()), "\n")
    return F.concat(strip(F.regexp_replace(joined, "\n{3,}", "\n\n")), F.lit("\n"))
