"""Formatted text as Markdown."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import markdown

RUN = "struct<text: string, bold: boolean, italic: boolean, strike: boolean, font: string, link: string, image: boolean>"
ELEMENT = f"struct<kind: string, level: int, ordered: boolean, runs: array<{RUN}>, rows: array<array<string>>>"


def run(text, bold=None, italic=None, strike=None, font=None, link=None, image=None):
    return (text, bold, italic, strike, font, link, image)


def of(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given,plain,want",
    [
        (run("a*b_[c]"), False, r"a\*b\_\[c\]"),
        (run("x", bold=True), False, "**x**"),
        (run("x", italic=True), False, "*x*"),
        (run("x", bold=True, italic=True, strike=True, link="u"), False, "[~~***x***~~](u)"),
        (run("x", bold=True, strike=True, link="u"), True, "[x](u)"),
        (run("a_b", font="Consolas", bold=True), False, "**`a_b`**"),
        (run("a_b", font="Arial"), True, r"a\_b"),
        (run("a\r\nb\rc"), False, "a\nb\nc"),
        (run(None, bold=True), False, ""),
        (run(None, image=True), False, "![image]()"),
    ],
)
def test_runs(spark, given, plain, want):
    assert of(spark, given, RUN, lambda x: markdown.run_text(x, plain)) == want


def test_tables(spark):
    assert of(spark, [["a|b", None], ["x\ny", "z"], []], "array<array<string>>", markdown.table) == "| a\\|b |  |\n| --- | --- |\n| x y | z |\n|  |"
    assert of(spark, [], "array<array<string>>", markdown.table) == ""


def test_documents(spark):
    elements = [
        ("paragraph", 1, None, [run("Title", bold=True)], None), ("paragraph", 0, None, [run(" ")], None), ("paragraph", None, None, None, None), ("paragraph", 0, None, [run("one "), run("two", italic=True)], None),
        ("item", 0, None, [run("a")], None), ("item", 2, True, [run("b")], None), ("rule", None, None, None, None), ("contents", None, None, None, None), ("odd", 1, None, [run("gone")], None), ("table", None, None, None, [["h"], ["c"]]), ("paragraph", 9, None, [run("deep")], None), ("paragraph", 0, None, [], None),
    ]
    want = "# Title\n\none *two*\n- a\n    1. b\n---\n<!-- Table of Contents -->\n| h |\n| --- |\n| c |\n###### deep\n"
    assert of(spark, elements, f"array<{ELEMENT}>", markdown.document) == want
    assert of(spark, [], f"array<{ELEMENT}>", markdown.document) == "\n"
