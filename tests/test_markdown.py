"""Markdown to text: a case of each kind of block and mark, by hand."""

import pytest
from pyspark.sql import functions as F

from paritas.functions.markdown import inline, markdown_text, plain_text

BLOCKS = [
    ("# One #\n## Two\n####### seven", "One\nTwo\n####### seven"), ("Title\n=====\nSub\n---\ntext", "Title\nSub\ntext"), ("a\n\n***\n\n- - -\nb", "a\nb"), ("#no heading\n\n#", "#no heading"),
    ("> quoted\n> *more*\nlazy\n\n> > deep", "quoted\nmore\nlazy\ndeep"), ("- a\n- b\n  - c\n    1. d\n- e", "a\nb\nc\nd\ne"), ("1. one\n2) two\n\n   still two\n10. ten", "one\ntwo\nstill two\nten"),
    ("* a\n\n  ```\n  - code\n  ```\n* b", "a\n- code\nb"), ("```python\n# *not* a heading\n```\nafter", "# *not* a heading\nafter"), ("~~~\n```\n~~~", "```"), ("```\nnever closed\n# x", "never closed\n# x"),
    ("text\n\n    # code\n\n    more\nend", "text\n# code\n\nmore\nend"), ("| a | *b* |\n|---|:-:|\n| 1 \\| 2 | `x` |\nend", "a\tb\n1 | 2\tx\nend"), ("a | b\nno table", "a | b\nno table"),
    ("[id]: http://x 'title'\nsee [this][id] and [id] and [other]", "see this and id and [other]"), ("one\ntwo  \nthree\\\nfour", "one\ntwo\nthree\nfour"), ("a\r\nb\r\r c", "a\nb\nc"), ("", ""), ("   \n\t", ""), ("a\n- b", "a\nb"), ("year\n1986. was", "year\n1986. was"),
]
INLINE = [
    ("*a* **b** ***c*** _d_ __e__ ~~f~~", "a b c d e f"), ("2 * 3 * 4 and snake_case_name", "2 * 3 * 4 and snake_case_name"), ("**a *b* c**", "a b c"), ("*foo _bar* baz_", "foo _bar baz_"), (r"\*a\* \[b\] \\ \x", r"*a* [b] \ \x"),
    ("`a*b*` ``c`d`` `open", "a*b* c`d `open"), ("[a *b*](http://x(y) \"t\") ![pic](i.png) [c]()", "a b pic c"), ("<http://a.b> <x@y.org> <b>bold</b> a < b <!-- gone -->", "http://a.b x@y.org bold a < b "),
    ("&amp; &lt;&#233;&#xe9; &nothing", "& <éé &nothing"), ("[no link] [a](b c) !x", "[no link] [a](b c) !x"), ("*", "*"), ("a*", "a*"), ("日*本*語", "日本語"),
]


@pytest.mark.parametrize(("text", "expected"), BLOCKS)
def test_blocks(text, expected):
    assert plain_text(text) == expected


@pytest.mark.parametrize(("text", "expected"), INLINE)
def test_inline(text, expected):
    assert inline(text) == expected


def test_a_column_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BLOCKS)] + [(900, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", markdown_text(F.col("t")).alias("x")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(BLOCKS)} | {900: None}


def test_long_and_deep_texts():
    assert plain_text("> " * 40 + "x") == "x" and plain_text("*a* " * 3000).startswith("a a a")
    assert plain_text("[" * 60 + "x" + "]" * 60) == "[" * 60 + "x" + "]" * 60
