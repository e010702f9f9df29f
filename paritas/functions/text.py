"""Scalar text and array functions as column expressions."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_division(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def split_list(cell: Column, separator: str = ",") -> Column:
    """Trimmed, lower-cased, non-empty, sorted items of a list cell."""
    items = F.transform(F.split(cell, separator), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.filter(items, lambda x: x != ""))


def join_groups(values: Column) -> Column:
    return F.concat_ws(" & ", F.array_sort(values))


def split_groups(cell: Column) -> Column:
    return F.filter(F.split(cell, " & "), lambda x: x != "")


def decode(value: Column, table: dict) -> Column:
    """Values by a small table; others give null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)@(\w+)"), F.lit(1))


def clean_values(values: Column) -> Column:
    """Distinct last parts of property values, without empty ones, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: last_part(v)), lambda v: v != "")))


def last_part(uri: Column, title: bool = True) -> Column:
    """What follows the last slash, each word capitalised."""
    part = F.substring_index(uri, "/", -1)
    return F.initcap(part) if title else part


def strip_suffix(name: Column, suffix: str = "_databias_generated") -> Column:
    return F.regexp_replace(name, F.lit(suffix + "$"), F.lit(""))


def bracketed(label: Column, most: int = 18, kept: int = 15) -> Column:
    """The text between square brackets (or all of it), cut to `kept` characters and dots if over `most`."""
    inner = F.regexp_extract(label, r"\[([^\]]*)\]", 1)
    text = F.when(inner == "", label).otherwise(inner)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(kept)), F.lit("..."))).otherwise(text)


def spanish_endings(text: Column) -> Column:
    """doctor/a -> doctor / doctora, amigos/as -> amigos / amigas."""
    with_r = F.regexp_replace(text, r"(?U)(\b\w+?)r/(as?)\b", "$1r / $1r$2")
    return F.regexp_replace(with_r, r"(?U)(\b\w+?)(es|os|e|o)/(as?)\b", "$1$2 / $1$3")


#: What precedes the slash, what follows it, and the feminine ending that is written out, in the order in which they apply.
CATALAN_ENDINGS = [("or", "a", "ora"), ("r", "a", "ra"), ("e", "a", "a"), ("o", "a", "a"), ("s", "as", "ses")]
#: A word's end, or marks after it; both come back as they were.
_CATALAN_END = r"(\b|\s*[\.,;:\?!])"


def catalan_endings(text: Column) -> Column:
    """amic/a -> amic o amica, mestre/a -> mestre o mestra; what no ending of the table fits is kept whole before the slash."""
    for stem, short, feminine in CATALAN_ENDINGS:
        text = F.regexp_replace(text, rf"(?U)(\b\w+?){stem}/{short}{_CATALAN_END}", f"$1{stem} o $1{feminine}$2")
    return F.regexp_replace(text, rf"(?U)(\b\w+?)/([a|as]){_CATALAN_END}", "$1 o $1$2$3")


def strip_markup(html: Column) -> Column:
    """Plain text of HTML: scripts, styles and tags go, common entities are decoded, white space is joined."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def markdown_to_text(text: Column) -> Column:
    """Markdown without its marks, then without markup."""
    for pattern, replacement in (
        (r"(?m)^\s*```.*$", ""),
        (r"(?m)^\s{0,3}#{1,6}\s*", ""),
        (r"(?m)^\s{0,3}>\s?", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__)(.+?)\1", "$2"),
        (r"(?<!\w)[*_](.+?)[*_](?!\w)", "$1"),
        (r"`([^`]*)`", "$1"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return strip_markup(text)


def parse_annotations(cell: Column) -> Column:
    """Lines 'word - S,M' as (word, is_person, gender); S or N says whether it is a person, M or F the gender; others are left out."""
    def parsed(line: Column) -> Column:
        word = F.trim(F.regexp_extract(line, r"^(.*) - \s*([SN])\s*,\s*([MF])\s*$", 1))
        person = F.regexp_extract(line, r"^(.*) - \s*([SN])\s*,\s*([MF])\s*$", 2)
        gender = F.regexp_extract(line, r"^(.*) - \s*([SN])\s*,\s*([MF])\s*$", 3)
        return F.struct(word.alias("word"), (person == "S").alias("is_person"), F.when(gender == "M", "male").when(gender == "F", "female").alias("gender"))

    return F.filter(F.transform(F.split(cell, r"\R"), parsed), lambda a: a["gender"].isNotNull())


def parse_stories(cell: Column, n: int = 4) -> Column:
    """The n texts of a JSON list, without their 'Story k: '; null if there are more or fewer."""
    bare = F.transform(F.from_json(cell, "array<string>"), lambda s: F.regexp_replace(s, r"^\s*Story \d+:\s*", ""))
    return F.when(F.size(bare) == n, bare)


def literal_list(cells):
    """Python list literals as JSON lists (for parse_stories); literals are read, never run.  A pandas function."""
    def convert(cell):
        try:
            return json.dumps(ast.literal_eval(cell)) if cell is not None else None
        except (ValueError, SyntaxError):
            return None

    def run(s: pd.Series) -> pd.Series:
        return s.map(convert)

    return F.pandas_udf(run, "string")(cells)


#: Tags of a story's words, plain and full-width; N words count for nobody.
STORY_TAGS = {"M": "male", "Ｍ": "male", "F": "female", "Ｆ": "female"}
NEUTRAL_TAGS = ("N", "Ｎ")
#: What parts a word from its tag: one of four marks with white space on one side of it at least.
_TAG_MARK = r"\s?[-‑–=]\s|\s[-‑–=]\s?"


def story_annotations(text: Column) -> Column:
    """Lines 'word - M' of a story as (word, include, group): F and M words of a group, N words left out; other lines are dropped.

    A line counts if its first mark is its only one of that kind.
    """
    def parsed(line: Column) -> Column:
        mark = F.regexp_extract(line, f"({_TAG_MARK})", 1)
        parts = F.when(mark != "", F.split(line, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1))
        two = F.size(parts) == 2
        tag = F.when(two, F.upper(F.trim(F.get(parts, F.lit(1)))))
        group = F.try_element_at(F.create_map(*[F.lit(x) for pair in STORY_TAGS.items() for x in pair]), tag)
        known = group.isNotNull() | tag.isin(*NEUTRAL_TAGS)
        return F.struct(known.alias("known"), F.trim(F.get(parts, F.lit(0))).alias("word"), group.isNotNull().alias("include"), group.alias("group"))

    rows = F.filter(F.transform(F.split(text, r"\R"), parsed), lambda a: a["known"])
    return F.transform(rows, lambda a: F.struct(a["word"].alias("word"), a["include"].alias("include"), a["group"].alias("group")))


def skipped_annotations(text: Column) -> Column:
    """The lines of a story that story_annotations drops, blank ones left out: what a reader would be warned of."""
    def dropped(line: Column) -> Column:
        return (F.size(story_annotations(line)) == 0) & (F.trim(line) != "")

    return F.filter(F.split(text, r"\R"), dropped)
