"""Documents with every case that an operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

LINE = "This very line is found in many documents, Really."
PASSAGE = "a passage that is long enough to be found again, since it has far more than one hundred bytes in it, and then some more of them. "


def texts(seed: int = 1, n: int = 40) -> list:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(300)]
    def prose(k: int) -> str:
        return " ".join(r.choice(words) for _ in range(k))
    out = [prose(r.randint(1, 120)) for _ in range(n)]
    out += [None, "", "   \n\t ", "x", "42 17 !", "\n\n", prose(4000), "ab" * 1500, "tie\n" * 50]
    out += [f"{prose(5)}\n  {LINE} \n{prose(5)}", f"{LINE.upper()}\n{prose(3)}\n{LINE}", f"{prose(9)}\n{LINE}\x0b", LINE]
    out += [prose(30) + PASSAGE + prose(30), PASSAGE + prose(10), prose(10) + " " + PASSAGE * 3]
    base = prose(90)
    return [*out, base, base, base + " more", "other " + base, base.upper()]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `__text` string, `key` long, uid long, kept int, fp double"


def rows(unique: bool = False, **options) -> list:
    """(doc_id, text, lang, ...); unless unique, some ids are null or given twice, and a row is repeated."""
    made = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "a", None, 3, i, None, float(i)) for i, t in enumerate(texts(**options))]
    if unique:
        return made
    nulls = [(None, made[1][1], "en", None, None, *made[0][5:]), (None, None, None, None, None, *made[0][5:])]
    return [*made, made[2], (3, "another text of the same id", "de", "s", 1, *made[0][5:]), *nulls]


def documents(spark, unique: bool = False, **options):
    return spark.createDataFrame(rows(unique, **options), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
