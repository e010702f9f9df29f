"""Text bias scores: distance-weighted co-occurrence of words with group seeds.

Tokens stay in one array per paragraph, so that a context window is a slice and
nothing is shuffled before the aggregate.  A paragraph's seeds are found inside its
array, so only they are exploded, window by window, from pieces of bounded length.
Columns of a token table: doc_id, par_id, tokens
(array<struct<word, pos>>; with morphology also gender, definite).

A lexicon is a small literal {group: words} or {group: {pos: words}}; per-text
lexicons come as an array column of (word, include, grp).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCRETE = 0.05
EPSILON = 2.0**-52
CUT_POS = ("PUNCT", "NUM", "SYM")
#: Factors by which punctuation weakens a continual context.
PUNCTUATION = {".": 0.25, "¿": 0.25, "?": 0.25, "¡": 0.25, "!": 0.25, ";": 0.5, "«": 0.5, "»": 0.5, "(": 0.5, ")": 0.5, "[": 0.5, "]": 0.5, "...": 0.75, ",": 0.75, ":": 0.75, "-": 0.75, "•": 0.75, "/": 0.9}


# --- tokens ---------------------------------------------------------------------------------------------------------


def paragraphs(df: DataFrame, text: str = "text", merge: bool = False) -> DataFrame:
    """A row for each line of each text (par_id from 0), or the text as one."""
    if merge:
        return df.withColumn("par_id", F.lit(0)).withColumn("paragraph", F.col(text))
    return df.select("*", F.posexplode(F.split(text, r"\R")).alias("par_id", "paragraph"))


def regex_tokens(df: DataFrame, paragraph: str = "paragraph", pattern: str = r"\p{L}+|[0-9]+|[.,;:!?]", pos_of: Mapping[str, str] | None = None) -> DataFrame:
    """tokens of lower-cased paragraphs; part of speech: PUNCT, NUM, that of pos_of, or X."""
    return df.withColumn("tokens", F.transform(_found(paragraph, pattern), _token_of(pos_of)))


def regex_rows(df: DataFrame, paragraph: str = "paragraph", pattern: str = r"\p{L}+|[0-9]+|[.,;:!?]", pos_of: Mapping[str, str] | None = None) -> DataFrame:
    """The tokens of regex_tokens as rows, seed in the paragraph's place: for what looks at each token alone."""
    rows = df.select(*[c for c in df.columns if c != paragraph], F.explode(_found(paragraph, pattern)).alias("__w"))
    return rows.withColumn("seed", _token_of(pos_of)(F.col("__w"))).drop("__w")


def _found(paragraph: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(f"({pattern})"), F.lit(0))


def _token_of(pos_of: Mapping[str, str] | None):
    known = F.create_map(*[F.lit(x) for pair in pos_of.items() for x in pair]) if pos_of else None

    def token(w: Column) -> Column:
        other = F.coalesce(F.try_element_at(known, w), F.lit("X")) if pos_of else F.lit("X")
        latin = (w >= "a") & (w < "{")  # begins with a letter a to z, so it's neither
        return F.struct(w.alias("word"), F.when(latin, other).when(w.rlike(r"^\p{Nd}+$"), "NUM").when(w.rlike(r"^\p{Punct}+$"), "PUNCT").otherwise(other).alias("pos"))

    return token


def lexical_form(text: Column, lower: Column, lemma: Column, pos: Column, group_words: Sequence[str], use_root: bool = True, keep_proper: bool = True) -> Column:
    """The form a token counts under: itself as a group word or proper noun, else lower case, else its lemma."""
    words = F.array(*map(F.lit, group_words)) if group_words else F.array().cast("array<string>")
    kept = F.array_contains(words, text) | (pos == "PROPN" if keep_proper else F.lit(False))
    as_lower = pos.isin("PRON", "DET") | F.array_contains(words, lower) | F.array_contains(words, F.lower(lemma)) | F.lit(not use_root)
    return F.when(kept, text).when(as_lower, lower).otherwise(F.lower(lemma))


# --- lexicons -------------------------------------------------------------------------------------------------------


def lexicon_rows(lexicon: Mapping[str, Sequence[str] | Mapping[str, Sequence[str]]]) -> list[tuple[str, str | None, str]]:
    """(group, part of speech or None, word), groups in their order, without repeats."""
    rows = []
    for group, words in lexicon.items():
        for pos, some in words.items() if isinstance(words, Mapping) else [(None, words)]:
            rows += [(group, pos, w) for w in some]
    return list(dict.fromkeys(rows))


def groups_of(token: Column, lexicon) -> Column:
    """The groups whose lexicon has the token, in their order."""
    by_group: dict[str, list] = {}
    for row in lexicon_rows(lexicon):
        by_group.setdefault(row[0], []).append(row)
    return F.array_compact(F.array(*[F.when(_listed(token, rows), F.lit(g)) for g, rows in by_group.items()]))


def in_lexicon(token: Column, lexicon) -> Column:
    """Whether any group's lexicon has the token."""
    return _listed(token, lexicon_rows(lexicon))


def _listed(token: Column, rows: Sequence[tuple[str, str | None, str]]) -> Column:
    by_pos: dict[str | None, list[str]] = {}
    for _, pos, word in rows:
        by_pos.setdefault(pos, []).append(word)
    hit = F.lit(False)
    for pos, words in by_pos.items():
        known = token["word"].isin(*dict.fromkeys(words))
        hit = hit | (known if pos is None else known & (token["pos"] == pos))
    return hit


def included_words(annotation: Column) -> Column:
    """Of a per-text lexicon: the (word, grp) that are included."""
    return F.transform(F.filter(annotation, lambda a: a["include"]), lambda a: F.struct(a["word"].alias("word"), a["grp"].alias("grp")))


def own_entries(annotation: Column, groups: Sequence[str]) -> Column:
    """included_words of a per-text lexicon; a group that isn't one of groups stops the job."""
    return F.transform(included_words(annotation), lambda a: F.struct(a["word"].alias("word"), _expected(a["grp"], groups).alias("grp")))


def _expected(grp: Column, groups: Sequence[str]) -> Column:
    return F.when(grp.isin(*groups), grp).otherwise(F.raise_error(F.concat(F.lit("a text's lexicon names an unknown group: "), grp)).cast("string"))


def group_words(lexicon) -> list[str]:
    return list(dict.fromkeys(w for _, _, w in lexicon_rows(lexicon)))


# --- contexts -------------------------------------------------------------------------------------------------------


def fixed(width: int = 10) -> tuple[int, object]:
    """Every token within width, the centre too, weighs 1."""
    return width, lambda d: F.lit(1.0)


def infinite(step: float = 0.95, width: int = 200) -> tuple[int, object]:
    """The centre weighs 1, distance d weighs step ** (d - 1)."""
    return width, lambda d: F.when(d == 0, 1.0).otherwise(F.pow(F.lit(step), F.abs(d) - 1))


def continual(step: float = 0.95, width: int = 200) -> tuple[int, object]:
    """To the left, distance d weighs step ** (d - 1); from the centre to the right step ** d."""
    return width, lambda d: F.when(d < 0, F.pow(F.lit(step), -d - 1)).otherwise(F.pow(F.lit(step), d))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column, block: int = 128) -> Column:
    """Sums of the values before each place and, last, of all: block by block, so that a paragraph costs its length times a block."""
    total = lambda some: F.aggregate(some, F.lit(0.0), lambda t, x: t + x)

    def of(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(held) / block).cast("int")), lambda b: total(F.slice(held, b * block + 1, block)))
        starts = F.aggregate(blocks, F.array(F.lit(0.0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
        return _let(starts, lambda at: F.transform(F.sequence(F.lit(0), F.size(held)), lambda i: F.get(at, F.floor(i / block).cast("int")) + total(F.slice(held, i - i % block + 1, i % block))))

    return _let(values, of)


def punctuated(tokens: Column, step: float = 0.95) -> Column:
    """Logarithms of the running product of factors before each token: the intended, punctuation-aware weights."""
    factors = F.create_map(*[F.lit(x) for pair in PUNCTUATION.items() for x in pair])
    return running_sums(F.transform(tokens, lambda t: F.log(F.coalesce(F.try_element_at(factors, t["word"]), F.lit(step)))))


# --- counts ---------------------------------------------------------------------------------------------------------

#: Tokens of a paragraph that are looked through for seeds at once.
PIECE = 1024


def pieces(tokens: DataFrame, width: int, size: int | None = None) -> DataFrame:
    """Token table with long paragraphs cut: each row has `size` tokens whose seeds are its own, from low to high, and their neighbours within width."""
    size = size or PIECE
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(size)), lambda at: _piece(at, width, size))
    return tokens.select(*[c for c in tokens.columns if c != "tokens"], F.explode(cut).alias("__p")).select("*", "__p.*").drop("__p")


def _piece(at: Column, width: int, size: int) -> Column:
    start = F.greatest(at - width, F.lit(0))
    return F.struct(F.slice("tokens", start + 1, at - start + size + width).alias("tokens"), (at - start).alias("low"), (at - start + size).alias("high"))


def _places(tokens: DataFrame, hit) -> Column:
    """Places (from 0) of the tokens that hit; of a piece, its own ones."""
    inside = (lambda i: (i >= F.col("low")) & (i < F.col("high"))) if "low" in tokens.columns else lambda i: F.lit(True)
    return F.array_compact(F.transform("tokens", lambda t, i: F.when(hit(t) & inside(i), i)))


def seeds(tokens: DataFrame, lexicon, person: Column | None = None, agree: Mapping[str, str] | None = None) -> DataFrame:
    """A row per seed and group: tokens, centre (from 0), grp, agrees.

    person: a check on the token struct column `seed`; agree: curated words' groups,
    for agreement with the words to the left (needs gender and definite in tokens).
    """
    out = tokens.select("*", F.explode(_places(tokens, lambda t: in_lexicon(t, lexicon))).alias("centre")).withColumn("seed", F.get("tokens", F.col("centre")))
    out = out.select("*", F.explode(groups_of(F.col("seed"), lexicon)).alias("grp"))
    if person is not None:
        out = out.where(person)
    if agree is None:
        return out.withColumn("agrees", F.lit(True))
    pivot = left_gender(F.col("tokens"), F.col("centre"), agree)
    return out.withColumn("agrees", F.coalesce(pivot == F.col("grp"), F.lit(True)))


def left_gender(tokens: Column, centre: Column, curated: Mapping[str, str]) -> Column:
    """The first gender to the left, walking over adjectives, definite determiners and curated words only; null: none."""
    known = F.create_map(*[F.lit(x) for pair in curated.items() for x in pair]) if curated else F.create_map(F.lit(""), F.lit(None).cast("string"))
    left = F.reverse(F.slice(tokens, 1, centre))
    start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("string").alias("gender"))

    def walk(state: Column, t: Column) -> Column:
        chains = (t["pos"].isin("ADJ", "DET") & ~F.coalesce(t["definite"].endswith("ind"), F.lit(False))) | F.map_contains_key(known, t["word"])
        own = F.coalesce(F.try_element_at(known, t["word"]), F.when(t["gender"].endswith("fem"), "female").when(t["gender"].endswith("masc"), "male"))
        on = state["on"] & state["gender"].isNull() & chains
        return F.struct(on.alias("on"), F.when(on, own).otherwise(state["gender"]).alias("gender"))

    return F.aggregate(left, start, walk, lambda s: s["gender"])


def is_counted(token: Column) -> Column:
    """Whether a context counts the token: punctuation, numbers and symbols aren't counted."""
    digits = token["word"].between("0", ":") | ~token["word"].between(" ", "~")  # else no digit is first
    return ~token["pos"].isin(*CUT_POS) & ~(digits & token["word"].rlike(r"^\p{Nd}+$"))


def contexts(seeded: DataFrame, context=None, punctuation: bool = False, step: float = 0.95) -> DataFrame:
    """A row per seed, group and counted context token: grp, word, pos, weight, d (place minus the centre's)."""
    width, weight = context or continual()
    start = F.greatest(F.col("centre") - width, F.lit(0))
    window = F.slice("tokens", start + 1, F.col("centre") + width - start + 1)
    if punctuation and "logs" not in seeded.columns:
        seeded = seeded.withColumn("logs", punctuated(F.col("tokens"), step))
    columns = ["grp", "centre", start.alias("start"), *(["logs"] if punctuation else [])]
    near = seeded.where("agrees").select(*columns, F.posexplode(window).alias("k", "token"))
    at = F.col("start") + F.col("k")
    d = at - F.col("centre")
    if punctuation:
        log = lambda i: F.get("logs", i)
        w = F.when(d < 0, F.exp(log(F.col("centre")) - log(at + 1))).otherwise(F.exp(log(at) - log(F.col("centre"))))
    else:
        w = weight(d)
    return near.where(is_counted(F.col("token"))).select("grp", F.col("token.word").alias("word"), F.col("token.pos").alias("pos"), w.alias("weight"), d.alias("d"))


def bias_counts(tokens: DataFrame, lexicon, context=None, **options) -> DataFrame:
    """Per word and part of speech: weighted count_<group> and discrete_<group> of each group (0 if never met)."""
    punctuation = options.get("punctuation", False)
    if punctuation:  # once a paragraph, not once a seed
        tokens = tokens.withColumn("logs", punctuated(F.col("tokens")))
    elif options.get("agree") is None:
        tokens = pieces(tokens, (context or continual())[0])
    rows = contexts(seeds(tokens, lexicon, options.get("person"), options.get("agree")), context, punctuation)
    return counts_of(rows, list(dict.fromkeys(g for g, _, _ in lexicon_rows(lexicon))))


def all_counts(tokens: DataFrame, lexicon, context=None) -> DataFrame:
    """bias_counts with global_counts beside it, from one reading of the tokens: a piece's own tokens are one more window, of no group."""
    width, weight = context = context or continual()
    groups = list(dict.fromkeys(g for g, _, _ in lexicon_rows(lexicon)))
    cut = pieces(tokens, width)
    places = _places(cut, lambda t: in_lexicon(t, lexicon))

    def window(i: Column) -> Column:
        start = F.greatest(i - width, F.lit(0))
        return F.struct(groups_of(F.get("tokens", i), lexicon).alias("grps"), (start - i).alias("first"), F.slice("tokens", start + 1, i + width - start + 1).alias("near"))

    own = F.struct(F.lit(None).cast("array<string>").alias("grps"), F.lit(0).alias("first"), F.slice("tokens", F.col("low") + 1, F.col("high") - F.col("low")).alias("near"))
    windows = cut.select(F.explode(F.concat(F.array(own), F.transform(places, window))).alias("w")).select(F.col("w.grps").alias("grps"), F.col("w.first").alias("first"), F.posexplode("w.near").alias("k", "token"))
    rows = windows.where(F.col("grps").isNull() | is_counted(F.col("token")))
    rows = rows.select("grps", F.col("token.word").alias("word"), F.col("token.pos").alias("pos"), F.when(F.col("grps").isNotNull(), weight(F.col("first") + F.col("k"))).alias("weight"))
    of = lambda g: F.coalesce(F.array_contains("grps", g), F.lit(False))
    aggs = [F.sum(F.when(of(g), F.col("weight")).otherwise(0.0)).alias(f"count_{g}") for g in groups]
    aggs += [F.count_if(of(g) & (F.col("weight") > DISCRETE)).alias(f"discrete_{g}") for g in groups]
    met = F.count_if(F.col("grps").isNotNull()).alias("__met")
    return rows.groupBy("word", "pos").agg(*aggs, F.count_if(F.col("grps").isNull()).alias("global_count"), met).where("__met > 0").drop("__met")


def counts_of(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """From contexts: count_<group> and discrete_<group> per word and part of speech."""
    aggs = [F.sum(F.when(F.col("grp") == g, F.col("weight")).otherwise(0.0)).alias(f"count_{g}") for g in groups]
    aggs += [F.count_if((F.col("grp") == g) & (F.col("weight") > DISCRETE)).alias(f"discrete_{g}") for g in groups]
    return rows.groupBy("word", "pos").agg(*aggs)


def group_counts(tokens: DataFrame, lexicon, person: Column | None = None, agree: Mapping[str, str] | None = None) -> DataFrame:
    """Seeds of each group that is met: grp, n, ratio to the smallest.

    tokens: a token table, or its tokens as rows (regex_rows).  person: as for seeds(); agree makes no difference, seeds are counted before it.
    Each token is looked at alone, so no paragraph is cut or carried along; a lexicon's words are counted before their groups are listed.
    """
    rows = tokens if "tokens" not in tokens.columns else tokens.select(*[c for c in tokens.columns if c != "tokens"], F.explode("tokens").alias("seed"))
    hits = rows.where(in_lexicon(F.col("seed"), lexicon))
    if person is not None:
        hits = hits.where(person)
    by_word = hits.groupBy(F.col("seed.word").alias("word"), F.col("seed.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    met = by_word.select("n", F.explode(groups_of(F.struct("word", "pos"), lexicon)).alias("grp"))
    counted = met.groupBy("grp").agg(F.sum("n").alias("n"))
    all_groups = Window.partitionBy(F.lit(0))  # a row for each group of the lexicon
    return counted.select("grp", "n", (F.col("n") / F.min("n").over(all_groups)).alias("ratio"))


def simple_scores(tokens: DataFrame, lexicon, **options) -> DataFrame:
    """group_counts with a zero for groups never met when no seed is found at all."""
    groups = list(dict.fromkeys(g for g, _, _ in lexicon_rows(lexicon)))
    met = group_counts(tokens, lexicon, **options)
    every = tokens.sparkSession.createDataFrame([(g,) for g in groups], "grp string")
    none = every.join(met.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti")
    return met.unionByName(none.select("grp", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("ratio")))


def global_counts(tokens: DataFrame) -> DataFrame:
    """How often each (word, pos) occurs anywhere."""
    return tokens.select(F.explode("tokens").alias("t")).groupBy(F.col("t.word").alias("word"), F.col("t.pos").alias("pos")).agg(F.count(F.lit(1)).alias("global_count"))


def drop_words(counts: DataFrame, stopwords: DataFrame | None = None, group_word_table: DataFrame | None = None, inspect: DataFrame | None = None) -> DataFrame:
    """Without stop words, and without group words that aren't to be inspected (each a table with a column word)."""
    out = counts if stopwords is None else counts.join(stopwords.select("word").distinct(), "word", "left_anti")
    if group_word_table is not None:
        gone = group_word_table.select("word").distinct()
        out = out.join(gone if inspect is None else gone.join(inspect.select("word").distinct(), "word", "left_anti"), "word", "left_anti")
    return out


def merge_lemmas(counts: DataFrame, lemmas: DataFrame, inspect: DataFrame | None = None) -> DataFrame:
    """Counts summed under lemmas (table word, lemma); only words to be inspected are re-keyed if a list is given."""
    chosen = lemmas if inspect is None else lemmas.join(inspect.select("word").distinct(), "word", "left_semi")
    keyed = counts.join(chosen.dropDuplicates(["word"]), "word", "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")
    numbers = [c for c in keyed.columns if c not in ("word", "pos")]
    return keyed.groupBy("word", "pos").agg(*[F.sum(c).alias(c) for c in numbers])


# --- scores ---------------------------------------------------------------------------------------------------------


def count_disparity(counts: Sequence[Column]) -> Column:
    """1 if a group is never met, else 1 - least / greatest."""
    low, high = F.least(*counts), F.greatest(*counts)
    return F.when(low == 0, 1.0).otherwise(1 - low / high)


def log_score(first: Column, second: Column, first_total: Column, second_total: Column) -> Column:
    share = lambda c, total: F.coalesce(F.try_divide(c, total), F.lit(0.0)) + EPSILON
    return F.log2(share(first, first_total) / share(second, second_total))


def bias_scores(counts: DataFrame, groups: Sequence[str], discrete: bool = False) -> DataFrame:
    """counts with count_disparity and, for two groups, log_score over the totals of the kept words.

    For two groups the counts, a row for each word, are written to the shared folder first: the totals and the rows read them.
    """
    kind = "discrete" if discrete else "count"
    cols = [F.col(f"{kind}_{g}").cast("double") for g in groups]
    if len(groups) == 2:
        counts = _written(counts)
    out = counts.withColumn("count_disparity", count_disparity(cols))
    if len(groups) != 2:
        return out
    totals = counts.agg(*[F.sum(c).alias(f"__total{i}") for i, c in enumerate(cols)])
    return out.crossJoin(F.broadcast(totals)).withColumn("log_score", log_score(*cols, F.col("__total0"), F.col("__total1"))).drop("__total0", "__total1")  # totals is one row


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster shares; it goes with the driver's JVM."""
    from paritas.sources import sinks

    path = sinks.folder(df.sparkSession, "counts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mode_summary(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mode, mean, sample deviation of the finite values of each column; one aggregation."""
    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    stats = [F.struct(F.lit(c).alias("mode"), F.avg(finite(c)).alias("mean"), F.stddev_samp(finite(c)).alias("stdev")) for c in columns]
    return scores.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def raw_count(count: Column, total: Column) -> Column:
    """The count itself in the place of a share."""
    return count.cast("double")


def lexical_tokens(tokens: DataFrame, group_words: Sequence[str], use_root: bool = True, keep_proper: bool = True) -> DataFrame:
    """Tokens of a tagger (structs with text, lower, lemma, pos, gender, definite) under the form they count as; white space goes."""
    def one(t: Column) -> Column:
        return F.struct(lexical_form(t["text"], t["lower"], t["lemma"], t["pos"], group_words, use_root, keep_proper).alias("word"), t["pos"].alias("pos"), t["gender"].alias("gender"), t["definite"].alias("definite"))

    return tokens.withColumn("tokens", F.transform(F.filter("tokens", lambda t: t["pos"] != "SPACE"), one))


def match_summary(matches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """From concordance: word, pos and matches_<group>, empty where a group never met the word; the mode without statistics."""
    none = F.array().cast("array<string>")
    return matches.groupBy("word", "pos").agg(*[F.coalesce(F.first(F.when(F.col("grp") == g, F.array_sort("matches")), ignorenulls=True), none).alias(f"matches_{g}") for g in groups])


def snippets(tokens: DataFrame, lexicon, context=None, before: int = 3, after: int = 2) -> DataFrame:
    """word, pos, grp, match: a row for each distinct highlighted snippet around (seed, word) pairs over the discrete threshold."""
    width, weight = context or continual()
    seeded = seeds(tokens, lexicon).where("agrees")
    start = F.greatest(F.col("centre") - width, F.lit(0))
    near = seeded.select("tokens", "grp", "centre", "seed", start.alias("start"), F.posexplode(F.slice("tokens", start + 1, F.col("centre") + width - start + 1)).alias("k", "token"))
    at = (F.col("start") + F.col("k")).cast("int")
    near = near.withColumn("at", at).where(~F.col("token.pos").isin(*CUT_POS) & (weight(F.col("at") - F.col("centre")) > DISCRETE))
    low, high, n = F.least("at", "centre"), F.greatest("at", "centre"), F.size("tokens")
    words = lambda a, size: F.concat_ws(" ", F.transform(F.slice("tokens", a + 1, F.greatest(size, F.lit(0))), lambda t: t["word"]))
    marked = lambda i: F.concat(F.get("tokens", i)["word"], F.lit("->"), F.get("tokens", i)["word"], F.lit(":"), F.get("tokens", i)["pos"])
    core = F.when(low == high, F.concat(F.lit("«"), marked(low), F.lit("»"))).otherwise(F.concat(F.lit("[["), marked(low), F.lit("]] "), words(low + 1, high - low - 1), F.lit(" [["), marked(high), F.lit("]]")))
    snippet = F.concat(F.when(low - before > 0, "... ").otherwise(""), words(F.greatest(low - before, F.lit(0)), F.least(low, F.lit(before))), F.lit(" "), core, F.lit(" "), words(high + 1, F.lit(after)), F.when(high + before < n, " ...").otherwise(""))
    return near.select(F.col("token.word").alias("word"), F.col("token.pos").alias("pos"), "grp", snippet.alias("match")).distinct()


def concordance(tokens: DataFrame, lexicon, context=None, before: int = 3, after: int = 2, most: int | None = None) -> DataFrame:
    """Per word, part of speech and group: the set of snippets, and n, how many there are.

    A frequent word's set may be as large as the corpus: with `most`, sets hold that many of their snippets at most, those
    that sort first, and n says how many there are; :func:`snippets` has them all as rows.
    """
    found = snippets(tokens, lexicon, context, before, after)
    keys = ["word", "pos", "grp"]
    if most is not None:
        order = Window.partitionBy(*keys).orderBy("match")
        first = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).groupBy(*keys).agg(F.collect_list("match").alias("matches"))
        return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(first, keys).select(*keys, "matches", "n")
    return found.groupBy(*keys).agg(F.collect_list("match").alias("matches"), F.count(F.lit(1)).alias("n"))




def keyword_coverage(words: DataFrame, concepts: DataFrame, gendered: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """One row: share of words (column word) in any concept set (concept_id, word), and mean share of gendered words in a set.

    stems (word, stem) matches words by their stem instead.
    """
    def stemmed(df: DataFrame) -> DataFrame:
        if stems is None:
            return df
        return df.join(stems.dropDuplicates(["word"]), "word", "left").withColumn("word", F.coalesce("stem", "word")).drop("stem")

    inside = stemmed(concepts).select("word").distinct().withColumn("inside", F.lit(1))
    covered = stemmed(words.select("word")).join(inside, "word", "left").agg(F.avg(F.when(F.col("inside") == 1, 1.0).otherwise(0.0)).alias("covered"))
    gender = stemmed(gendered.select("word")).select("word").distinct().withColumn("g", F.lit(1))
    per_set = stemmed(concepts).join(gender, "word", "left").groupBy("concept_id").agg(F.avg(F.when(F.col("g") == 1, 1.0).otherwise(0.0)).alias("share"))
    return covered.crossJoin(F.broadcast(per_set.agg(F.avg("share").alias("gendered"))))  # one row each


class BiasScore:
    """The whole job: texts to tokens, counts and scores.

    tokens: a function of the paragraphs' table that adds a column tokens (a tagger
    of the caller's, or regex_tokens).
    """

    def __init__(self, lexicon, context=None, tokens=regex_tokens, merge_paragraphs: bool = False, stopwords: Sequence[str] = (), drop_group_words: bool = False, inspect: Sequence[str] = (), lemmas: DataFrame | None = None, tagged: bool = False, use_root: bool = True, own_lexicons: DataFrame | None = None, **options):
        """tagged: tokens gives text, lower, lemma, pos, gender, definite, which become lexical forms; own_lexicons: (doc_id, grp, word) in the lexicon's place."""
        self.tagged, self.use_root, self.own = tagged, use_root, own_lexicons
        self.lexicon, self.context, self.tokens, self.merge, self.options = lexicon, context, tokens, merge_paragraphs, options
        self.stopwords, self.drop_group_words, self.inspect, self.lemmas = list(stopwords), drop_group_words, list(inspect), lemmas
        self.groups = list(dict.fromkeys(g for g, _, _ in lexicon_rows(lexicon)))

    def token_table(self, texts: DataFrame, text: str = "text") -> DataFrame:
        made = self.tokens(paragraphs(texts, text, self.merge))
        return lexical_tokens(made, group_words(self.lexicon), self.use_root) if self.tagged else made

    def scores(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """A row per word and part of speech: counts, discrete counts, global count, scores."""
        spark = texts.sparkSession
        table = self.token_table(texts, text)
        words = lambda some: spark.createDataFrame([(w,) for w in some], "word string") if some else None
        one_pass = self.own is None and self.lemmas is None and not self.options
        if one_pass:
            found = all_counts(table, self.lexicon, self.context)
        elif self.own is None:
            found = bias_counts(table, self.lexicon, self.context, **self.options)
        else:
            found = own_counts(table, self.own, self.groups, self.context)
        counts = drop_words(found, words(self.stopwords), words(group_words(self.lexicon)) if self.drop_group_words else None, words(self.inspect))
        if self.lemmas is not None:
            counts = merge_lemmas(counts, self.lemmas, words(self.inspect))
        if one_pass:
            rest = [c for c in counts.columns if c not in ("word", "pos", "global_count")]
            scored = bias_scores(counts, self.groups)
            return scored.select("word", "pos", *rest, *[c for c in scored.columns if c not in counts.columns], "global_count")
        return bias_scores(counts, self.groups).join(global_counts(table), ["word", "pos"], "left")

    def summary(self, scores: DataFrame) -> DataFrame:
        columns = ["count_disparity", *(["log_score"] if len(self.groups) == 2 else []), *[f"{k}_{g}" for k in ("count", "discrete") for g in self.groups], "global_count"]
        return mode_summary(scores, columns)

    def simple(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return simple_scores(self.token_table(texts, text), self.lexicon)


def texts_own_lexicon(df: DataFrame, annotation: str = "annotation") -> DataFrame:
    """From texts with a lexicon each (word, include, grp): doc_id, grp, word of what is included."""
    return df.select("doc_id", F.explode(included_words(F.col(annotation))).alias("a")).select("doc_id", F.col("a.grp").alias("grp"), F.col("a.word").alias("word")).distinct()


def seeds_by_text(tokens: DataFrame, own: DataFrame | str, groups: Sequence[str] | None = None) -> DataFrame:
    """Like seeds(), with the lexicon of each text: rows (doc_id, grp, word), joined on the text's id, or the name of a column of
    (word, grp) that tokens has, where nothing is shuffled.

    groups: the groups that are expected, in their order; a text that names another one stops the job.
    """
    if not isinstance(own, str):
        if groups is not None:
            own = own.withColumn("grp", _expected(F.col("grp"), groups))
        tokens, own = tokens.join(own.groupBy("doc_id").agg(F.collect_set(F.struct("word", "grp")).alias("__own")), "doc_id"), "__own"
    here = lambda words: _places(tokens, lambda t: F.array_contains(words, t["word"]))
    places = _let(F.transform(own, lambda o: o["word"]), here)
    out = tokens.select("*", F.explode(places).alias("centre")).withColumn("seed", F.get("tokens", F.col("centre")))
    hits = F.transform(F.filter(own, lambda o: o["word"] == F.col("seed.word")), lambda o: o["grp"])
    return out.select("*", F.explode(F.array_sort(F.array_distinct(hits))).alias("grp")).drop(own).withColumn("agrees", F.lit(True))


def own_counts(tokens: DataFrame, own: DataFrame | str, groups: Sequence[str], context=None) -> DataFrame:
    """bias_counts with the lexicon of each text, as seeds_by_text takes it."""
    context = context or continual()
    return counts_of(contexts(seeds_by_text(pieces(tokens, context[0]), own, groups), context), groups)
