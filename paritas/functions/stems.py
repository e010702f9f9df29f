"""Stems of English and Spanish words by the published Snowball rules, in column expressions.

A word's regions are places in it, found once by patterns; a suffix lies in a region if what stands before it is at least as
long.  Each step is one column, made from a table of suffixes of which the longest that fits is taken, whether its condition
then holds or not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "__w"


def _w() -> Column:
    return F.col(W)


def _without(n: int) -> Column:
    """The word without its last n letters."""
    return F.substring(_w(), F.lit(1), F.greatest(F.char_length(_w()) - n, F.lit(0)))


def _within(suffix: str, region: str) -> Column:
    """Whether the suffix begins in the region, which begins at this place."""
    return F.char_length(_w()) - len(suffix) >= F.col(region)


Rule = Callable[[str], Column]


def _longest(rules: Sequence[tuple[Sequence[str], Rule]]) -> Column:
    """The word after the rule of the longest suffix that it ends with; other words stay."""
    flat = sorted(((s, rule) for suffixes, rule in rules for s in suffixes), key=lambda r: -len(r[0]))
    out = None
    for s, rule in flat:
        fits, made = _w().endswith(s), rule(s)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(_w())


def _replaced(by: str, region: str, also: Callable[[Column], Column] | None = None) -> Rule:
    """By something else where the suffix lies in the region, and the word before it is as asked."""
    def rule(s: str) -> Column:
        holds = _within(s, region) if also is None else _within(s, region) & also(_without(len(s)))
        return F.when(holds, F.concat(_without(len(s)), F.lit(by))).otherwise(_w())

    return rule


def _kept(_: str) -> Column:
    return _w()


def _region(df: DataFrame, name: str, word: str, vowels: str, after: str | None = None) -> DataFrame:
    """Where the region after the first consonant that follows a vowel begins; beyond the end if there is none."""
    start = F.lit(0) if after is None else F.col(after)
    rest = F.substring(F.col(word), start + 1, F.char_length(word))
    met = F.regexp_extract(rest, f"^.*?[{vowels}][^{vowels}]", 0)
    return df.withColumn(name, F.when(F.char_length(met) > 0, start + F.char_length(met)).otherwise(F.char_length(word)))


# --- English --------------------------------------------------------------------------------------------------------------

_V = "aeiouy"
#: Words with a stem of their own, words that stay, and words that stay once their plural's s is gone.
ENGLISH_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ENGLISH_SAME = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
ENGLISH_DONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
#: A word that ends in a short syllable.
_SHORT = f"([^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$"


def _english_1b(df: DataFrame) -> DataFrame:
    """-eed and -ed, -ing with what their loss asks for."""
    def lost(s: str) -> Column:
        rest = _without(len(s))
        again = F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e"))).when(rest.rlike(_DOUBLE), F.substring(rest, F.lit(1), F.char_length(rest) - 1))
        again = again.when(rest.rlike(_SHORT) & (F.char_length(rest) <= F.col("__r1")), F.concat(rest, F.lit("e"))).otherwise(rest)
        return F.when(rest.rlike(f"[{_V}]"), again).otherwise(_w())

    return df.withColumn(W, _longest([(("eed", "eedly"), _replaced("ee", "__r1")), (("ed", "edly", "ing", "ingly"), lost)]))


def english_stems(df: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """df with the stem of each word, which is taken in lower case; words of two letters or fewer stay, null stays null."""
    low = F.regexp_replace(F.lower(F.col(word)), "[’‘`]", "'")
    out = df.withColumn("__low", low).withColumn(W, F.regexp_replace("__low", "^'", ""))
    out = out.withColumn(W, F.regexp_replace(F.regexp_replace(_w(), "^y", "Y"), "([aeiouy])y", "$1Y"))
    out = _region(out, "__r1", W, _V)
    early = F.regexp_extract(W, "^(gener|commun|arsen)", 1)
    out = out.withColumn("__r1", F.when(F.char_length(early) > 0, F.char_length(early)).otherwise(F.col("__r1")))
    out = _region(out, "__r2", W, _V, "__r1")
    out = out.withColumn(W, F.regexp_replace(_w(), "('s'|'s|')$", ""))
    # 1a
    to_i = lambda s: F.when(F.char_length(_without(3)) > 1, F.concat(_without(3), F.lit("i"))).otherwise(F.concat(_without(3), F.lit("ie")))
    cut_s = lambda s: F.when(_without(1).rlike(f"[{_V}].+$"), _without(1)).otherwise(_w())
    out = out.withColumn(W, _longest([(("sses",), lambda s: _without(2)), (("ied", "ies"), to_i), (("us", "ss"), _kept), (("s",), cut_s)]))
    out = out.withColumn("__done", _w().isin(*ENGLISH_DONE)).withColumn("__1a", _w())
    out = _english_1b(out)
    out = out.withColumn(W, F.when(_w().rlike(f".[^{_V}Y][yY]$") | _w().rlike(f"^.+[^{_V}Y][yY]$"), F.concat(_without(1), F.lit("i"))).otherwise(_w()))
    # 2
    table = [("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al")]
    table += [("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less")]
    rules = [((s,), _replaced(by, "__r1")) for s, by in table]
    rules += [(("ogi",), _replaced("og", "__r1", lambda rest: rest.endswith("l"))), (("li",), _replaced("", "__r1", lambda rest: rest.rlike("[cdeghkmnrt]$")))]
    out = out.withColumn(W, _longest(rules))
    # 3
    table = [("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    out = out.withColumn(W, _longest([*[((s,), _replaced(by, "__r1")) for s, by in table], (("ative",), _replaced("", "__r2"))]))
    # 4
    gone = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
    out = out.withColumn(W, _longest([(gone, _replaced("", "__r2")), (("ion",), _replaced("", "__r2", lambda rest: rest.rlike("[st]$")))]))
    # 5
    cut_e = F.when(_within("e", "__r2") | (_within("e", "__r1") & ~_without(1).rlike(_SHORT)), _without(1)).otherwise(_w())
    cut_l = F.when(_within("l", "__r2") & _without(1).endswith("l"), _without(1)).otherwise(_w())
    out = out.withColumn(W, F.when(_w().endswith("e"), cut_e).when(_w().endswith("l"), cut_l).otherwise(_w()))
    own = F.create_map(*[F.lit(x) for pair in ENGLISH_OWN.items() for x in pair])
    plain = F.translate(F.when(F.col("__done"), F.col("__1a")).otherwise(_w()), "Y", "y")
    found = F.when((F.char_length("__low") <= 2) | F.col("__low").isin(*ENGLISH_SAME), F.col("__low")).otherwise(F.coalesce(F.try_element_at(own, F.col("__low")), plain))
    return out.withColumn("__stem", found).select(*df.columns, F.col("__stem").alias(name))


# --- Spanish --------------------------------------------------------------------------------------------------------------

_ES = "aeiouáéíóúü"
_PLAIN = ("áéíóú", "aeiou")
_VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis
asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()


def _then(first: Column, suffixes: Sequence[str], region: str = "__r2") -> Column:
    """first without the first of these endings that it has, if that lies in the region."""
    out = None
    for s in suffixes:
        fits = first.endswith(s)
        made = F.when(F.char_length(first) - len(s) >= F.col(region), F.substring(first, F.lit(1), F.char_length(first) - len(s))).otherwise(first)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(first)


def spanish_stems(df: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """df with the stem of each word, which is taken in lower case; null stays null."""
    out = df.withColumn("__low", F.lower(F.col(word))).withColumn(W, F.col("__low"))
    out = _region(out, "__r1", W, _ES)
    out = _region(out, "__r2", W, _ES, "__r1")
    c = f"[^{_ES}]"
    second, both = F.regexp_extract(W, f"^.{c}.*?[{_ES}]", 0), F.regexp_extract(W, f"^[{_ES}]{{2}}.*?{c}", 0)
    rv = F.when(_w().rlike(f"^.{c}"), F.char_length(second)).when(_w().rlike(f"^[{_ES}]{{2}}"), F.char_length(both)).otherwise(F.lit(3))
    out = out.withColumn("__rv", F.when((rv > 0) & (rv <= F.char_length(W)), rv).otherwise(F.char_length(W)))
    # 0: pronouns after a verb
    def pronoun(s: str) -> Column:
        rest = _without(len(s))
        verb = F.regexp_extract(rest, "(iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir)$", 1)
        inside = (F.char_length(verb) > 0) & (F.char_length(rest) - F.char_length(verb) >= F.col("__rv"))
        bare = F.concat(F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(verb)), F.translate(verb, *_PLAIN))
        after_u = rest.rlike("uyendo$") & (F.char_length(rest) - 5 >= F.col("__rv"))
        return F.when(_within(s, "__rv") & inside, bare).when(_within(s, "__rv") & after_u, rest).otherwise(_w())

    out = out.withColumn(W, _longest([(("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"), pronoun)]))
    # 1
    def cut(then: Sequence[str] = (), region: str = "__r2") -> Rule:
        def rule(s: str) -> Column:
            rest = _without(len(s))
            return F.when(_within(s, region), _then(rest, then) if then else rest).otherwise(_w())

        return rule

    def adverb(s: str) -> Column:
        rest = _without(len(s))
        iv = F.when(F.char_length(rest) - 2 >= F.col("__r2"), _then(F.substring(rest, F.lit(1), F.char_length(rest) - 2), ["at"])).otherwise(rest)
        return F.when(_within(s, "__r1"), F.when(rest.endswith("iv"), iv).otherwise(_then(rest, ["os", "ic", "ad"]))).otherwise(_w())

    nouns = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
    doers = "adora ador ación adoras adores aciones acion ante antes ancia ancias".split()
    out = out.withColumn("__before", _w()).withColumn(W, _longest([
        (nouns, cut()), (doers, cut(["ic"])), (("logía", "logías"), _replaced("log", "__r2")), (("ución", "uciones"), _replaced("u", "__r2")), (("encia", "encias"), _replaced("ente", "__r2")),
        (("amente",), adverb), (("mente",), cut(["ante", "able", "ible"])), (("idad", "idades"), cut(["abil", "ic", "iv"])), (("iva", "ivo", "ivas", "ivos"), cut(["at"])),
    ]))
    # 2: only where step 1 took nothing away
    y = _longest([("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), _replaced("", "__rv", lambda rest: rest.endswith("u")))])
    out = out.withColumn("__one", _w() != F.col("__before")).withColumn("__y", F.when(F.col("__one"), _w()).otherwise(y)).withColumn("__two", F.col("__one") | (F.col("__y") != _w())).withColumn(W, F.col("__y"))
    after_gu = lambda s: F.when(_within(s, "__rv"), F.when(_without(len(s)).endswith("gu"), _without(len(s) + 1)).otherwise(_without(len(s)))).otherwise(_w())
    # a suffix counts from the region on, so the longest that lies there is taken
    verb = None
    for s in sorted([*_VERBS, "en", "es", "éis", "emos"], key=lambda s: -len(s)):
        fits = _w().endswith(s) & _within(s, "__rv")
        made = after_gu(s) if s in ("en", "es", "éis", "emos") else _without(len(s))
        verb = F.when(fits, made) if verb is None else verb.when(fits, made)
    out = out.withColumn(W, F.when(F.col("__two"), _w()).otherwise(verb.otherwise(_w())))
    # 3
    e = lambda s: F.when(_within(s, "__rv"), F.when(_without(1).endswith("gu") & (F.char_length(W) - 2 >= F.col("__rv")), _without(2)).otherwise(_without(1))).otherwise(_w())
    out = out.withColumn(W, _longest([(("os", "a", "o", "á", "í", "ó"), _replaced("", "__rv")), (("e", "é"), e)]))
    return out.withColumn("__stem", F.translate(W, *_PLAIN)).select(*df.columns, F.col("__stem").alias(name))


def stem_table(words: DataFrame, language: str, word: str = "word") -> DataFrame:
    """word, stem of the distinct words, as keyword_coverage takes them; English or Spanish."""
    made = {"english": english_stems, "spanish": spanish_stems}
    if language not in made:
        raise ValueError(f"no stems for {language}; known: {sorted(made)}")
    return made[language](words.select(F.col(word).alias("word")).distinct())
