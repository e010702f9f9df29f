"""Registered queries of the reference's operators over the fixture tables, each with its SQL where SQL can express it.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions import text as T
from paritas.operators import bias, diversity, ensemble, fairness, labels, pareto, reports, sampling, sensors, stats
from paritas.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# --- fairness ----------------------------------------------------------------------------------------------------------

_LI_RATES = V.LI + """,
rates AS (SELECT grp, avg((target = pred)::INT) AS accuracy_disparity, avg((pred = 'O')::INT) AS statistical_parity,
  avg((pred = 'O')::INT) FILTER (WHERE target = 'O') AS equal_opportunity, avg((pred = 'O')::INT) FILTER (WHERE target <> 'O') AS false_positive_rate,
  count(*) FILTER (WHERE pred = 'O') / (SELECT count(*) FROM li WHERE pred = 'O')::DOUBLE AS representation_disparity FROM li WHERE grp IS NOT NULL GROUP BY grp)"""
_SPREAD = "round(max({m}) OVER () - min({m}) OVER (), 6) AS difference, round(CASE WHEN max({m}) OVER () = 0 THEN 0 ELSE 1 - min({m}) OVER () / max({m}) OVER () END, 6) AS ratio"


def _both(rates: DataFrame, attrs: list[str], metric: str) -> DataFrame:
    whole = fairness.every_group()
    spread = {mode: fairness.spread_of(metric, mode, over=whole) for mode in ("difference", "ratio")}
    return rounded(rates.select(*attrs, F.col(metric).alias("prob"), *[c.alias(mode) for mode, c in spread.items()]))


for _m in ("accuracy_disparity", "statistical_parity", "equal_opportunity", "false_positive_rate"):
    query(f"WITH {_LI_RATES} SELECT grp, round({_m}, 6) AS prob, {_SPREAD.format(m=_m)} FROM rates", _m)(lambda s, d, m=_m: _both(fairness.group_rates(V.li(s, d), ["grp"], "target", "pred", "O"), ["grp"], m))


@query("WITH " + V.LI + " SELECT round(avg((target = pred)::INT), 6) AS accuracy FROM li")
def accuracy(s, d):
    return rounded(fairness.accuracy(V.li(s, d), "target", "pred"))


_EO = """,
odds AS (SELECT grp, coalesce(equal_opportunity, 0) AS e, coalesce(false_positive_rate, 0) AS f FROM rates),
gap AS (SELECT 1 - (max(equal_opportunity) - min(equal_opportunity)) AS e, 1 - (max(false_positive_rate) - min(false_positive_rate)) AS f FROM rates)
SELECT o.grp, round(CASE WHEN o.e + o.f = 0 THEN 0 ELSE 2 * o.e * o.f / (o.e + o.f) END, 6) AS prob, round(1 - 2 * g.e * g.f / (g.e + g.f), 6) AS value FROM odds o, gap g"""


def _odds(rates: DataFrame) -> DataFrame:
    value = fairness.spread_of("equalized_odds", over=fairness.every_group())
    return rounded(rates.select("grp", F.col("equalized_odds").alias("prob"), value.alias("value")))


@query("WITH " + _LI_RATES + _EO)
def equalized_odds(s, d):
    return _odds(fairness.group_rates(V.li(s, d), ["grp"], "target", "pred", "O"))


@query("WITH " + V.DOC + """, rates AS (SELECT lang, source, avg(pred) AS p FROM doc WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source)
SELECT lang, source, round(p, 6) AS prob, """ + _SPREAD.format(m="p") + " FROM rates")
def statistical_parity_intersectional(s, d):
    return _both(fairness.group_rates(V.doc(s, d), ["lang", "source"], "target", "pred", 1), ["lang", "source"], "statistical_parity")


@query("WITH " + V.DOC + """, rates AS (SELECT lang, count(*) FILTER (WHERE pred = 1) / (SELECT count(*) FROM doc WHERE pred = 1)::DOUBLE AS p FROM doc WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang, round(p, 6) AS prob, """ + _SPREAD.format(m="p") + " FROM rates")
def representation_disparity(s, d):
    return _both(fairness.group_rates(V.doc(s, d), ["lang"], "target", "pred", 1), ["lang"], "representation_disparity")


_EXPLODED = V.ORD + """, e AS (SELECT o_orderkey, target, pred, unnest(groups) AS grp FROM ord),
rates AS (SELECT grp, avg((target = pred)::INT) AS accuracy_disparity, count(DISTINCT o_orderkey) FILTER (WHERE pred = 'F') / count(*)::DOUBLE AS statistical_parity,
  count(DISTINCT o_orderkey) FILTER (WHERE pred = 'F' AND target = 'F') / count(*) FILTER (WHERE target = 'F')::DOUBLE AS equal_opportunity,
  count(DISTINCT o_orderkey) FILTER (WHERE pred = 'F' AND target <> 'F') / count(*) FILTER (WHERE target <> 'F')::DOUBLE AS false_positive_rate,
  count(DISTINCT o_orderkey) FILTER (WHERE pred = 'F') / (SELECT count(*) FROM ord WHERE pred = 'F')::DOUBLE AS representation_disparity FROM e GROUP BY grp)"""


def _exploded_rates(s, d) -> DataFrame:
    return fairness.group_rates(V.orders(s, d).withColumnRenamed("groups", "grp"), ["grp"], "target", "pred", "F", True)


for _n, _m in (("statistical_parity", "statistical_parity"), ("representation", "representation_disparity"), ("accuracy", "accuracy_disparity"), ("equal_opportunity", "equal_opportunity"), ("false_positive_rate", "false_positive_rate")):
    query(f"WITH {_EXPLODED} SELECT grp, round({_m}, 6) AS prob, {_SPREAD.format(m=_m)} FROM rates", f"exploded_{_n}")(lambda s, d, m=_m: _both(_exploded_rates(s, d), ["grp"], m))


@query("WITH " + _EXPLODED + _EO)
def exploded_equalized_odds(s, d):
    return _odds(_exploded_rates(s, d))


_REPORTED = [m for m in fairness.METRICS if m != "equalized_odds"]


@query("WITH " + V.DOC + """, rates AS (SELECT lang, avg((target = pred)::INT) AS accuracy_disparity, avg((pred = 1)::INT) AS statistical_parity,
  avg((pred = 1)::INT) FILTER (WHERE target = 1) AS equal_opportunity, avg((pred = 1)::INT) FILTER (WHERE target <> 1) AS false_positive_rate,
  count(*) FILTER (WHERE pred = 1) / (SELECT count(*) FROM doc WHERE pred = 1)::DOUBLE AS representation_disparity FROM doc WHERE lang IS NOT NULL GROUP BY lang),
long AS (UNPIVOT rates ON accuracy_disparity, statistical_parity, equal_opportunity, false_positive_rate, representation_disparity INTO NAME metric VALUE prob)
SELECT metric, lang, round(prob, 6) AS prob, round(max(prob) OVER (PARTITION BY metric) - min(prob) OVER (PARTITION BY metric), 6) AS value FROM long""")
def fairness_report(s, d):
    return rounded(fairness.report(V.doc(s, d), ["lang"], "target", "pred", 1, _REPORTED))


def _tve(attr: str, name: str) -> str:
    return f"""{name}_e AS (SELECT o_orderkey, target, unnest({attr}) AS grp FROM ord),
{name}_r AS (SELECT grp, count(DISTINCT o_orderkey) FILTER (WHERE target = 'F') / count(*)::DOUBLE AS sp, count(DISTINCT o_orderkey) FILTER (WHERE target = 'F') / (SELECT count(*) FROM ord WHERE target = 'F')::DOUBLE AS rd FROM {name}_e GROUP BY grp),
{name} AS (SELECT 'statistical_parity' AS metric, 'difference' AS mode, max(sp) - min(sp) AS v FROM {name}_r UNION ALL SELECT 'statistical_parity', 'ratio', 1 - min(sp) / max(sp) FROM {name}_r
  UNION ALL SELECT 'representation_disparity', 'difference', max(rd) - min(rd) FROM {name}_r UNION ALL SELECT 'representation_disparity', 'ratio', 1 - min(rd) / max(rd) FROM {name}_r)"""


@query("WITH " + V.ORD + ", " + _tve("groups", "t") + ", " + _tve("pred_groups", "p") + " SELECT t.metric, t.mode, round(t.v, 6) AS true_value, round(p.v, 6) AS estimated_value FROM t JOIN p USING (metric, mode)")
def fairness_true_vs_estimated(s, d):
    return rounded(fairness.compare(V.orders(s, d), "groups", "pred_groups", "target", "F", ndigits=None))


@query("WITH " + V.DOC + ", r AS (SELECT lang, avg(pred) AS e, avg(target) AS t FROM doc GROUP BY lang) SELECT lang, round(floor(abs(e - t) / 0.01::DOUBLE) * 0.01::DOUBLE * 100, 6) AS delta FROM r")
def delta_percent(s, d):
    means = V.doc(s, d).groupBy("lang").agg(F.avg("pred").alias("e"), F.avg("target").alias("t"))
    return rounded(means.select("lang", fairness.delta_percent(F.col("e"), F.col("t"), 0.01).alias("delta")))


# --- diversity and ensembles --------------------------------------------------------------------------------------------


def _pair_query(name: str, expression: str) -> None:
    sql = "WITH " + V.CLF_LONG + f""", s AS (SELECT doc_id, k, CASE WHEN pred = gold THEN 1 ELSE -1 END AS s FROM long)
SELECT a.k::BIGINT AS i, b.k::BIGINT AS j, round(avg({expression}), 6) AS {name} FROM s a JOIN s b USING (doc_id) GROUP BY a.k, b.k"""
    query(sql, name)(lambda s, d: rounded(diversity.pairwise(V.clf(s, d), 5).select("i", "j", name)))


_pair_query("disagreement", "(a.s <> b.s)::INT")
_pair_query("double_fault", "(a.s < 0 AND b.s < 0)::INT")
_pair_query("double_fault_inverse", "1 - (a.s < 0 AND b.s < 0)::INT")
_pair_query("kohavi_wolpert", "((a.s < 0)::INT + (b.s < 0)::INT) / 2.0::DOUBLE * (1 - ((a.s < 0)::INT + (b.s < 0)::INT) / 2.0::DOUBLE)")


@query("WITH " + V.CLF_LONG + """, votes AS (SELECT doc_id, pred, count(*) AS n, min(k) AS first FROM long GROUP BY doc_id, pred)
SELECT doc_id, arg_max(pred, n * 10 - first)::BIGINT AS vote FROM votes GROUP BY doc_id""")
def majority_vote(s, d):
    return rounded(V.clf(s, d).select("doc_id", ensemble.majority_vote(F.col("preds")).alias("vote")))


@query("WITH " + V.CLF + """, four AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS k, unnest([p0, p1, p2, p3]) AS pred, unnest([0.75, 0.46, 0.61, 0.77]::DOUBLE[]) AS score FROM clf),
votes AS (SELECT doc_id, pred, count(*) AS n, max(score) AS best FROM four GROUP BY doc_id, pred)
SELECT doc_id, arg_max(pred, n * 10 + best)::BIGINT AS vote FROM votes GROUP BY doc_id""")
def scored_vote(s, d):
    four = ensemble.select_predictions(F.col("preds"), [0, 1, 2, 3])
    return rounded(V.clf(s, d).select("doc_id", ensemble.scored_vote(four, V.CLF_SCORES[:4]).alias("vote")))


@query("WITH " + V.CLF + """, t AS (SELECT p0, p1, p2, p3, p4, gold, count(*) AS n, min(doc_id) AS first FROM clf GROUP BY ALL),
best AS (SELECT p0, p1, p2, p3, p4, arg_max(gold, n * 1000000000 - first) AS oracle FROM t GROUP BY ALL)
SELECT doc_id, oracle::BIGINT AS oracle FROM clf JOIN best USING (p0, p1, p2, p3, p4)""")
def overfit_oracle(s, d):
    return rounded(ensemble.overfit_oracle(V.clf(s, d), V.CLF_SCORES).select("doc_id", "oracle"))


@query("WITH " + V.CLF + """, t AS (SELECT p0, p1, p2, p3, p4, gold, count(*) AS n FROM clf GROUP BY ALL), best AS (SELECT max(n) AS n FROM t GROUP BY p0, p1, p2, p3, p4)
SELECT round(sum(n) / (SELECT count(*) FROM clf)::DOUBLE, 6) AS coverage FROM best""")
def overfit_coverage(s, d):
    return rounded(ensemble.overfit_oracle(V.clf(s, d), V.CLF_SCORES).agg(F.avg((F.col("oracle") == F.col("gold")).cast("double")).alias("coverage")))


@query("WITH " + V.CLF + " SELECT doc_id, (CASE WHEN gold IN (p0, p1, p2, p3, p4) THEN gold ELSE p0 END)::BIGINT AS oracle FROM clf")
def optimistic_oracle(s, d):
    return rounded(V.clf(s, d).select("doc_id", ensemble.optimistic_oracle(F.col("preds"), F.col("gold")).alias("oracle")))


@query("WITH " + V.CLF + " SELECT round(avg((gold IN (p0, p1, p2, p3, p4))::INT), 6) AS coverage FROM clf")
def optimistic_coverage(s, d):
    return rounded(ensemble.optimistic_coverage(V.clf(s, d)))


@query()
def greedy_diversity_rank(s, d):
    rows = diversity.pairwise(V.clf(s, d), 5).collect()  # 25 rows
    ranks = diversity.greedy_rank(V.CLF_SCORES, {(r["i"], r["j"]): r["double_fault_inverse"] for r in rows}, 2)
    return s.createDataFrame([(i, float(r)) for i, r in enumerate(ranks)], "classifier long, rank double")


@query("WITH " + V.DOC + ", l AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS c FROM (SELECT DISTINCT lang FROM doc)), o AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS c FROM (SELECT DISTINCT source FROM doc)) SELECT doc_id, l.c::BIGINT AS lang_code, o.c::BIGINT AS source_code FROM doc JOIN l USING (lang) JOIN o USING (source)")
def encode_labels(s, d):
    return ensemble.encode_labels(V.doc(s, d), ["lang", "source"]).select("doc_id", "lang_code", "source_code")


@query()
def stacking_tree(s, d):
    _, out = ensemble.stacking(V.clf(s, d), 5)
    return out.select("doc_id", F.col("stacked").cast("long").alias("stacked"))


@query()
def bagging_tree(s, d):
    wide = V.doc(s, d).select("doc_id", "n_chars", "toxic", "target")
    return ensemble.bagging(wide, ["n_chars", "toxic"], "target", n_estimators=2).select("doc_id", "bagged")


# --- bias scores -----------------------------------------------------------------------------------------------------------

NUDGE = 1e-9  # sums of 0.95 ** k lie on halves of the last place
_COUNTS = " SELECT word, round(count_male + 1e-9, 6) AS count_male, round(count_female + 1e-9, 6) AS count_female, discrete_male, discrete_female FROM counts"


def _bias_counts(s, d, context):
    counts = bias.bias_counts(V.tokens(s, d), V.LEXICON, context).drop("pos")
    return rounded(counts.withColumns({c: F.col(c) + NUDGE for c in ("count_male", "count_female")}))


query("WITH " + V.pairs_sql(10, "1::DOUBLE") + _COUNTS, "bias_counts_fixed")(lambda s, d: _bias_counts(s, d, bias.fixed()))
query("WITH " + V.pairs_sql(200, V.INFINITE) + _COUNTS, "bias_counts_infinite")(lambda s, d: _bias_counts(s, d, bias.infinite()))
query("WITH " + V.pairs_sql(200, V.CONTINUAL) + _COUNTS, "bias_counts_continual")(lambda s, d: _bias_counts(s, d, bias.continual()))


def _scores(s, d) -> DataFrame:
    return bias.bias_scores(bias.bias_counts(V.tokens(s, d), V.LEXICON).drop("pos"), ["male", "female"])


@query("WITH " + V.SCORES + " SELECT word, round(count_disparity, 6) AS count_disparity, round(log_score, 6) AS log_score FROM scores")
def bias_scores(s, d):
    return rounded(_scores(s, d).select("word", "count_disparity", "log_score"))


@query("WITH " + V.TOK + ", g AS (SELECT grp, count(*) AS n FROM seed GROUP BY grp) SELECT grp, n, round(n / (SELECT min(n) FROM g)::DOUBLE, 6) AS ratio FROM g")
def bias_simple_scores(s, d):
    return rounded(bias.simple_scores(V.tokens(s, d), V.LEXICON))


@query("WITH " + V.TOK + " SELECT word, count(*) AS global_count FROM tok GROUP BY word")
def bias_global_count(s, d):
    return bias.global_counts(V.tokens(s, d)).select("word", "global_count")


_MODES = ["count_disparity", "log_score", "count_male", "count_female", "discrete_male", "discrete_female"]


@query("WITH " + V.SCORES + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS stdev FROM scores" for m in _MODES))
def bias_summary(s, d):
    return rounded(bias.mode_summary(_scores(s, d), _MODES))


@query("WITH " + V.SCORES + ", st AS (SELECT avg(log_score) AS m, stddev_pop(log_score) AS sd FROM scores) SELECT word, round(log_score, 6) AS log_score FROM scores, st WHERE abs((log_score - m) / sd) > 3")
def bias_zfilter(s, d):
    return rounded(stats.z_filter(_scores(s, d)).select("word", "log_score"))


@query("WITH " + V.SCORES + " SELECT word, round(count_disparity, 6) AS count_disparity FROM scores WHERE round(count_disparity, 6) >= 0.5")
def bias_disparity_filter(s, d):
    return stats.disparity_filter(rounded(_scores(s, d).select("word", "count_disparity")))


@query("WITH " + V.SCORES + f" SELECT word, round(log_score, 6) AS log_score FROM scores WHERE word IN {tuple(V.PROFESSIONS)}")
def bias_profession_filter(s, d):
    words = s.createDataFrame([(w,) for w in V.PROFESSIONS], "word string")
    return rounded(stats.profession_filter(_scores(s, d), words, "word", None).select("word", "log_score"))


@query("WITH " + V.pairs_sql(200, V.CONTINUAL) + f" SELECT word, round(count_male + 1e-9, 6) AS count_male FROM counts WHERE word NOT IN {tuple(V.STOPWORDS)} AND word NOT IN ('his', 'it', 'this')")
def bias_drop_words(s, d):
    frame = lambda words: s.createDataFrame([(w,) for w in words], "word string")
    counts = bias.bias_counts(V.tokens(s, d), V.LEXICON)
    return rounded(bias.drop_words(counts, frame(V.STOPWORDS), frame(bias.group_words(V.LEXICON)), frame(["he"])).select("word", (F.col("count_male") + NUDGE).alias("count_male")))


@query("WITH " + V.pairs_sql(200, V.CONTINUAL) + " SELECT CASE WHEN word IN ('his', 'he') THEN 'he' ELSE word END AS word, sum(discrete_male)::BIGINT AS discrete_male, sum(discrete_female)::BIGINT AS discrete_female FROM counts GROUP BY 1")
def bias_merge_lemmas(s, d):
    counts = bias.bias_counts(V.tokens(s, d), V.LEXICON).select("word", "pos", "discrete_male", "discrete_female")
    return bias.merge_lemmas(counts, s.createDataFrame([("his", "he")], "word string, lemma string")).select("word", "discrete_male", "discrete_female")


@query()
def bias_concordance(s, d):
    return bias.concordance(V.tokens(s, d), {"male": ["his"], "female": ["this"]}, bias.fixed(2)).select("word", "pos", "grp", F.array_sort("matches").alias("matches"))


@query("WITH " + V.SCORES + " SELECT count(*) AS n, round(avg(log_score), 6) AS mean, round(stddev_samp(log_score), 6) AS stdev FROM scores")
def summary_ci(s, d):
    return rounded(stats.confidence(_scores(s, d), "log_score").select("n", "mean", "stdev"))


@query()
def summary_ci_margin(s, d):
    return rounded(stats.confidence(_scores(s, d), "log_score"))


@query("WITH " + V.TOK + r""", words AS (SELECT DISTINCT word FROM tok WHERE NOT regexp_full_match(word, '[0-9]+|[.,;:!?]')),
concept AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark)
SELECT round((SELECT avg((word IN (SELECT word FROM concept))::INT) FROM words), 6) AS covered, round((SELECT avg(s) FROM (SELECT avg((word IN (SELECT word FROM lex))::INT) AS s FROM concept GROUP BY item_id)), 6) AS gendered""")
def keyword_coverage(s, d):
    words = bias.global_counts(V.tokens(s, d)).where(F.col("pos") == "X").select("word").distinct()
    concepts = V.table(s, d, "benchmark").select(F.col("item_id").alias("concept_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))).alias("word"))
    return rounded(bias.keyword_coverage(words, concepts, s.createDataFrame([(w,) for w in bias.group_words(V.LEXICON)], "word string")))


_ENDINGS = [("el señor/a dijo", "el señor / señora dijo"), ("profesor/a", "profesor / profesora"), ("amigo/a, jefe/a", "amigo / amiga, jefe / jefa"), ("doctores/as y amigos/as", "doctores / doctoras y amigos / amigas")]
_CATALAN = [("amic/a", "amic o amica"), ("mestre/a", "mestre o mestra"), ("director/a", "director o directora"), ("professors/as", "professors o professorses")]


def _after_names(forms: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({k}, '{x}', '{y}')" for k, (x, y) in enumerate(forms))
    return f"SELECT p_partkey, k::BIGINT AS id, p_name || ' ' || x AS before, p_name || ' ' || y AS after FROM part, (VALUES {values}) v(k, x, y)"


def _names_before(s, d, forms: list[tuple[str, str]]) -> DataFrame:
    each = F.posexplode(F.array(*[F.lit(x) for x, _ in forms])).alias("id", "form")
    return V.table(s, d, "part").select("p_partkey", "p_name", each).select("p_partkey", F.col("id").cast("long").alias("id"), F.concat_ws(" ", "p_name", "form").alias("before"))


@query(_after_names(_ENDINGS))
def gender_endings_split(s, d):
    return _names_before(s, d, _ENDINGS).withColumn("after", T.spanish_endings(F.col("before")))


@query(_after_names(_CATALAN))
def gender_endings_catalan(s, d):
    return _names_before(s, d, _CATALAN).withColumn("after", T.catalan_endings(F.col("before")))


# --- sensors -----------------------------------------------------------------------------------------------------------------

_DOCWORDS = r"w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"
_HAS = "list_sort(list_filter([CASE WHEN list_has_any(w, ['it', 'this']) THEN 'female' END, CASE WHEN list_has_any(w, ['he', 'his']) THEN 'male' END], lambda x: x IS NOT NULL))"
_LONG = "CASE WHEN len(w) > 100 THEN ['male'] ELSE []::VARCHAR[] END"


def _annotated(s, d) -> DataFrame:
    words = V.table(s, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"))
    return words.select("doc_id", sensors.lexicon_sensor(F.col("w"), V.LEXICON).alias("a"), F.when(F.size("w") > 100, F.array(F.lit("male"))).otherwise(F.array().cast("array<string>")).alias("b"))


def _joined(df: DataFrame, c) -> DataFrame:
    return df.select("doc_id", F.concat_ws(" & ", c).alias("groups"))


@query("WITH " + _DOCWORDS + f" SELECT doc_id, array_to_string({_HAS}, ' & ') AS groups FROM w")
def lexicon_sensor(s, d):
    return _joined(_annotated(s, d), F.col("a"))


@query("WITH " + _DOCWORDS + f" SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({_HAS}, {_LONG}))), ' & ') AS groups FROM w")
def sensor_merge_union(s, d):
    df = _annotated(s, d)
    handler = sensors.SensorHandler([("lexicon", None, lambda _: F.col("a")), ("length", ["gender"], lambda _: F.col("b"))])
    return _joined(handler.annotate(df, "gender"), F.col("values"))


@query("WITH " + _DOCWORDS + f" SELECT doc_id, array_to_string(list_sort(list_intersect({_HAS}, {_LONG})), ' & ') AS groups FROM w")
def sensor_merge_intersection(s, d):
    return _joined(_annotated(s, d), sensors.intersection_merge([F.col("a"), F.col("b")]))


@query("WITH " + _DOCWORDS + f", s AS (SELECT doc_id, {_HAS} AS a, {_LONG} AS b FROM w) SELECT doc_id, array_to_string(list_filter(['female', 'male'], lambda g: 0.7 * list_contains(a, g)::INT + 0.3 * list_contains(b, g)::INT > 0.5), ' & ') AS groups FROM s")
def sensor_merge_weighted(s, d):
    return _joined(_annotated(s, d), sensors.weighted_merge([F.col("a"), F.col("b")], sensors.parametric_weights([7, 3], 2), ["female", "male"], 0.5))


_ITEM = V.VEC + ", kept AS (SELECT * FROM vec WHERE score > 0.1), n AS (SELECT doc_id, count(DISTINCT vec_id) AS n FROM vec GROUP BY doc_id), per AS (SELECT doc_id, attr, count(*) AS c, sum(score) AS s, max(score) AS m FROM kept GROUP BY ALL)"


def _scored_tokens(s, d) -> DataFrame:
    rows, named = V.vectors(s, d)
    return rows.select("doc_id", sensors.large_enough(sensors.similarities(F.col("vector"), named), 0.1).alias("scored"))


def _aggregated(kind: str, sql: str) -> None:
    def run(s, d):
        items = sensors.aggregate_items(_scored_tokens(s, d), ["attr0", "attr1"], kind)
        return rounded(items.select("doc_id", F.explode("scored").alias("x")).select("doc_id", "x.attr", "x.score"))

    query("WITH " + _ITEM + f" SELECT doc_id, attr, round({sql}, 6) AS score FROM per JOIN n USING (doc_id)", f"agg_{kind}")(run)


_aggregated("count", "c / max(c) OVER (PARTITION BY doc_id)::DOUBLE")
_aggregated("sum", "s")
_aggregated("max", "m")
_aggregated("vote", "c / n::DOUBLE")
_aggregated("union", "m")


def _filtered(name: str, make, sql: str) -> None:
    def run(s, d):
        rows, named = V.vectors(s, d)
        return rounded(rows.select("vec_id", F.explode(make(sensors.similarities(F.col("vector"), named))).alias("x")).select("vec_id", "x.attr", "x.score"))

    query("WITH " + V.VEC + f", b AS (SELECT vec_id, attr, score, max(score) OVER (PARTITION BY vec_id) AS best, count(*) OVER (PARTITION BY vec_id) AS n FROM vec), k AS (SELECT *, count(*) FILTER (WHERE score / best > 0.75) OVER (PARTITION BY vec_id) AS kept FROM b) SELECT vec_id, attr, round(score, 6) AS score FROM k WHERE {sql}", name)(run)


_filtered("filter_large", lambda x: sensors.large_enough(x, 0.1), "score > 0.1")
_filtered("filter_best", lambda x: sensors.best_score(x, 0.75), "best > 0 AND score / best > 0.75")
_filtered("filter_nonneutral", lambda x: sensors.non_neutral(x, 0.75), "best > 0 AND score / best > 0.75 AND kept < n")


@query("WITH " + V.VEC + """, kept AS (SELECT * FROM vec WHERE score > 0.1), n AS (SELECT doc_id, count(DISTINCT vec_id) AS n FROM vec GROUP BY doc_id),
m AS (SELECT doc_id, attr, sum(score) / any_value(n)::DOUBLE AS s FROM kept JOIN n USING (doc_id) GROUP BY ALL HAVING s > 0.05),
b AS (SELECT doc_id, list_sort(list(attr)) AS v FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM m) WHERE s / best > 0.7 GROUP BY doc_id)
SELECT n.doc_id, array_to_string(coalesce(v, []), ' & ') AS groups FROM n LEFT JOIN b USING (doc_id)""")
def embedding_sensor(s, d):
    rows, named = V.vectors(s, d)
    return _joined(sensors.embedding_sensor(rows, named, token_filter=0.1), F.col("values"))


@query(r"""WITH e AS (SELECT p_partkey AS entity_id, string_split(p_name, ' ') AS w, p_size FROM part),
t AS (SELECT unnest(w) AS name, CASE WHEN p_size > 25 THEN 'male' ELSE 'female' END AS attr FROM e),
f AS (SELECT name, avg((attr = 'female')::INT) AS f, avg((attr = 'male')::INT) AS m FROM t GROUP BY name),
x AS (SELECT e.entity_id, a.f + 0.5::DOUBLE * b.f AS f, a.m + 0.5::DOUBLE * b.m AS m FROM e JOIN f a ON a.name = w[1] JOIN f b ON b.name = w[2])
SELECT entity_id, array_to_string(list_filter([CASE WHEN f / greatest(f, m) > 0.75 THEN 'female' END, CASE WHEN m / greatest(f, m) > 0.75 THEN 'male' END], lambda v: v IS NOT NULL), ' & ') AS groups FROM x""")
def name_gender_sensor(s, d):
    part = V.table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.split("p_name", " ").alias("words"), "p_size")
    names = part.select(F.explode("words").alias("name"), F.when(F.col("p_size") > 25, "male").otherwise("female").alias("attr")).groupBy("name", "attr").agg(F.count(F.lit(1)).alias("count"))
    return sensors.name_sensor(part, names, ["female", "male"], attention=0.5).select("entity_id", F.concat_ws(" & ", "values").alias("groups"))


@query(r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '@([A-Za-z0-9_]+)', 1)) AS handle FROM documents) SELECT doc_id, count(*) AS n, string_agg(handle, ' ' ORDER BY handle) AS handles FROM m GROUP BY doc_id")
def handle_mentions(s, d):
    found = V.table(s, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("@([A-Za-z0-9_]+)")).alias("h")).where(F.size("h") > 0)
    return found.select("doc_id", F.size("h").cast("long").alias("n"), F.array_join(F.array_sort("h"), " ").alias("handles"))


@query()
def fuzzy_match(s, d):
    entities = V.table(s, d, "part").select(F.col("p_name").alias("entity"))
    people = V.table(s, d, "part").select(F.initcap("p_name").alias("person"))
    return rounded(sensors.fuzzy_matches(entities, people))


_LABELS = ["A", "N", "R"]


@query("WITH " + V.ORD + ", x AS (SELECT v AS label, list_contains(groups, v) AS g, list_contains(pred_groups, v) AS p FROM ord, (VALUES ('A'), ('N'), ('R')) t(v)), " + """
e AS (SELECT label, count(*) FILTER (WHERE g AND p) AS h, count(*) FILTER (WHERE NOT g AND p) AS s, count(*) FILTER (WHERE g AND NOT p) AS m FROM x GROUP BY label),
pr AS (SELECT label, coalesce(h / nullif(h + s, 0)::DOUBLE, 0) AS precision, coalesce(h / nullif(h + m, 0)::DOUBLE, 0) AS recall FROM e)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM pr""")
def multilabel_eval(s, d):
    return rounded(labels.multilabel_scores(V.orders(s, d), _LABELS, "groups", "pred_groups"))


@query("WITH " + V.ORD + ", g AS (SELECT groups, count(*) AS n, count(*) FILTER (WHERE groups = pred_groups) AS ok FROM ord GROUP BY groups) SELECT round(sum(ok) / sum(n)::DOUBLE, 6) AS micro_accuracy, round(avg(ok / n::DOUBLE), 6) AS macro_accuracy FROM g")
def multilabel_exact(s, d):
    return rounded(labels.multilabel_summary(V.orders(s, d), _LABELS, "groups", "pred_groups").select("micro_accuracy", "macro_accuracy"))


@query("WITH " + V.ORD + """, c AS (SELECT CASE WHEN len(groups) = 1 THEN groups[1] ELSE 'neutral' END AS class, CASE WHEN len(pred_groups) = 1 THEN pred_groups[1] ELSE 'neutral' END AS said FROM ord),
p AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE class = said) AS ok FROM c GROUP BY class)
SELECT class, n, round(ok / n::DOUBLE, 6) AS accuracy, round((SELECT sum(ok) / sum(n)::DOUBLE FROM p), 6) AS micro_accuracy, round((SELECT avg(ok / n::DOUBLE) FROM p), 6) AS macro_accuracy FROM p""")
def multiclass_eval(s, d):
    return rounded(labels.multiclass_scores(V.orders(s, d), "groups", "pred_groups"))


# --- reports and samples ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_retailprice, p_size::BIGINT AS p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))")
def pareto_front(s, d):
    return pareto.front(V.table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("long").alias("p_size")), ["p_retailprice", "p_size"], [True, False])


_THEME = V.DOC + ", b AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'male' WHEN lang = 'de' THEN 'female' ELSE 'neutral' END AS expected, avg(target) - avg(pred) AS m FROM doc GROUP BY source, lang), o AS (SELECT *, CASE WHEN abs(m) < 0.1 THEN 'neutral' WHEN m > 0 THEN 'male' ELSE 'female' END AS observed FROM b), a AS (SELECT *, CASE WHEN observed = 'neutral' THEN 'neutral' WHEN expected = 'neutral' THEN observed || '-biased' WHEN expected = observed THEN 'stereotypical' ELSE 'counter' END AS category FROM o)"


def _aligned(s, d) -> DataFrame:
    means = V.doc(s, d).groupBy("source", "lang").agg((F.avg("target") - F.avg("pred")).alias("m")).withColumn("expected", F.when(F.col("lang") == "en", "male").when(F.col("lang") == "de", "female").otherwise("neutral"))
    seen = means.withColumn("observed", reports.observed_by_log(F.col("m"), 0.1))
    return seen.withColumn("category", reports.alignment(F.col("expected"), F.col("observed"))).withColumn("score", reports.alignment_score(F.col("category")))


@query("WITH " + _THEME + " SELECT source, lang, round(m, 6) AS m, observed FROM a")
def observed_bias(s, d):
    return rounded(_aligned(s, d).select("source", "lang", "m", "observed"))


_CATEGORIES = ["stereotypical", "counter", "neutral", "male-biased", "female-biased"]


@query("WITH " + _THEME + " SELECT source, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in _CATEGORIES) + " FROM a GROUP BY source")
def alignment_categories(s, d):
    return reports.category_counts(_aligned(s, d), ["source"], "category", _CATEGORIES)


@query("WITH " + _THEME + ", t AS (SELECT source, avg(CASE category WHEN 'stereotypical' THEN 1 WHEN 'counter' THEN -1 WHEN 'male-biased' THEN 0.5 WHEN 'female-biased' THEN -0.5 ELSE 0 END::DOUBLE) AS x, count(*) AS n FROM a GROUP BY source) SELECT source, round(x, 6) AS mean_alignment, n, CASE WHEN x > 0.25 THEN 'stereotypical' WHEN x < -0.25 THEN 'counter' ELSE 'neutral' END AS category FROM t")
def theme_summary(s, d):
    return rounded(reports.theme_summary(_aligned(s, d), ["source"]))


@query("WITH " + V.DOC + ", r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS role FROM doc) SELECT source, max(doc_id) FILTER (WHERE role = 1) AS first, max(doc_id) FILTER (WHERE role = 2) AS second FROM r WHERE role <= 2 GROUP BY source")
def role_pivot(s, d):
    return reports.roles(V.doc(s, d), ["source"], "doc_id").groupBy("source").pivot("role", [1, 2]).agg(F.max("doc_id")).withColumnsRenamed({"1": "first", "2": "second"})


@query("WITH " + V.ORD + """, s AS (SELECT target, len(groups)::BIGINT AS n_groups, count(*) AS n FROM ord GROUP BY ALL), m AS (SELECT n_groups, min(n) AS size FROM s GROUP BY n_groups)
SELECT n_groups, CASE WHEN n_groups = 0 THEN least(size, coalesce((SELECT size FROM m WHERE n_groups = 1), 0) + coalesce((SELECT size FROM m WHERE n_groups = 2), 0) // 2) ELSE size END AS size FROM m""")
def balance_sample_sizes(s, d):
    return rounded(sampling.balanced_sizes(V.orders(s, d), "target", "groups"))


@query("WITH " + V.ORD + ", s AS (SELECT target, array_to_string(groups, ' & ') AS group_set, count(*) AS n FROM ord GROUP BY ALL) SELECT group_set, min(n) AS size FROM s GROUP BY group_set")
def debias_sample_sizes(s, d):
    return sampling.debiased_sizes(V.orders(s, d), "target", "groups")


@query()
def stratified_sample(s, d):
    rows = V.written(V.orders(s, d).select("o_orderkey", "target", "groups", F.concat_ws(" & ", "groups").alias("group_set")))
    sizes = sampling.debiased_sizes(rows, "target", "groups")
    return sampling.stratified_sample(rows, "o_orderkey", ["target", "group_set"], sizes).select("o_orderkey", "target", "group_set")


@query()
def stratified_split(s, d):
    return sampling.stratified_split(V.doc(s, d), "doc_id", ["lang"]).select("doc_id", "lang", "split")


@query()
def strip_markup(s, d):
    return V.table(s, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))
