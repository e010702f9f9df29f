"""Queries that search, train and learn over the fixture tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators import evaluation, evolve, sensors, training
from paritas.plans import views as V
from paritas.plans.catalogue import query, rounded
from paritas.sources import paged, sinks

# --- search over ensembles ---------------------------------------------------------------------------------------------------

_MASKS = "masks AS (SELECT m FROM range({n}) t(m) WHERE bit_count(m) >= 2)"
#: From voted (kind, m, doc_id, gold, vote): the ensembles that no other one beats.
_FRONT = """,
acc AS (SELECT kind, m, avg((vote = gold)::INT) AS accuracy FROM voted GROUP BY ALL),
par AS (SELECT kind, m, lang, avg((vote = 1)::INT) AS p FROM voted JOIN doc USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
e AS (SELECT kind, m, accuracy, g FROM acc JOIN (SELECT kind, m, max(p) - min(p) AS g FROM par GROUP BY ALL) USING (kind, m))
SELECT kind, m, round(accuracy, 6) AS accuracy, round(g, 6) AS g FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.accuracy >= e.accuracy AND o.g <= e.g AND (o.accuracy > e.accuracy OR o.g < e.g))"""
_SEARCHED = "WITH " + V.CLF_LONG + ", scored AS (SELECT *, (" + str(V.CLF_SCORES) + ")[k + 1]::DOUBLE AS own FROM long), " + _MASKS.format(n=32) + """,
met AS (SELECT m, doc_id, gold, k, pred, own FROM scored JOIN masks ON (m >> k) & 1 = 1),
votes AS (SELECT m, doc_id, any_value(gold) AS gold, pred, count(*) AS n, max(own) AS own, min(k) AS first FROM met WHERE doc_id % 3 = 0 GROUP BY m, doc_id, pred),
ranked AS (SELECT *, row_number() OVER (PARTITION BY m, doc_id ORDER BY n DESC, own DESC, first) AS r FROM votes),
tuples AS (SELECT m, doc_id, any_value(gold) AS gold, string_agg(pred::VARCHAR, ',' ORDER BY k) AS said, arg_max(pred, own * 1000 - k) AS best FROM met GROUP BY m, doc_id),
seen AS (SELECT m, said, gold, count(*) AS n, min(doc_id) AS first FROM tuples WHERE doc_id % 3 <> 0 GROUP BY ALL),
learnt AS (SELECT m, said, gold AS label FROM seen QUALIFY row_number() OVER (PARTITION BY m, said ORDER BY n DESC, first) = 1),
voted AS (
  SELECT 'voting' AS kind, m, doc_id, gold, pred AS vote FROM ranked WHERE r = 1
  UNION ALL SELECT 'overfit', t.m, doc_id, gold, coalesce(label, best) FROM tuples t LEFT JOIN learnt l ON l.m = t.m AND l.said = t.said WHERE doc_id % 3 = 0)"""


def _classified(s, d) -> DataFrame:
    rows = V.doc(s, d)
    preds = [F.col("n_chars") >= 500, F.col("n_chars") >= 2000, F.col("lang") == "en", F.col("toxic") == 0, F.col("doc_id") % 2 == 1]
    return rows.select("doc_id", "lang", F.col("target").alias("gold"), F.array(*[p.cast("int") for p in preds]).alias("preds"))


def _found(s, outcome: evolve.Outcome) -> DataFrame:
    """The front of a search: kind, m (which classifiers, as bits), accuracy, g."""
    rows = [(outcome.found[i][0], sum(1 << k for k in outcome.found[i][1]), *map(float, outcome.scores[i])) for i in outcome.front]
    return rounded(s.createDataFrame(rows, "kind string, m long, accuracy double, g double"))


@query(_SEARCHED + _FRONT)
def search_generations(s, d):
    """Generations go on until the 52 ensembles of this space have all been met, so SQL can follow."""
    table = evolve.cells(_classified(s, d), ["lang"], order="doc_id", train=F.col("doc_id") % 3 != 0)
    return _found(s, evolve.search_ensembles(table, 5, V.CLF_SCORES, ["lang"], 1, kinds=("voting", "overfit"), generations=None, population=18, explore=0.5))


# --- learners that are trained --------------------------------------------------------------------------------------------------

FEATURES = ("lang", "source", "size", "toxic")
LEARNERS = (("lang", "size"), ("source", "size"), ("size", "toxic"), ("lang", "source", "toxic"))
_PREDICTED = "WITH " + V.DOC + """,
part AS (SELECT *, doc_id % 3 AS fold, least(n_chars // 500, 6) AS size FROM doc),
feat AS (SELECT doc_id, fold, target, unnest(['lang', 'source', 'size', 'toxic']) AS feature, unnest([coalesce(lang, '-'), coalesce(source, '-'), coalesce(size::VARCHAR, '-'), coalesce(toxic::VARCHAR, '-')]) AS value FROM part),
kinds AS (SELECT feature, count(DISTINCT value) AS kinds FROM feat GROUP BY feature),
total AS (SELECT feature, value, target, count(*) AS n FROM feat GROUP BY ALL),
own AS (SELECT feature, value, fold, target, count(*) AS n FROM feat GROUP BY ALL),
rows_ AS (SELECT f.fold, l.label, (SELECT count(*) FROM part p WHERE p.fold <> f.fold AND p.target = l.label) AS n, (SELECT count(*) FROM part p WHERE p.fold <> f.fold) AS n_all
  FROM (SELECT DISTINCT fold FROM part) f, (SELECT DISTINCT target AS label FROM part) l),
labels_ AS (SELECT count(DISTINCT label) AS n_labels FROM rows_),
told AS (
  SELECT f.doc_id, f.feature, r.label, ln((coalesce(t.n, 0) - coalesce(o.n, 0) + 1) / (r.n + k.kinds)::DOUBLE) AS s
  FROM feat f JOIN rows_ r ON r.fold = f.fold JOIN kinds k ON k.feature = f.feature
  LEFT JOIN total t ON t.feature = f.feature AND t.value = f.value AND t.target = r.label
  LEFT JOIN own o ON o.feature = f.feature AND o.value = f.value AND o.fold = f.fold AND o.target = r.label),
learners(k, feature) AS (VALUES (0, 'lang'), (0, 'size'), (1, 'source'), (1, 'size'), (2, 'size'), (2, 'toxic'), (3, 'lang'), (3, 'source'), (3, 'toxic')),
summed AS (
  SELECT t.doc_id, k, t.label, round(any_value(ln((r.n + 1) / (r.n_all + n_labels)::DOUBLE)) + sum(s), 9) AS s
  FROM told t JOIN learners USING (feature) JOIN part p ON p.doc_id = t.doc_id JOIN rows_ r ON r.fold = p.fold AND r.label = t.label, labels_ GROUP BY ALL),
said AS (SELECT doc_id, k, label AS pred FROM summed QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY s DESC, label) = 1)"""


def _features(s, d) -> DataFrame:
    size = F.least(F.floor(F.col("n_chars") / 500), F.lit(6))
    return V.doc(s, d).select("doc_id", "lang", "source", "toxic", size.alias("size"), F.col("target").alias("gold"), (F.col("doc_id") % 3).cast("int").alias("fold"))


@query(_PREDICTED + " SELECT doc_id, list(pred::BIGINT ORDER BY k) AS preds FROM said GROUP BY doc_id")
def bayes_out_of_fold(s, d):
    told = training.out_of_fold(_features(s, d), LEARNERS)
    return told.select("doc_id", F.transform("preds", lambda x: x.cast("long")).alias("preds"))


@query(_PREDICTED + ", long AS (SELECT doc_id, k, said.pred, target AS gold FROM said JOIN doc USING (doc_id)), single AS (SELECT k, avg((pred = gold)::INT) AS own FROM long GROUP BY k), " + _MASKS.format(n=16) + """,
votes AS (SELECT m, doc_id, any_value(gold) AS gold, pred, count(*) AS n, max(own * 1000000 - k) AS own FROM long JOIN single USING (k) JOIN masks ON (m >> k) & 1 = 1 GROUP BY m, doc_id, pred),
voted AS (SELECT 'voting' AS kind, m, doc_id, gold, pred AS vote FROM votes QUALIFY row_number() OVER (PARTITION BY m, doc_id ORDER BY n DESC, own DESC) = 1)""" + _FRONT)
def mitigation_trained(s, d):
    outcome, _ = training.mitigate_trained(_features(s, d), LEARNERS, ["lang"], 1, row_id="doc_id", top=4, kinds=("voting",), generations=None, population=11, explore=0.5)
    return _found(s, outcome)


# --- sensors end to end ------------------------------------------------------------------------------------------------------------


def _contains(words: list[str]) -> str:
    return "len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), [" + ", ".join(f"'{w}'" for w in words) + "])) > 0"


_SENSED = f"""WITH rows_ AS (
  SELECT d.doc_id, quality, toxic, {_contains(V.LEXICON["male"])} AS lm, {_contains(V.LEXICON["female"])} AS lf, n_chars >= 1000 AS long FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
said AS (
  SELECT quality, toxic, unnest(['Handler', 'lexicon', 'length']) AS predicted, unnest([lm OR long, lm, long]) AS m, unnest([lf, lf, FALSE]) AS f FROM rows_),
per AS (
  SELECT predicted, unnest(['male', 'female']) AS label, unnest([quality = 1, toxic = 1]) AS gold, unnest([m, f]) AS found FROM said),
counts AS (SELECT predicted, label, count(*) FILTER (WHERE gold AND found) AS h, count(*) FILTER (WHERE found) AS p, count(*) FILTER (WHERE gold) AS g FROM per GROUP BY ALL),
rates AS (SELECT predicted, label, CASE WHEN p = 0 THEN 0 ELSE h / p::DOUBLE END AS precision, CASE WHEN g = 0 THEN 0 ELSE h / g::DOUBLE END AS recall FROM counts)
SELECT predicted, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM rates"""


@query(_SENSED)
def sensors_evaluated(s, d):
    """A lexicon over the words and a rule by length, alone and together, against labels."""
    texts = V.table(s, d, "documents").select("doc_id", "text", "n_chars").join(V.table(s, d, "labels"), "doc_id")
    rows = texts.withColumn("gold", F.array_compact(F.array(F.when(F.col("quality") == 1, "male"), F.when(F.col("toxic") == 1, "female"))))
    words = sensors.words_of(F.lower("text"))
    handlers = {"lexicon": evaluation.of_column(lambda df: sensors.lexicon_sensor(words, V.LEXICON)), "length": evaluation.of_column(lambda df: F.when(F.col("n_chars") >= 1000, F.array(F.lit("male"))))}
    _, scores, _ = evaluation.evaluated(rows, handlers, "gold", ["male", "female"])
    return rounded(scores)


# --- paged answers ------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name AS name, p_retailprice AS price FROM part")
def read_paged(s, d):
    """Parts as pages of a hundred, as a service would answer, read by the paged source."""
    base = sinks.folder(s, "pages")
    rows = V.table(s, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("page"), F.struct("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).alias("row"))
    n = rows.agg(F.max("page")).first()[0] + 1
    parts = max(s.sparkContext.defaultParallelism, -(-n // 500))  # a page costs a file whatever its bytes, so they aren't what deals the pages
    sheets = rows.repartition(parts, "page").groupBy("page").agg(F.to_json(F.struct(F.collect_list("row").alias("rows"))).alias("value"))  # a hundred rows
    # version 2: tasks put their pages in place, else the driver moves them all, one after the other; the folder is new, and a page is one task's
    sheets.write.partitionBy("page").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(base)
    url = base if ":" in base else f"file://{base}"
    return paged.paged(s, "p_partkey long, name string, price double", url + "/page={page}", pages=n, items="rows")
