"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from paritas.functions import text as T
from paritas.functions import lexicons
from paritas.operators import bias, diversity, ensemble, fairness, labels, pareto, reports, sampling, search, sensors, stats
from paritas.plans import views


def near(a, b, eps=1e-6):
    return a is not None and abs(a - b) < eps


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(1, ["m"], "p"), (2, [], "p"), (3, ["m", "f"], "n"), (4, ["m", "m"], "p"), (5, None, "p")]
    return spark.createDataFrame(rows, "id long, g array<string>, t string")


def test_exploded_groups_count_repeats_once_among_positives(listed):
    rates = {r["g"]: r for r in fairness.group_rates(listed, ["g"], "t", None, "p", True).collect()}
    assert set(rates) == {"m", "f"}
    assert near(rates["m"]["statistical_parity"], 0.5) and near(rates["f"]["statistical_parity"], 0)
    assert near(rates["m"]["representation_disparity"], 0.5) and near(rates["f"]["representation_disparity"], 0)
    both = [fairness.spreads(fairness.group_rates(listed, ["g"], "t", None, "p", True), ["statistical_parity"], m).first()[0] for m in ("difference", "ratio")]
    assert both == [0.5, 1.0]


def test_spread_modes_and_rounding(spark):
    rates = spark.createDataFrame([("a", 0.2, 0.0), ("b", 0.5, 0.0)], "g string, x double, z double")
    value = lambda m, mode, **k: fairness.spreads(rates, [m], mode, **k).first()[0]
    assert near(value("x", "difference"), 0.3) and near(value("x", "ratio"), 0.6) and value("z", "ratio") == 0
    assert near(value("x", lambda low, high: high + low), 0.7)
    assert fairness.spreads(rates.limit(0), ["x"]).first()[0] is None
    assert fairness.spreads(rates.withColumn("x", F.col("x") / 3), ["x"], ndigits=2).first()[0] == 0.1
    with pytest.raises(ValueError):
        value("x", "other")


def test_equalized_odds_of_spreads(spark):
    rates = spark.createDataFrame([(0.2, 0.4, 0.0), (0.4, 0.8, 0.0)], "equal_opportunity double, false_positive_rate double, equalized_odds double")
    assert near(fairness.spreads(rates, ["equalized_odds"]).first()[0], 0.314286)


def test_null_targets_are_not_positive_and_null_groups_go(spark):
    df = spark.createDataFrame([("a", "p", "p"), ("a", None, "p"), (None, "p", "p"), ("b", "n", "n")], "g string, t string, y string")
    rates = {r["g"]: r for r in fairness.group_rates(df, ["g"], "t", "y", "p").collect()}
    assert set(rates) == {"a", "b"} and rates["a"]["false_positive_rate"] == 1 and rates["b"]["equal_opportunity"] is None
    assert near(rates["a"]["representation_disparity"], 2 / 3)


def test_report_table_and_function(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0)], "g string, t int, y int")
    table = fairness.report_table(fairness.report(df, ["g"], "t", "y", 1), "g", ["a", "b"])
    row = {r["metric"]: r for r in table.collect()}["statistical_parity"]
    assert (row["value"], row["a"], row["b"]) == (0.5, 0.5, 0.0)
    score = lambda t, y: F.avg((t == y).cast("double"))
    evaluate = fairness.fairness_function(["g"], "t", 1, "statistical_parity", score, lambda a, b: a + b)
    assert evaluate(df, "y").first().asDict() == {"statistical_parity": 0.5, "score": 0.75, "aggregate": 1.25}
    with pytest.raises(ValueError):
        evaluate(df, "missing")
    d = df.select(fairness.delta_percent(F.lit(0.537), F.lit(0.5), 0.01)).first()[0]
    assert near(d, 3)


def test_diversity_relations(spark):
    df = spark.createDataFrame([([1, 0, 1], 1), ([1, 1, 0], 0), ([0, 0, 0], 0), ([1, 1, 1], 0)], "preds array<int>, gold int")
    for r in diversity.pairwise(df, 3).collect():
        assert near(r["kohavi_wolpert"], r["disagreement"] / 4) and near(r["double_fault"] + r["double_fault_inverse"], 1)
    unequal = {(r["i"], r["j"]): r["double_fault"] for r in diversity.pairwise(df, 3, weights=[0.5, 0.25, 0.25]).collect()}
    assert unequal[0, 1] == 0 and unequal[0, 0] > 0 and unequal[1, 2] > 0
    with pytest.raises(ValueError):
        diversity.pairwise(df, 3, weights=[0.5, 0.5, 0.5])


def test_greedy_rank():
    d = {(i, j): 0.0 if i == j else 1 / (1 + abs(i - j)) for i in range(4) for j in range(4)}
    ranks = diversity.greedy_rank([0.5, 0.9, None, 0.6], d, 1)
    assert ranks == [2.0, 3.0, -1.0, 1.0]
    assert diversity.greedy_rank([0.5, None], d, 3) == [0.5, -1.0]
    assert diversity.best_performance_rank([0.1, None, 0.1]) == [0.0, -1.0, 1.0] and diversity.best_performance_rank([3.0, 1.0, 2.0], maximize=False) == [0.0, 2.0, 1.0]
    assert diversity.random_rank([0.1, 0.9, 0.3], 5, True)[1] == 3.0


def test_votes(spark):
    df = spark.createDataFrame([(["B", "A", "A", "B"], "A")], "preds array<string>, gold string")
    p = F.col("preds")
    got = df.select(ensemble.majority_vote(p), ensemble.majority_vote(p, "A"), ensemble.majority_vote(p, "C"), ensemble.scored_vote(F.slice(p, 1, 2), [0.6, 0.9]), ensemble.scored_vote(F.slice(p, 1, 2), [0.6, 0.9], False)).first()
    assert tuple(got) == ("B", "A", "B", "A", "B")


def test_overfit_oracle_ties_and_unseen(spark):
    fit = spark.createDataFrame([(1, [1, 0], 7), (2, [1, 0], 8), (3, [0, 0], 9)], "row_id long, preds array<int>, gold int")
    new = spark.createDataFrame([(1, [1, 0], 0), (2, [1, 1], 0)], "row_id long, preds array<int>, gold int")
    got = {r["row_id"]: r["oracle"] for r in ensemble.overfit_oracle(new, [0.1, 0.9], fit).collect()}
    assert got == {1: 7, 2: 1}
    assert ensemble.detriment_limit(0.8, 10) == pytest.approx(0.72) and ensemble.detriment_limit(0.8, 0.1) == pytest.approx(0.7)


def test_models(spark):
    df = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(40)], "row_id long, x double, gold int")
    assert ensemble.bagging(df, ["x"], "gold", 3).where(F.col("bagged") != F.col("gold")).count() == 0
    both = df.withColumn("preds", F.array("gold", 1 - F.col("gold")))
    for kind in ("tree", "logistic", "svc"):
        _, out = ensemble.stacking(both, 2, kind=kind)
        assert out.where(F.col("stacked") != F.col("gold")).count() == 0
    assert df.select(ensemble.one_group_wins(F.col("gold"), 1, "yes", "no")).distinct().count() == 2


def weights(spark, context):
    rows = spark.createDataFrame([(1, 0, [("a", "X"), ("b", "X"), ("she", "X"), ("c", "X"), ("d", "X")])], "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>")
    seeded = bias.seeds(rows, {"f": ["she"]})
    return [r["weight"] for r in bias.contexts(seeded, context).orderBy("d").collect()]


def test_context_weights(spark):
    assert weights(spark, bias.continual()) == pytest.approx([0.95, 1, 1, 0.95, 0.9025])
    assert weights(spark, bias.infinite()) == pytest.approx([0.95, 1, 1, 1, 0.95])
    assert weights(spark, bias.fixed(1)) == [1, 1, 1]


def test_punctuation_weights_are_opt_in(spark):
    tokens = [("a", "X"), (".", "PUNCT"), ("she", "X"), (",", "PUNCT"), ("c", "X")]
    rows = spark.createDataFrame([(1, 0, tokens)], "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>")
    seeded = bias.seeds(rows, {"f": ["she"]})
    plain = {r["word"]: r["weight"] for r in bias.contexts(seeded).collect()}
    strict = {r["word"]: r["weight"] for r in bias.contexts(seeded, punctuation=True).collect()}
    assert plain == pytest.approx({"a": 0.95, "she": 1, "c": 0.9025}) and strict == pytest.approx({"a": 0.25, "she": 1, "c": 0.95 * 0.75})


def test_scores_by_hand(spark):
    counts = spark.createDataFrame([("w", "X", 3.0, 1.0), ("v", "X", 1.0, 3.0), ("u", "X", 0.0, 0.0)], "word string, pos string, count_m double, count_f double")
    got = {r["word"]: r for r in bias.bias_scores(counts, ["m", "f"]).collect()}
    assert near(got["w"]["count_disparity"], 0.666667) and near(got["w"]["log_score"], math.log2(3)) and got["u"]["count_disparity"] == 1
    one = counts.where("word = 'w'").withColumn("count_f", F.lit(0.0))
    assert near(bias.bias_scores(one.withColumn("count_m", F.lit(1.0)), ["m", "f"]).first()["log_score"], 52)
    assert bias.bias_scores(counts.withColumn("count_x", F.lit(1.0)), ["m", "f", "x"]).columns[-1] == "count_disparity"


def test_agreement_to_the_left(spark):
    kind = "tokens array<struct<word:string,pos:string,gender:string,definite:string>>"
    def token(w, pos="NOUN", gender=None, definite=None):
        return (w, pos, gender, definite)
    rows = [(1, [token("la", "DET", "Gender=fem", "def"), token("jefe"), token("x")]), (2, [token("el", "DET", "Gender=masc", "def"), token("jefe"), token("x")]), (3, [token("una", "DET", "Gender=fem", "Definite=ind"), token("jefe"), token("x")])]
    tokens = spark.createDataFrame(rows, f"doc_id long, {kind}").withColumn("par_id", F.lit(0))
    got = {r["doc_id"]: r["agrees"] for r in bias.seeds(tokens, {"male": ["jefe"]}, agree={"uno": "male"}).collect()}
    assert got == {1: False, 2: True, 3: True}
    assert bias.group_counts(tokens, {"male": ["jefe"]}, agree={}).first()["n"] == 3  # counted before agreement


def test_simple_scores_without_seeds(spark):
    none = spark.createDataFrame([(1, 0, [("a", "X")])], "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>")
    assert sorted(tuple(r) for r in bias.simple_scores(none, {"f": ["she"], "m": ["he"]}).collect()) == [("f", 0, 0.0), ("m", 0, 0.0)]


def test_lexicons_and_forms(spark):
    lexicon = {"male": {"PRON": ["he"], "NOUN": ["king"]}, "female": ["she"]}
    assert bias.lexicon_rows(lexicon)[0] == ("male", "PRON", "he")
    df = spark.createDataFrame([(("he", "NOUN"),), (("he", "PRON"),), (("she", "X"),)], "t struct<word:string,pos:string>")
    assert [r[0] for r in df.select(bias.groups_of(F.col("t"), lexicon)).collect()] == [[], ["male"], ["female"]]
    forms = spark.createDataFrame([("Kings", "kings", "king", "NOUN"), ("Ana", "ana", "ana", "PROPN"), ("The", "the", "the", "DET"), ("ran", "ran", "Run", "VERB")], "a string, b string, c string, d string")
    assert [r[0] for r in forms.select(bias.lexical_form(F.col("a"), F.col("b"), F.col("c"), F.col("d"), ["king"])).collect()] == ["kings", "Ana", "the", "run"]
    text = spark.createDataFrame([(1, "One.\r\nTwo\u0085three")], "doc_id long, text string")
    assert bias.paragraphs(text).count() == 3 and bias.paragraphs(text, merge=True).count() == 1


def scored(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(float(s)).alias("score")) for a, s in pairs])


def as_dict(spark, column):
    return {x["attr"]: round(x["score"], 6) for x in spark.range(1).select(column).first()[0]}


def test_aggregators(spark):
    empty = F.filter(scored(("m", 1)), lambda s: F.lit(False))
    tokens, attrs = F.array(scored(("m", 0.6), ("f", 0.2)), scored(("m", 0.5)), empty), ["f", "m"]
    assert as_dict(spark, sensors.count_aggregator(tokens, attrs)) == {"m": 1, "f": 0.5}
    assert as_dict(spark, sensors.activation_aggregator(tokens, attrs)) == {"m": 0.6, "f": 0.2}
    assert as_dict(spark, sensors.activation_aggregator(tokens, attrs, "mult")) == {}
    assert as_dict(spark, sensors.sum_aggregator(tokens, attrs, 0)) == {"m": 1.1, "f": 0.2}
    assert as_dict(spark, sensors.voting_aggregator(tokens, attrs)) == {"m": 0.666667, "f": 0.333333}


def test_filters(spark):
    both, one = scored(("m", 0.8), ("f", 0.7)), scored(("m", 0.8), ("f", 0.2))
    assert set(as_dict(spark, sensors.best_score(both, 0.75))) == {"m", "f"} and set(as_dict(spark, sensors.best_score(one, 0.75))) == {"m"}
    assert as_dict(spark, sensors.non_neutral(both, 0.75)) == {} and set(as_dict(spark, sensors.non_neutral(one, 0.75))) == {"m"}
    assert set(as_dict(spark, sensors.large_enough(one, 0.2))) == {"m"}


def test_merges_and_handler(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"])], "x array<string>, y array<string>")
    x, y = F.col("x"), F.col("y")
    got = df.select(sensors.union_merge([x, y]), sensors.intersection_merge([x, y]), sensors.weighted_merge([x, y], sensors.uniform_weights(2), ["a", "b"], 0.6)).first()
    assert list(got) == [["a", "b"], ["b"], ["b"]]
    assert sensors.parametric_weights([0, 0], 2) == [0, 0]
    with pytest.raises(ValueError):
        sensors.SensorHandler([("n", ["race"], None)]).annotate(df, "gender")
    with pytest.raises(ValueError):
        sensors.intersection_merge([])


def test_table_sensors(spark):
    names = spark.createDataFrame([("ana", "f", 9), ("ana", "m", 1), ("alex", "m", 5), ("alex", "f", 5)], "name string, attr string, count long")
    people = spark.createDataFrame([(1, ["ana", "alex"]), (2, ["alex"]), (3, ["nobody"]), (4, [])], "entity_id long, words array<string>")
    assert {r["entity_id"]: r["values"] for r in sensors.name_sensor(people, names, ["f", "m"]).collect()} == {1: ["f"], 2: ["f", "m"], 3: [], 4: []}
    texts = spark.createDataFrame([(1, "hello @ana_1 and @bob"), (2, "none")], "doc_id long, text string")
    handles = spark.createDataFrame([("ana_1", "ana")], "handle string, name string")
    assert [tuple(r) for r in sensors.handle_sensor(texts, handles, names, ["f", "m"]).collect()] == [(1, ["f"])]
    clusters = spark.createDataFrame([(1, 1, "Ana"), (1, 1, "She"), (2, 1, "it")], "doc_id long, cluster_id int, mention string")
    assert {r[0]: r[1] for r in sensors.coreference_sensor(clusters, {"she": "f", "he": "m"}, ["f", "m"]).collect()} == {1: ["f"], 2: []}
    entities = spark.createDataFrame([(1, "PERSON", ["f"]), (1, "ORG", ["m"]), (1, "PERSON", ["m"])], "doc_id long, label string, values array<string>")
    assert sensors.entity_sensor(entities, ["PERSON"]).first()["values"] == ["f", "m"]


def test_fuzzy_matches(spark):
    from difflib import SequenceMatcher

    people, asked = ["Marie Curie", "Pierre Curie", "Max Planck", "M"], ["Marie Curi", "Planck Max", "Curie"]
    got = {(r["entity"], r["person"]): r["ratio"] for r in sensors.fuzzy_matches(spark.createDataFrame([(e,) for e in asked], "entity string"), spark.createDataFrame([(p,) for p in people], "person string"), 0.4).collect()}
    expected = {(e, p): SequenceMatcher(None, p, e).ratio() for e in asked for p in people if SequenceMatcher(None, p, e).ratio() >= 0.4 and SequenceMatcher(None, p, e).real_quick_ratio() > 0.4}
    assert got == pytest.approx(expected)
    base = spark.createDataFrame([("Marie Curie", "Female"), ("Max Planck", "Male"), ("Pierre Curie", "Male And Female")], "person string, property_value string")
    found = sensors.knowledge_sensor(spark.createDataFrame([("Marie Curi",), ("Max Plank",)], "entity string"), base, {"Female": ["female"], "Male": ["male"], "Male And Female": ["female", "male"]}, ["female", "male"])
    assert {r["entity"]: r["values"] for r in found.collect()} == {"Marie Curi": ["female"], "Max Plank": ["male"]}


def test_constant_and_random_sensors(spark):
    assert spark.range(1).select(sensors.constant_sensor(["m", "f"])).first()[0] == ["f", "m"]
    got = [r[0] for r in spark.range(2000).select(sensors.random_sensor("id", {"m": 0.25, "f": 1.0})).collect()]
    assert all("f" not in x for x in got) and 0.7 < sum("m" in x for x in got) / 2000 < 0.8


def test_multilabel(spark):
    df = spark.createDataFrame([(["m"], ["m"]), (["m", "f"], ["m"]), ([], ["f"])], "gold array<string>, predicted array<string>")
    got = {r["label"]: tuple(r)[1:] for r in labels.multilabel_scores(df, ["m", "f"]).collect()}
    assert got == {"m": (1, 1, 1), "f": (0, 0, 0)}
    row = labels.multilabel_summary(df, ["m", "f"]).first()
    assert row["macro_f1"] == 0.5 and near(row["micro_accuracy"], 1 / 3) and near(row["macro_accuracy"], 1 / 3)
    classes = {r["class"]: (r["n"], r["accuracy"]) for r in labels.multiclass_scores(df).collect()}
    assert classes == {"m": (1, 1.0), "neutral": (2, 0.0)}


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 50 + [100]] + [(float("inf"),)], "log_score double")
    assert sorted(r[0] for r in stats.z_filter(df).collect()) == [100.0, float("inf")]
    assert stats.z_filter(df.limit(0)).count() == 0
    for n, q in ((1, 12.7062), (2, 4.30265), (10, 2.22814), (1000, 1.96234)):
        assert near(stats.t_quantile(0.975, n), q, 1e-4)
    row = stats.confidence(spark.createDataFrame([(1.0,), (3.0,)], "log_score double"), "log_score").first()
    assert near(row["margin"], 12.7062, 1e-3) and row["n"] == 2
    assert stats.confidence(spark.createDataFrame([(1.0,)], "log_score double"), "log_score").first()["margin"] is None


def test_balanced_sizes_golden(spark):
    def rows(counts):
        sets = {0: [], 1: ["f"], 2: ["m"], 3: ["f", "m"]}
        return [(label, sets[k]) for label, ns in counts.items() for k, n in enumerate(ns) for _ in range(n)]
    mentions = spark.createDataFrame(rows({"no": [156, 273, 32, 38], "yes": [125, 252, 19, 103]}), "label string, g array<string>")
    assert {r["group_set"]: r["size"] for r in sampling.debiased_sizes(mentions, "label", "g").collect()} == {"": 125, "f": 252, "m": 19, "f & m": 38}
    by_set = mentions.withColumn("label", F.concat_ws("|", "label", F.concat_ws("&", "g")))
    assert by_set.count() == 998
    sized = spark.createDataFrame([("a", [])] * 9 + [("a", ["x"])] * 3 + [("a", ["x", "y"])] * 5 + [("b", [])] * 8 + [("b", ["x"])] * 4 + [("b", ["x", "y"])] * 5, "label string, g array<string>")
    assert {r["n_groups"]: r["size"] for r in sampling.balanced_sizes(sized, "label", "g").collect()} == {0: 5, 1: 3, 2: 5}


def test_sampling(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 2)
    a, b = sampling.split(df, "id")
    assert a.count() + b.count() == 1000 and 250 < b.count() < 350
    counts = {tuple(r) for r in sampling.stratified_split(df, "id", ["s"]).groupBy("s", "split").count().collect()}
    assert counts == {(0, "train", 350), (0, "test", 150), (1, "train", 350), (1, "test", 150)}
    sizes = spark.createDataFrame([(0, 7), (1, 0)], "s long, size long")
    assert sampling.stratified_sample(df, "id", ["s"], sizes).count() == 7


def test_pareto(spark):
    points = [(1, 1, 9), (2, 5, 5), (3, 5, 5), (4, 4, 4), (5, 9, 1), (6, 0, 0)]
    df = spark.createDataFrame(points, "id long, x int, y int")
    assert {r["id"] for r in pareto.front(df, ["x", "y"], [True, True]).collect()} == {1, 2, 3, 5}
    three = df.withColumn("z", F.lit(1))
    assert {r["id"] for r in pareto.front(three, ["x", "y", "z"], [True, True, False]).collect()} == {1, 2, 3, 5}
    assert {r["id"]: r["front"] for r in pareto.fronts(df, ["x", "y"], [True, True], 4).collect()} == {1: 0, 2: 0, 3: 0, 5: 0, 4: 1, 6: 2}


def test_pareto_fronts_leave_no_row_out(spark):
    points = [(i, i, i) for i in range(13)] + [(100, 3, 3), (100, 3, 3), (200, None, 5)]
    df = spark.createDataFrame(points, "id long, x int, y int")
    got = pareto.fronts(df, ["x", "y"], [True, True]).collect()
    expected = [(i, 12 - i) for i in range(13)] + [(100, 9), (100, 9), (200, None)]
    assert sorted(map(str, ((r["id"], r["front"]) for r in got))) == sorted(map(str, expected))


def test_reports(spark):
    df = spark.createDataFrame([(None, 2.0), (2.0, None), (2.0, 2.1), (4.0, 1.0), (1.0, 4.0)], "m double, f double")
    assert [r[0] for r in df.select(reports.observed_by_counts(F.col("m"), F.col("f"), 1.2)).collect()] == ["female", "male", "neutral", "male", "female"]
    cases = spark.createDataFrame([("male", "neutral"), ("neutral", "male"), ("neutral", "female"), ("male", "male"), ("male", "female"), ("male", None)], "e string, o string")
    got = [tuple(r) for r in cases.select(reports.alignment(F.col("e"), F.col("o")).alias("a")).select("a", reports.alignment_score(F.col("a"))).collect()]
    assert got == [("neutral", 0.0), ("male-biased", 0.5), ("female-biased", -0.5), ("stereotypical", 1.0), ("counter", -1.0), (None, None)]
    log = spark.createDataFrame([("# TOP-ENSEMBLE-0 @ TESTING #\nScore: 0.5\nFScore: [0.25, 0.5]\nx\n# BASE-MODEL-1 @ TESTING #\nScore: 0.9\nFScore: [1.0, 0.9]\n# TOP-ENSEMBLE-1 @ TRAINING #\nScore: 0.1\nFScore: [0.1, 0.1]\n",)], "value string")
    assert [tuple(r) for r in reports.parse_log(log).collect()] == [(0, 0.5, [0.25, 0.5])]
    nested = spark.createDataFrame([('{"m":{"es":{"t":{"s":{"log_mean":0.5,"count":2}}}}}',)], "value string")
    assert {tuple(r) for r in reports.flatten_scores(nested).collect()} == {("m", "es", "t", "s", "log_mean", 0.5), ("m", "es", "t", "s", "count", 2.0)}
    assert [r[0] for r in spark.createDataFrame([([0.9, 0.1],), ([0.9, 0.1, 0.3],), ([0.9],)], "f array<double>").select(reports.fitness_under(F.col("f"), 0.2)).collect()] == [True, False, True]
    best = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "id long, s double")
    assert reports.best_model(best, "s", "id").first()["id"] == 2
    stats_ = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, mean double")
    conf = spark.createDataFrame([("a", 1.5, 0.1)], "k string, conf_mean double, margin double")
    assert {tuple(r) for r in reports.score_summary(stats_, conf, ["k"]).collect()} == {("a", 1.5, 0.1), ("b", 2.0, 0.0)}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.spanish_endings(F.lit("El señor/a y los profesores/as, jefe/a"))) == "El señor / señora y los profesores / profesoras, jefe / jefa"
    assert one(T.catalan_endings(F.lit("director/a mestre/a mestres/as amic/a"))) == "director o directora mestre o mestra mestres o mestreses amic o amica"
    assert one(T.split_list(F.lit(" Female, ,male ,"))) == ["female", "male"]
    assert one(T.bracketed(F.lit("x [a rather long label text]"))) == "a rather long l..." and one(T.bracketed(F.lit("short"))) == "short"
    assert one(T.strip_suffix(F.lit("m_databias_generated"))) == "m" and one(T.last_part(F.lit("http://x/y/female"))) == "Female"
    assert one(T.strip_markup(F.lit("<p>a&amp;b<script>x<y</script> <b>c</b><!-- z --></p>"))) == "a&b c"
    assert one(T.markdown_to_text(F.lit("# Title\n* one **two** [link](http://x)\n`code`"))) == "Title one two link code"
    assert one(T.mentions(F.lit("@ñandú and @b_1"))) == ["ñandú", "b_1"]
    got = one(T.parse_annotations(F.lit("la jefa - S,F\nmesa - N, F\nbad line\nx - S,Q")))
    assert [tuple(x) for x in got] == [("la jefa", True, "female"), ("mesa", False, "female")]
    assert one(T.parse_stories(F.lit('["Story 1: a", "Story 2: b", "c", "d"]'))) == ["a", "b", "c", "d"] and one(T.parse_stories(F.lit('["a"]'))) is None
    literal = spark.createDataFrame([("['Story 1: it\\'s', \"b\", 'c', 'd']",), ("__import__('os')",), (None,)], "x string")
    assert [r[0] for r in literal.select(T.parse_stories(T.literal_list(F.col("x")))).collect()] == [["it's", "b", "c", "d"], None, None]


def test_search(spark):
    assert list(search.expand({"a": "1|2", "b": "x"})) == [{"a": "1", "b": "x"}, {"a": "2", "b": "x"}]
    assert search.sampled({"a": range(5)}, 3, 1) == search.sampled({"a": range(5)}, 3, 1)
    first = search.Choices(seed=3)
    picked = [first.choose("k", range(100)), first.choose("m", "abc")]
    again = search.Choices(first.log)
    assert [again.choose("k", range(100)), again.choose("m", "abc")] == picked
    assert search.Choices(first.log, by_name=True).choose("m", "abc") == picked[1]
    with pytest.raises(ValueError):
        search.Choices(first.log).choose("other", [1])
    assert len(list(search.ensembles(3))) == 8
    df = spark.createDataFrame([([1, 1, 0], 1), ([0, 1, 0], 0)], "preds array<int>, gold int")
    scores = search.score_votes(df, [(0, 1), (0, 1, 2)], {"accuracy": search.accuracy_metric})
    assert {tuple(r) for r in scores.collect()} == {(0, 1.0), (1, 1.0)}
    assert search.within_detriment(scores, 1.0, 0.1).count() == 2
    assert search.first_that_works([0, 5], lambda x: 10 // x if x else int("no")) == (5, 2)


def test_lexicon_values():
    lexicon = lexicons.english_lexicon()
    assert lexicon["female"]["PRON"] == ["she", "her"] and lexicon["male"]["PRON"] == ["he", "him", "his"]
    assert lexicons.gender_standard()["Mixed"] == ["male", "female"] and lexicons.gender_standard()["F"] == ["female"]


def test_whole_bias_job(spark):
    texts = spark.createDataFrame([(1, "he is tall\nshe is kind"), (2, "the king is tall")], "doc_id long, text string")
    job = bias.BiasScore({"male": ["he", "king"], "female": ["she"]}, stopwords=["the"], drop_group_words=True, inspect=["king"])
    scores = {r["word"]: r for r in job.scores(texts).collect()}
    assert set(scores) == {"is", "tall", "kind", "king"} and scores["tall"]["count_disparity"] == 1 and scores["is"]["global_count"] == 3
    assert {r["mode"] for r in job.summary(job.scores(texts)).collect()} >= {"log_score", "global_count"}
    assert {tuple(r) for r in job.simple(texts).collect()} == {("male", 2, 2.0), ("female", 1, 1.0)}


def test_lexicons_of_each_text(spark):
    kind = "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>, annotation array<struct<word:string,include:boolean,grp:string>>"
    rows = [(1, 0, [("ana", "X"), ("x", "X")], [("ana", True, "f"), ("x", False, "m")]), (2, 0, [("ana", "X"), ("x", "X")], [("x", True, "m")]), (3, 0, [("ana", "X")], [])]
    df = spark.createDataFrame(rows, kind)
    seeded = bias.seeds_by_text(df.drop("annotation"), bias.texts_own_lexicon(df))
    assert {(r["doc_id"], r["centre"], r["grp"]) for r in seeded.collect()} == {(1, 0, "f"), (2, 1, "m")}
    assert bias.contexts(seeded).count() == 4


def windows_by_hand(rows, own, width):
    """word -> (discrete of m, discrete of f) by every seed's window."""
    out = {}
    for doc, words in rows:
        for c, seed in enumerate(words):
            for grp in {g for w, g in own[doc] if w == seed}:
                for word in words[max(0, c - width) : c + width + 1]:
                    out.setdefault(word, [0, 0])["mf".index(grp)] += 1
    return {w: tuple(n) for w, n in out.items()}


def test_own_lexicons_over_pieces_of_long_paragraphs(spark, monkeypatch):
    monkeypatch.setattr(bias, "PIECE", 7)
    rows = [(1, list("abcab" * 9)), (2, list("cab" * 5)), (3, []), (4, list("b" * 7)), (5, list("xyzab" * 3) + ["a"])]
    own = {1: [("a", "m"), ("c", "f")], 2: [("b", "m"), ("b", "f")], 3: [("a", "m")], 4: [("b", "f")], 5: []}
    made = [(d, 0, [(w, "X") for w in words], own[d]) for d, words in rows]
    df = spark.createDataFrame(made, "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>, own array<struct<word:string,grp:string>>")
    listed = df.select("doc_id", F.explode("own").alias("o")).select("doc_id", "o.grp", "o.word")
    for lexicons in ("own", listed):
        got = bias.own_counts(df if lexicons == "own" else df.drop("own"), lexicons, ["m", "f"], bias.fixed(4))
        assert {r["word"]: (r["discrete_m"], r["discrete_f"]) for r in got.collect()} == windows_by_hand(rows, own, 4)
    with pytest.raises(Exception, match="unknown group"):
        bias.own_counts(df.withColumn("own", bias.own_entries(F.transform("own", lambda o: F.struct(o["word"].alias("word"), o["grp"].alias("grp"), F.lit(True).alias("include"))), ["m"])), "own", ["m"]).collect()


def test_a_long_paragraph_is_not_copied_for_each_of_its_tokens(spark):
    """20,000 words in a line: a copy of the line for each word would be 25 GB."""
    texts = spark.createDataFrame([(1, "he said " * 10_000)], "doc_id long, text string")
    tokens = bias.regex_tokens(bias.paragraphs(texts)).select("doc_id", "par_id", "tokens")
    got = bias.own_counts(tokens.withColumn("own", F.array(F.struct(F.lit("he").alias("word"), F.lit("m").alias("grp")))), "own", ["m"], bias.fixed(1))
    assert {r["word"]: r["discrete_m"] for r in got.collect()} == {"he": 10_000, "said": 19_999}
    assert bias.group_counts(tokens, {"m": ["he"]}).first()["n"] == 10_000


def test_seeds_are_counted_in_one_reading(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    made = [(1, 0, [("w7", "X"), ("x", "X"), ("w299", "X")]), (2, 0, [("v1", "X"), ("w7", "X")])]
    spark.createDataFrame(made, "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>").write.parquet(str(tmp_path / "t"))
    got = bias.group_counts(spark.read.parquet(str(tmp_path / "t")), {"w": words, "v": ["v1", "w7"]})
    assert {tuple(r) for r in got.collect()} == {("w", 3, 1.0), ("v", 3, 1.0)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


@pytest.mark.parametrize("lexicon", [{"m": ["he", "al"], "f": ["she", "he"]}, {"m": {"X": ["he", "12"]}, "f": {"NUM": ["12"], "X": ["she"]}}])
def test_seed_counts_look_at_each_token_alone(spark, lexicon):
    texts = spark.createDataFrame([(1, "He, she he\n12 al"), (2, ""), (3, None), (4, "x 12 She")], "doc_id long, text string")
    lines = bias.paragraphs(texts).select("doc_id", "par_id", "paragraph")
    rows = bias.regex_rows(lines)
    tokens = bias.regex_tokens(lines).select("doc_id", "par_id", "tokens")
    by_hand = lambda some: sorted(map(str, some.collect()))
    assert by_hand(rows.select("seed")) == by_hand(tokens.select(F.explode("tokens").alias("seed")))
    for person in (None, F.col("seed.word") != "she"):
        placed = bias.seeds(tokens, lexicon, person).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        for table in (rows, tokens):
            assert by_hand(bias.group_counts(table, lexicon, person=person).select("grp", "n")) == by_hand(placed)
    counted = bias.group_counts(rows, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in counted and "transform(" not in counted


@pytest.mark.parametrize("lexicon", [{"m": ["a", "d"], "f": ["b", "a"]}, {"m": {"X": ["a"]}, "f": {"Y": ["a", "b"], "X": ["c"]}}])
def test_counts_and_global_counts_of_one_reading(spark, monkeypatch, lexicon):
    monkeypatch.setattr(bias, "PIECE", 5)
    tagged = lambda text: [(w, "PUNCT" if w == "." else "Y" if k % 3 == 0 else "X") for k, w in enumerate(text)]
    texts = ["abcde.1ab" * 4, "cba", "", "dddd", "xyz.zz", "9a9"]
    tokens = spark.createDataFrame([(i, 0, tagged(x)) for i, x in enumerate(texts)], "doc_id long, par_id int, tokens array<struct<word:string,pos:string>>")
    apart = bias.bias_counts(tokens, lexicon, bias.continual(0.5, 3)).join(bias.global_counts(tokens), ["word", "pos"], "left")
    at_once = bias.all_counts(tokens, lexicon, bias.continual(0.5, 3)).select(*apart.columns)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(at_once) == rounded(apart) and len(rounded(apart)) > 5


def test_person_and_baselines(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    v = F.array(F.lit(1.0), F.lit(0.1))
    assert one(sensors.is_person(v, [1, 0], [0, 1])) is True and one(sensors.is_person(F.lit(None).cast("array<double>"), [1, 0], [0, 1])) is False
    assert one(sensors.summed_vectors(F.array(v, v), 2)) == [2.0, 0.2]
    assert one(sensors.baseline("always-both", "id", {"m": 0.5, "f": 0.5})) == ["f", "m"] and one(sensors.baseline("always-none", "id", {"m": 1})) == []
    assert one(sensors.baseline("random", "id", {"m": 1.0})) == ["m"]


def test_mitigation_and_model_report(spark):
    rows = [(i, "ab"[i % 2], int(i % 4 < 2), [int(i % 4 < 2), int(i % 2 == 0), int(i % 4 < 2) if i % 8 else 0]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, g string, gold int, preds array<int>")
    found = search.mitigate(df, 3, ["g"], 1, detriment=0.2)
    assert found["best_single"] == 1.0 and found["accuracy"] >= 0.8 and found["statistical_parity"] == 0
    wide = df.withColumns({f"m{i}": F.col("preds")[i] for i in range(3)})
    report = {r["model"]: r for r in search.model_report(wide, {"one": "m0", "two": "m1", "bad": "none"}, ["g"], "gold", 1).collect()}
    assert report["one"]["accuracy"] == 1 and report["two"]["statistical_parity"] == 1 and report["bad"]["error"] and report["bad"]["accuracy"] is None


def test_pareto_fronts_of_three_objectives_are_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(i, float(r.randrange(6)), float(r.randrange(6)), float(r.randrange(6))) for i in range(150)] + [(900, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    better = lambda a, b: a[1] >= b[1] and a[2] >= b[2] and a[3] <= b[3] and a[1:] != b[1:]
    left, expected, k = [x for x in rows if x[1] is not None], {900: None}, 0
    while left:
        now = [x for x in left if not any(better(o, x) for o in left)]
        expected |= {x[0]: k for x in now}
        left, k = [x for x in left if x not in now], k + 1
    assert {x["id"]: x["front"] for x in pareto.fronts(df, ["x", "y", "z"], [True, True, False]).collect()} == expected
    assert {x["id"] for x in pareto.front(df, ["x", "y", "z"], [True, True, False]).collect()} == {i for i, f in expected.items() if f == 0}


def test_a_thousand_pareto_fronts(spark):
    df = spark.range(3000).select("id", (F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 1000).cast("double").alias("y"))
    got = pareto.fronts(df, ["x", "y"], [True, True])
    assert got.where(F.col("front") != 999 - F.col("x")).count() == 0 and got.count() == 3000


def test_fuzzy_matches_are_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    names = ["".join(r.choice("abz é") for _ in range(r.randint(1, 9))) for _ in range(60)]
    a, b = set(names[:30]), set(names[25:])
    got = {(x["entity"], x["person"]): x["ratio"] for x in sensors.fuzzy_matches(spark.createDataFrame([(x,) for x in a], "entity string"), spark.createDataFrame([(x,) for x in b], "person string")).collect()}
    ratios = {(x, y): SequenceMatcher(None, y, x).ratio() for x in a for y in b}
    assert got == {k: v for k, v in ratios.items() if v >= 0.6} and len(got) > 20


def test_stratified_places_are_those_of_the_whole_stratum(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.lit(None).cast("string").alias("h"))
    split = sampling.stratified_split(df, "id", ["g", "h"], 0.25, seed=5)
    counts = {r["g"]: (r["n"], r["t"]) for r in split.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert counts == {g: (n, round(n * 0.25)) for g, (n, _) in counts.items()} and sum(n for n, _ in counts.values()) == 5000
    hashed = split.withColumn("x", F.xxhash64(F.lit(5), "id")).groupBy("g").agg(F.max(F.when(F.col("split") == "test", F.col("x"))).alias("a"), F.min(F.when(F.col("split") == "train", F.col("x"))).alias("b"))
    assert all(r["a"] < r["b"] for r in hashed.collect())


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_samples_are_the_first_of_each_stratum(spark, monkeypatch, bits):
    """Rows with one id twice too; only the slice in which a size falls is ranked."""
    monkeypatch.setattr(sampling, "SLICE_BITS", bits)
    df = spark.range(600).select((F.col("id") % 590).alias("id"), (F.col("id") % 5).alias("g"))
    hashes = sorted((r["g"], r["x"]) for r in df.select("g", F.xxhash64(F.lit(3), "id").alias("x")).collect())
    wanted = {0: 0, 1: 1, 2: 57, 3: 120, 4: 500}
    sizes = spark.createDataFrame(list(wanted.items()), "g long, size long")
    got = sampling.stratified_sample(df, "id", ["g"], sizes, seed=3).select("g", F.xxhash64(F.lit(3), "id").alias("x"))
    assert sorted(map(tuple, got.collect())) == [h for g, n in wanted.items() for h in [h for h in hashes if h[0] == g][:n]]
    assert sampling._first(df, "id", ["g"], 3, lambda s: s.withColumn("__size", F.lit(9))).count() == 600


def test_orders_are_dealt_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    """A part has as many rows however large the table is."""
    monkeypatch.setattr(views, "PART_ROWS", 100)
    items = spark.range(3000).select((F.col("id") % 1000).alias("l_orderkey"), F.when(F.col("id") < 2500, F.element_at(F.array(F.lit("R"), F.lit("A")), (F.col("id") % 2 + 1).cast("int"))).alias("l_returnflag"), F.when(F.col("id") % 7 > 0, F.lit(20.0) + F.col("id") % 11).alias("l_quantity"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1001).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    held = {k: (set(), set()) for k in range(1001)}
    for r in items.collect():
        if r["l_returnflag"]:
            held[r["l_orderkey"]][0].add(r["l_returnflag"])
            if (r["l_quantity"] or 0) >= 25:
                held[r["l_orderkey"]][1].add(r["l_returnflag"])
    got = views.orders(spark, str(tmp_path))
    assert {r["o_orderkey"]: (r["groups"], r["pred_groups"]) for r in got.collect()} == {k: (sorted(a), sorted(b)) for k, (a, b) in held.items()}
    assert views.dealt(spark.read.parquet(str(tmp_path / "lineitem.parquet")), "l_orderkey").rdd.getNumPartitions() == 30


def test_running_sums(spark):
    df = spark.createDataFrame([([float(i % 7) for i in range(n)],) for n in (0, 1, 127, 128, 129, 400)], "v array<double>")
    for r in df.select("v", bias.running_sums(F.col("v")).alias("s")).collect():
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]) + 1)]


def test_confidence_margin_is_the_t_interval(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 7, 11)], "x double")
    row = stats.confidence(df, "x").first()
    assert row["n"] == 5 and near(row["margin"], 2.7764451051977934 * row["stdev"] / 5**0.5)
    assert stats.confidence(df.limit(1), "x").first()["margin"] is None


def test_sensors_of_a_replayed_search():
    from paritas.operators import embedding

    first = search.Choices(seed=3)
    made, run = embedding.chosen(first), embedding.chosen_sensors(first, forced=["embedding"])
    again = search.Choices(first.log)
    assert embedding.chosen(again) == made and embedding.chosen_sensors(again, forced=["embedding"]) == run and "embedding" in run["sensors"]
    with pytest.raises(ValueError):
        embedding.Configuration(("words",), (), ())


def test_tagged_tokens_and_own_lexicons_in_the_front_end(spark):
    fields = "struct<text:string,lower:string,lemma:string,pos:string,gender:string,definite:string>"
    tagged = {"a": [("He", "he", "he", "PRON"), (" ", " ", " ", "SPACE"), ("Runs", "runs", "run", "VERB"), ("Rome", "rome", "rome", "PROPN")]}
    table = spark.createDataFrame([(1, [(*t, None, None) for t in tagged["a"]])], f"doc_id long, tokens array<{fields}>")
    score = bias.BiasScore({"male": ["he"], "female": ["she"]}, bias.fixed(), tokens=lambda _: table.withColumn("par_id", F.lit(0)), tagged=True)
    texts = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert {r["word"] for r in score.scores(texts).collect()} == {"he", "run", "Rome"}
    own = spark.createDataFrame([(1, "female", "run")], "doc_id long, grp string, word string")
    score = bias.BiasScore({"male": [], "female": []}, bias.fixed(), tokens=lambda _: table.withColumn("par_id", F.lit(0)), tagged=True, own_lexicons=own)
    score.groups = ["male", "female"]
    assert {r["word"]: r["discrete_female"] for r in score.scores(texts).collect()} == {"he": 1, "run": 1, "Rome": 1}
    bad = spark.createDataFrame([(1, "other", "run")], "doc_id long, grp string, word string")
    with pytest.raises(Exception, match="unknown group"):
        bias.seeds_by_text(score.token_table(texts), bad, ["male", "female"]).collect()
