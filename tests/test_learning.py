"""Search by generations, trained learners and mitigation."""

import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paritas.operators import evolve, search, training


# --- the search ---------------------------------------------------------------------------------------------------------------


def knobs(choices):
    return tuple(choices.choose(f"knob-{i}", range(8)) for i in range(6))


def planted(found):
    """Best at 3 everywhere."""
    return [(-float(sum(abs(x - 3) for x in c)),) for c in found]


def test_search_moves_towards_what_scores():
    met = []
    out = evolve.search_generations(knobs, lambda found: met.extend(found) or planted(found), [True], generations=25, population=20, selected=5, seed=4)
    assert max(s[0] for s in out.scores) >= -1 and len(met) <= 500  # of 262,144
    draws = random.Random(4)
    by_chance = planted([tuple(draws.randrange(8) for _ in range(6)) for _ in range(500)])
    assert max(out.scores) > max(by_chance)
    last = [s[0] for s, g in zip(out.scores, out.generation) if g == max(out.generation)]
    first = [s[0] for s, g in zip(out.scores, out.generation) if g == 0]
    assert sum(last) / len(last) > sum(first) / len(first) + 3


def test_search_is_seeded_and_its_log_replays():
    runs = [evolve.search_generations(knobs, planted, [True], generations=4, population=6, seed=s) for s in (1, 1, 2)]
    assert runs[0].logs == runs[1].logs != runs[2].logs
    for log, found in zip(runs[0].logs, runs[0].found):
        assert knobs(search.Choices(json.loads(json.dumps(log)))) == found
    with pytest.raises(ValueError):
        knobs(search.Choices([("other", 1), *runs[0].logs[0][1:]]))


def test_search_of_numbers_and_several():
    def made(choices):
        return choices.number("x", -4, 4), choices.several("of", "abcde", 2)

    out = evolve.search_generations(made, lambda found: [(-((x - 1.5) ** 2) + ("b" in s) + ("d" in s),) for x, s in found], [True], generations=20, population=12, seed=3)
    best = out.found[max(range(len(out.scores)), key=lambda i: out.scores[i])]
    assert best[1] == ("b", "d") and abs(best[0] - 1.5) < 0.5
    for log, found in zip(out.logs, out.found):
        assert made(evolve.Replayed(json.loads(json.dumps(log)))) == found
        assert made(evolve.Replayed(log[::-1], by_name=True)) == found
    with pytest.raises(ValueError):
        made(evolve.Replayed([("x", 5.0), ("of", ("a", "b"))]))
    with pytest.raises(ValueError):
        made(evolve.Replayed([("x", 1.0), ("of", ("a",))]))


def test_search_ends_when_the_space_is_met_and_passes_over_failures():
    asked = []

    def made(choices):
        a, b = choices.choose("a", range(4)), choices.choose("b", range(3))
        if a == 2:
            raise ValueError("cannot be built")
        return a, b

    def score(found):
        asked.extend(found)
        return [None if b == 1 else (float(a), float(-b)) for a, b in found]

    out = evolve.search_generations(made, score, [True, True], generations=None, population=3, explore=0.5, constraint=lambda c, s: c != (3, 0))
    assert sorted(asked) == [(a, b) for a in (0, 1, 3) for b in range(3)]  # each once
    assert sorted(out.found) == [(0, 0), (0, 2), (1, 0), (1, 2), (3, 2)]
    assert sorted(out.found[i] for i in out.front) == [(1, 0), (3, 2)]


def test_fronts_are_ordered_by_dominance():
    r = random.Random(1)
    points = [(r.randint(0, 6), r.randint(0, 6), r.randint(0, 2)) for _ in range(60)]
    up = (True, False, True)
    fronts = evolve.ordered(points, up)
    assert sorted(itertools.chain(*fronts)) == list(range(60))
    for k, front in enumerate(fronts):
        for i in front:
            beaten = [j for later in fronts[k:] for j in later if evolve.beats(points[j], points[i], up)]
            assert not beaten and (k == 0 or any(evolve.beats(points[j], points[i], up) for j in fronts[k - 1]))


def test_stored_scores_are_not_asked_again(spark, tmp_path):
    store = evolve.ScoreStore(spark, str(tmp_path / "scores"))
    asked = []

    def score(found):
        asked.extend(found)
        return planted(found)

    runs = [evolve.search_generations(knobs, score, [True], generations=3, population=5, seed=7, store=store) for _ in range(2)]
    assert runs[0].scores == runs[1].scores and runs[0].logs == runs[1].logs
    assert len(asked) == len(set(asked)) == len(runs[0].found)
    frame = runs[0].frame(spark)
    assert frame.count() == len(runs[0].found) and frame.where("best").count() == len(runs[0].front)
    store.add({"x": (1.0,), "y": (2.0,)})
    store.add({"x": (3.0,)})
    assert store.known(["x", "y", "z"]) == {"x": (1.0,), "y": (2.0,)}


# --- ensembles ------------------------------------------------------------------------------------------------------------------


def classified(n=300, seed=2, k=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        gold = r.choice("abc")
        rows.append((i, r.choice(["x", "y", None]), gold, [gold if r.random() < 0.4 + 0.1 * j else r.choice("abc") for j in range(k)]))
    return rows


SCORES = [0.5, 0.6, 0.6, 0.8]


def votes_by_hand(rows, kind, members, train, test):
    if kind == "voting":
        def vote(p):
            said = [p[i] for i in members]
            return max(set(said), key=lambda v: (said.count(v), max(SCORES[i] for i, w in zip(members, said) if w == v), -said.index(v)))
    elif kind == "overfit":
        seen = {}
        for i, _, gold, p in train:
            seen.setdefault(tuple(p[j] for j in members), Counter())[gold] += 1
        first = {}
        for i, _, gold, p in train:
            first.setdefault((tuple(p[j] for j in members), gold), i)
        best = max(members, key=lambda j: SCORES[j])

        def vote(p):
            key = tuple(p[j] for j in members)
            return max(seen[key], key=lambda g: (seen[key][g], -first[key, g])) if key in seen else p[best]
    else:
        golds = Counter(g for _, _, g, _ in train)
        told = Counter((j, p[j], g) for _, _, g, p in train for j in range(len(p)))
        kinds = {j: len({p[j] for _, _, _, p in train}) for j in members}

        def vote(p):
            return max(golds, key=lambda g: (round(math.log(golds[g]) + sum(math.log((told[j, p[j], g] + 1) / (golds[g] + kinds[j])) for j in members), 9), g))
    return {i: vote(p) for i, _, _, p in test}


@pytest.mark.parametrize("split", [None, 3])
def test_scores_of_ensembles_are_brute_force(spark, split):
    rows = classified()
    df = spark.createDataFrame(rows, "row_id long, grp string, gold string, preds array<string>")
    table = evolve.cells(df, ["grp"], train=None if split is None else F.col("row_id") % split != 0)
    candidates = [(kind, m) for kind in evolve.KINDS for size in (1, 2, 3, 4) for m in itertools.combinations(range(4), size)]
    got = {r["candidate"]: r for r in evolve.score_ensembles(table, candidates, SCORES, ["grp"], "a").collect()}
    train = [r for r in rows if split is None or r[0] % split]
    test = [r for r in rows if split is None or r[0] % split == 0]
    for c, (kind, members) in enumerate(candidates):
        vote = votes_by_hand(rows, kind, members, train, test)
        assert got[c]["accuracy"] == pytest.approx(sum(vote[i] == g for i, _, g, _ in test) / len(test)), (kind, members)
        shares = [sum(vote[i] == "a" for i, x, _, _ in test if x == grp) / sum(x == grp for _, x, _, _ in test) for grp in "xy"]
        assert got[c]["statistical_parity"] == pytest.approx(max(shares) - min(shares)), (kind, members)


def test_search_of_ensembles_keeps_the_detriment(spark):
    df = spark.createDataFrame(classified(), "row_id long, grp string, gold string, preds array<string>")
    single = [r["accuracy"] for r in search.score_votes(df, [(i,) for i in range(4)], {"accuracy": search.accuracy_metric}).orderBy("candidate").collect()]
    out = evolve.search_ensembles(evolve.cells(df, ["grp"]), 4, single, ["grp"], "a", generations=3, population=6, detriment=0.02, seed=5)
    assert out.found and all(s[0] >= max(single) - 0.02 for s in out.scores)
    for log, found in zip(out.logs, out.found):
        assert evolve.chosen_ensemble(evolve.Replayed(json.loads(json.dumps(log))), 4) == found


# --- learners --------------------------------------------------------------------------------------------------------------------


def table_rows(n=240, seed=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        gold = r.choice([0, 1])
        a, b, c = r.choice("pq") if r.random() < 0.3 else "pq"[gold], r.choice(["u", "v", None]), r.randint(0, 3) + gold
        out.append((i, a, b, c, r.choice(["m", "f"]), gold if i % 40 else None, r.randrange(4)))
    return [*out, (n, "only here", None, 9, "m", 1, 0), (n + 1, "p", "u", 0, None, None, 1)]


NAMES = ["a", "b", "c"]
LEARNERS = [("a",), ("b",), ("a", "b", "c"), ("c", "b")]


def bayes_by_hand(rows, seen, row, features):
    known = [x for x in seen if x[5] is not None]
    every = [x for x in rows if x[5] is not None]
    labels, value = sorted({x[5] for x in every}), lambda x, f: x[1 + NAMES.index(f)]
    scores = []
    for g in labels:
        own = [x for x in known if x[5] == g]
        s = math.log((len(own) + 1) / (len(known) + len(labels)))
        for f in features:
            if any(value(x, f) == value(row, f) for x in every):
                s += math.log((sum(value(x, f) == value(row, f) for x in own) + 1) / (len(own) + len({value(x, f) for x in every})))
        scores.append(round(s, 9))
    return labels[scores.index(max(scores))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, a string, b string, c int, grp string, gold int, fold int")


def test_out_of_fold_predictions_are_brute_force(spark):
    rows = table_rows()
    got = {r["row_id"]: r["preds"] for r in training.out_of_fold(frame(spark, rows), LEARNERS).collect()}
    assert len(got) == len(rows)
    for row in rows:
        others = [x for x in rows if x[6] != row[6]]
        assert got[row[0]] == [bayes_by_hand(rows, others, row, f) for f in LEARNERS], row


def test_a_model_of_all_rows_predicts_others(spark):
    rows, others = table_rows(), [(900 + i, "p" if i % 2 else "new", "u", 7, "m", None, 0) for i in range(6)]
    model = training.fit_bayes(frame(spark, rows), NAMES)
    got = {r["row_id"]: r["preds"] for r in training.predict_bayes(model, frame(spark, others), LEARNERS).collect()}
    assert got == {x[0]: [bayes_by_hand(rows, rows, x, f) for f in LEARNERS] for x in others}
    with pytest.raises(ValueError):
        training.predict_bayes(model, frame(spark, others), [("zzz",)])
    with pytest.raises(ValueError):
        training.fit_bayes(frame(spark, rows).withColumn("gold", F.col("row_id")), NAMES)


def test_a_learner_that_never_saw_its_fold_cannot_remember_it(spark):
    """A feature that names the row tells everything about rows that were seen, and nothing out of fold."""
    r = random.Random(1)
    rows = [(i, f"id{i}", "u", 0, "m", r.randint(0, 1), i % 5) for i in range(400)]
    model = training.fit_bayes(frame(spark, rows), ["a"])
    seen = training.predict_bayes(model, frame(spark, rows), [("a",)]).agg(F.avg((F.col("preds")[0] == F.col("gold")).cast("int"))).first()[0]
    unseen = training.out_of_fold(frame(spark, rows), [("a",)]).agg(F.avg((F.col("preds")[0] == F.col("gold")).cast("int"))).first()[0]
    assert seen == 1.0 and 0.3 < unseen < 0.7


@pytest.mark.parametrize("kinds", [("voting",), ("learning",), ("overfit",), evolve.KINDS])
def test_mitigation_trains_and_gives_the_fairest(spark, kinds):
    df = frame(spark, table_rows()).where("gold is not null")
    out, told = training.mitigate_trained(df, LEARNERS, ["grp"], 1, top=3, kinds=kinds, generations=None, population=6, explore=0.5)
    kind_of, best = out.found[out.front[0]][0], min(out.front, key=lambda i: (out.scores[i][1], -out.scores[i][0], len(out.found[i][1]), out.found[i]))
    assert kind_of in kinds and set(out.found[best][1]) <= set(range(4))
    rows = [r for r in told.select("grp", "gold", "prediction").collect()]
    assert sum(r["gold"] == r["prediction"] for r in rows) / len(rows) == pytest.approx(out.scores[best][0])
    shares = [sum(r["prediction"] == 1 for r in rows if r["grp"] == g) / sum(r["grp"] == g for r in rows) for g in "mf"]
    assert max(shares) - min(shares) == pytest.approx(out.scores[best][1])


def test_mitigation_without_any_allowed_ensemble(spark):
    df = frame(spark, table_rows()).where("gold is not null")
    out, told = training.mitigate_trained(df, LEARNERS, ["grp"], 1, top=3, kinds=("voting",), generations=1, population=3, detriment=-1.0)
    assert not out.found and told.where("prediction is null").count() == 0


def test_folds_are_seeded_shares(spark):
    rows = spark.range(3000).select("id", training.fold_of(F.col("id"), 5, 1).alias("f"), training.fold_of(F.col("id"), 5, 2).alias("g"))
    sizes = {r["f"]: r["count"] for r in rows.groupBy("f").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4] and min(sizes.values()) > 500 and rows.where("f != g").count() > 2000


# --- ensembles of pyspark.ml: rows that have one answer ----------------------------------------------------------------------------


def test_stacking_and_learning_find_the_classifier_that_is_right(spark):
    r = random.Random(8)
    rows = [(i, g, [r.randint(0, 1), g, r.randint(0, 1)]) for i in range(200) for g in [r.randint(0, 1)]]
    df = spark.createDataFrame(rows, "row_id long, gold int, preds array<int>")
    from paritas.operators import ensemble

    _, told = ensemble.stacking(df, 3)
    assert told.where("stacked = gold").count() == 200
    learnt = search.fit_ensemble(df, "learning", (0, 1), [0.5, 1.0, 0.5])(df, "said")
    assert learnt.where("said = gold").count() == 200 and "__some" not in learnt.columns
    blind = search.fit_ensemble(df, "learning", (0, 2), [0.5, 1.0, 0.5])(df, "said")
    assert blind.where("said = gold").count() < 160


def test_bagging_votes_as_the_line_that_parts_the_rows(spark):
    rows = [(i, float(i), float(i % 7), int(i >= 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, gold int")
    from paritas.operators import ensemble

    told = ensemble.bagging(df, ["x", "noise"], "gold", n_estimators=3, max_samples=0.7, seed=1)
    assert told.columns == [*df.columns, "bagged"] and told.where("bagged = gold").count() >= 115
