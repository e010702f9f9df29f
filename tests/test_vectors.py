"""Debiased vectors, sub-words, names in text, tags, quantiles and fronts against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.operators import bias, debias, gazetteer, pareto, quantiles, sensors, tagging

# --- vectors --------------------------------------------------------------------------------------------------------------------


def word_rows(seed=1, n=40, size=12):
    r = np.random.default_rng(seed)
    bias_of = r.normal(size=size)
    bias_of /= np.linalg.norm(bias_of)
    rows = [(f"w{i}", (r.normal(size=size) + 0.3 * bias_of).tolist()) for i in range(n)]
    pairs = []
    for i in range(6):
        base = r.normal(size=size)
        rows += [(f"m{i}", (base + 2 * bias_of + 0.1 * r.normal(size=size)).tolist()), (f"f{i}", (base - 2 * bias_of + 0.1 * r.normal(size=size)).tolist())]
        pairs.append((f"m{i}", f"f{i}"))
    return rows, pairs, bias_of


def test_direction_is_the_principal_one_of_the_pairs(spark):
    rows, pairs, planted = word_rows()
    vectors = spark.createDataFrame(rows, "word string, vector array<double>")
    got = np.array(debias.bias_direction(vectors, spark.createDataFrame([*pairs, ("m0", "unknown"), pairs[0]], "a string, b string")))
    known = {w: np.array(v) / np.linalg.norm(v) for w, v in rows}
    half = np.array([(known[a] - known[b]) / 2 for a, b in pairs])
    _, _, v = np.linalg.svd(half)
    assert np.abs(got @ v[0]) == pytest.approx(1) and np.linalg.norm(got) == pytest.approx(1)
    assert got @ planted > 0.97 and (half @ got).sum() > 0
    with pytest.raises(ValueError):
        debias.bias_direction(vectors, spark.createDataFrame([("a", "b")], "a string, b string"))


def test_debiased_vectors_are_by_hand(spark):
    rows, pairs, planted = word_rows(2)
    rows += [("zero", [0.0] * 12), ("none", None), ("m1", rows[3][1])]
    vectors = spark.createDataFrame(rows, "word string, vector array<double>")
    specific = ["w3", "m5", "nowhere"]
    out = debias.debiased(vectors, (3 * planted).tolist(), spark.createDataFrame([(w,) for w in specific], "word string"), spark.createDataFrame([*pairs[:3], ("m2", "w1"), ("m9", "w2")], "a string, b string"))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    known = {}
    for w, v in rows:
        if v is not None:
            known[w] = min(known.get(w, unit(v).tolist()), unit(v).tolist())
    equal = {}
    for a, b in sorted([*pairs[:3], ("m2", "w1")], reverse=True):
        x, y = np.array(known[a]), np.array(known[b])
        middle = (x + y) / 2
        flat = middle - middle @ planted * planted
        z = math.sqrt(max(0, 1 - flat @ flat)) * (-1 if (x - y) @ planted < 0 else 1)
        equal[a], equal[b] = flat + z * planted, flat - z * planted
    got = out.collect()
    assert len(got) == len(rows) and out.columns == vectors.columns
    for r in got:
        if r["word"] == "none":
            assert r["vector"] is None
            continue
        candidates = [unit(v) for w, v in rows if w == r["word"]]
        expected = [equal[r["word"]]] if r["word"] in equal else candidates if r["word"] in specific else [unit(v - v @ planted * planted) for v in candidates]
        assert any(np.allclose(r["vector"], e, atol=1e-9) for e in expected), r["word"]
    flat = {r["word"]: r["bias"] for r in debias.bias_along(out, planted.tolist()).collect()}
    assert abs(flat["w0"]) < 1e-9 and abs(flat["w3"]) > 1e-3 and flat["m0"] == pytest.approx(-flat["f0"])
    dots = {r["word"]: np.array(r["vector"]) for r in got if r["vector"]}
    assert dots["w7"] @ dots["m0"] == pytest.approx(dots["w7"] @ dots["f0"])  # a pair is as far from any neutral word


def test_subwords_are_summed_by_token(spark):
    rows = [(1, [(0, 5), (5, 9), (20, 22)], [(0, 3), (3, 7), (7, 9)], [[1.0, 0.0], [0.0, 2.0], [5.0, 5.0]]), (2, [], [(0, 1)], [[1.0, 1.0]]), (3, [(0, 4)], [], [])]
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, tokens {span}, pieces {span}, vectors array<array<double>>")
    got = {r["id"]: r["token_vectors"] for r in debias.subword_vectors(df).collect()}
    assert got == {1: [[1.0, 2.0], [5.0, 7.0], [0.0, 0.0]], 2: [], 3: [[0.0, 0.0]]}
    words = spark.createDataFrame([(["un", "happy"], ["unh", "##ap", "##py"])], "t array<string>, p array<string>")
    tokens, pieces = debias.aligned_pieces(F.col("t"), F.col("p"))
    assert [[tuple(x) for x in c] for c in words.select(tokens, pieces).first()] == [[(0, 2), (2, 7)], [(0, 3), (3, 5), (5, 7)]]


# --- names in text ----------------------------------------------------------------------------------------------------------------


def mentions_by_hand(text, names):
    low = gazetteer.lowered(text or "")
    word = lambda c: c.isalnum() or c == "_"
    found = []
    for name in {gazetteer.lowered(n) for n in names if n}:
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and word(low[at - 1])) and not (end < len(low) and word(low[end])):
                found.append((at, end, name))
            at = low.find(name, at + 1)
    taken = []
    for a, b, name in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, name))
    return sorted(taken)


NAMES = [("New York", "city"), ("York", "city"), ("york", "town"), ("new", "adj"), ("York City Hall", "place"), ("City", "n"), ("aa", "x"), ("aa aa", "y"), ("C++", "code"), ("İzmir", "city"), ("ÉCOLE", "n"), ("", "never"), (None, "never"), ("日本", "land"), (".", "dot")]
TEXTS = ["I went to New York City Hall.", "new york, NEW YORK; newyork new-york New  York", "aa aa aa aaa aa", "C++ and C++11 and c++.", "izmir İzmir iZMİR", "une école, l'École ÉCOLES", "日本 日本語", "", None, "York_ _York York", "..", "x" * 5000 + " new"]


@pytest.mark.parametrize("shard_bytes", [8 << 20, 12])
def test_mentions_are_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(gazetteer, "SHARD_BYTES", shard_bytes)
    r = random.Random(3)
    alphabet = ["a", "b", "ab", "ba", "a b", "c"]
    texts = [*TEXTS, *[" ".join(r.choices(alphabet, k=r.randint(1, 30))) for _ in range(40)]]
    names = [*NAMES, *[(" ".join(r.choices(alphabet, k=k)), f"v{k}") for k in (1, 2, 3, 4) for _ in range(5)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(names, "name string, value string")
    got = {x["doc_id"]: x["mentions"] for x in gazetteer.mentions(docs, table, value="value").collect()}
    values = {}
    for n, v in names:
        if n:
            values.setdefault(gazetteer.lowered(n), set()).add(v)
    for i, t in enumerate(texts):
        expected = mentions_by_hand(t, [n for n, _ in names])
        assert [(m["start"], m["end"], m["name"], m["values"]) for m in got[i]] == [(a, b, n, sorted(values[n])) for a, b, n in expected], t


def test_sensor_of_names_and_its_entities(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = spark.createDataFrame(NAMES, "name string, value string")
    got = {r["doc_id"]: r["values"] for r in gazetteer.gazetteer_sensor(docs, table, "value").collect()}
    assert got[0] == ["adj", "place"] and got[7] == got[8] == [] and got[6] == ["land"] and len(got) == len(TEXTS)
    told = gazetteer.entities(docs, table, "NAME", "value")
    by_entity = {r["doc_id"]: r["values"] for r in sensors.entity_sensor(told, ["NAME"]).collect()}
    assert by_entity == {k: v for k, v in got.items() if v}
    assert gazetteer.mentions(docs, table.limit(0)).where("size(mentions) > 0").count() == 0
    assert gazetteer.mentions(docs.limit(0), table).count() == 0


# --- tags ---------------------------------------------------------------------------------------------------------------------------

TAGGED = [
    ("the dog runs", "D N V"), ("a cat sees the dog", "D N V D N"), ("dogs run", "N V"), ("the run ends", "D N V"), ("she sees a run", "P V D N"), ("she runs", "P V"),
    ("walking helps", "N V"), ("the talking dog", "D A N"), ("a barking cat runs", "D A N V"),
]


def tagged_rows(spark):
    rows = [(w.split(), t.split()) for w, t in TAGGED] + [(["x"], ["N", "V"]), ([], []), (None, None), (["x", None], ["N", "V"])]
    return spark.createDataFrame(rows, "words array<string>, tags array<string>")


def test_many_sentences_at_once_are_tagged_as_each_alone():
    import numpy as np

    draw = np.random.default_rng(3)
    n, words = 5, [f"w{k}" for k in range(20)]
    logs = lambda *shape: np.log(draw.integers(1, 4, shape) / 10)  # noqa: E731 - few values, so that paths are equal
    model = tagging.Tagger(list("abcde"), logs(n), logs(n, n), logs(n), {w: logs(n) for w in words[:15]}, {"w16": logs(n)}, logs(n))
    sentences = [[words[k] for k in draw.integers(0, 20, size)] for size in [0, 1, 1, 2, 7, 7, 40, 3, 0, 200]]
    assert model.best_of_many(sentences) == [model.best(s) for s in sentences]
    assert model.best_of_many([]) == [] and model.best_of_many([[]]) == [[]]


def test_tagged_tokens_are_the_best_of_all_paths(spark):
    tagger = tagging.fit_tagger(tagged_rows(spark))
    assert tagger.tags == ["A", "D", "N", "P", "V"]
    texts = ["the dog runs", "she sees the walking cat", "a purring tiger", "run", "dogs see a new thing here", "jumping", "the the the"]
    sentences = spark.createDataFrame([(i, t.split(), 1) for i, t in enumerate(texts)] + [(90, [], 1), (91, None, 1), (92, ["dog", None], 1)], "id int, words array<string>, row int")
    got = {r["id"]: r["tags"] for r in tagging.tag(sentences, tagger).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        paths = [list(p) for p in itertools.product(tagger.tags, repeat=len(words))]
        best = max(tagger.score(words, p) for p in paths)
        assert tagger.score(words, got[i]) == pytest.approx(best), t
    assert got[0] == ["D", "N", "V"] and got[90] == got[91] == [] and len(got[92]) == 2


def test_tagger_counts_by_hand(spark):
    tagger = tagging.fit_tagger(tagged_rows(spark), added=0.5)
    firsts = [t.split()[0] for _, t in TAGGED]
    assert tagger.first[tagger.tags.index("D")] == pytest.approx(math.log((firsts.count("D") + 0.5) / (len(TAGGED) + 0.5 * 5)))
    pairs = [p for _, t in TAGGED for p in zip(t.split(), [*t.split()[1:], None])]
    d, n = tagger.tags.index("D"), tagger.tags.index("N")
    of_d = [b for a, b in pairs if a == "D"]
    assert tagger.follow[d, n] == pytest.approx(math.log((of_d.count("N") + 0.5) / (len(of_d) + 0.5 * 6)))
    words = [(w, t) for s, ts in TAGGED for w, t in zip(s.split(), ts.split())]
    kinds = len({w for w, _ in words})
    assert tagger.emission("dog")[n] == pytest.approx(math.log((words.count(("dog", "N")) + 0.5) / (sum(t == "N" for _, t in words) + 0.5 * (kinds + 1))))
    assert tagger.emission("meowing")[tagger.tags.index("A")] > tagger.emission("meowing")[d]  # as talking and barking
    with pytest.raises(ValueError):
        tagging.fit_tagger(tagged_rows(spark).where("false"))


def test_tags_feed_lexical_tokens(spark):
    tagger = tagging.fit_tagger(tagged_rows(spark))
    tagged = tagging.tag(spark.createDataFrame([(["The", "dogs", "runs"],)], "words array<string>"), tagger)
    lemmas = F.create_map(F.lit("dogs"), F.lit("dog"), F.lit("runs"), F.lit("run"))
    made = bias.lexical_tokens(tagged.select(tagging.tagged_tokens(F.col("words"), F.col("tags"), lemmas).alias("tokens")), ["he"]).first()["tokens"]
    assert [t["word"] for t in made] == ["the", "dog", "run"] and made[1]["pos"] == "N"


# --- quantiles ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("slices", "few"), [(1024, 1024), (64, 20)])
def test_quantiles_are_those_of_numpy(spark, monkeypatch, slices, few):
    monkeypatch.setattr(quantiles, "SLICES", slices)
    monkeypatch.setattr(quantiles, "FEW", few)
    r = np.random.default_rng(4)
    groups = {"hot": r.normal(size=3000).round(1), "one": np.array([7.5]), "same": np.full(50, -2.0), "wide": np.array([-1e300, 0, 1e-300, 1e300, 1.7e308, -1.7e308]), "skew": np.exp(r.normal(size=200) * 6), None: np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, some in groups.items() for x in some] + [("hot", None), ("hot", float("nan")), ("one", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows, "__x string, n double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["__x"]: r for r in quantiles.quantiles(df, ["__x"], "n", shares).collect()}
    assert set(got) == set(groups)
    for g, some in groups.items():
        s = np.sort(some)
        place = [(len(s) - 1) * p for p in shares]
        expected = [s[int(p)] if p == int(p) else s[int(p)] * (int(p) + 1 - p) + s[int(p) + 1] * (p - int(p)) for p in place]
        assert got[g]["quantiles"] == pytest.approx(expected, rel=1e-12) and got[g]["n"] == len(some)
        assert (got[g]["low"], got[g]["high"]) == (some.min(), some.max())


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(101).select(F.col("id").alias("x"))
    assert quantiles.quantiles(df, [], "x", [0.25, 0.5]).first()["quantiles"] == [25.0, 50.0]
    assert quantiles.quantiles(df.limit(0), ["x"], "x", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.quantiles(df, [], "x", [1.5])


# --- fronts in blocks -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3])
def test_fronts_of_many_blocks_are_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(pareto, "BLOCK", 60)
    monkeypatch.setattr(pareto, "BLOCK_OF_TWO", 60)
    r = random.Random(size)
    rows = [(i, *[float(r.randrange(15)) for _ in range(size)]) for i in range(260)]
    names = ["x", "y", "z"][:size]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    up = [True, False, True][:size]
    value = lambda p: tuple(v if u else -v for v, u in zip(p[1:], up))
    left, expected, k = list(rows), {}, 0
    while left:
        now = [p for p in left if not any(all(a >= b for a, b in zip(value(o), value(p))) and value(o) != value(p) for o in left)]
        expected |= {p[0]: k for p in now}
        left, k = [p for p in left if p not in now], k + 1
    assert {p["id"]: p["front"] for p in pareto.fronts(df, names, up).collect()} == expected
    assert {p["id"] for p in pareto.front(df, names, up).collect()} == {i for i, f in expected.items() if f == 0}


def test_fronts_of_a_line_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(pareto, "BLOCK", 40)
    df = spark.range(150).select("id", F.col("id").alias("x"), (-F.col("id")).alias("y"), (F.col("id") * 0).alias("z"))
    assert pareto.front(df, ["x", "y", "z"], [True, True, True]).count() == 150  # all on one front, more than a block
    assert pareto.fronts(df, ["x", "y", "z"], [True, False, True]).where("front != 149 - id").count() == 0
    assert pareto.fronts(df.limit(0), ["x", "y", "z"], [True] * 3).count() == 0
