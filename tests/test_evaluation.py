"""Paged sources, sensors run end to end, kernel features, limits of reports."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.operators import bias, embedding, ensemble, evaluation, fairness, sensors
from paritas.sources import paged, readers

# --- paged sources ---------------------------------------------------------------------------------------------------------------


def pages(tmp_path, rows, size, wrap=lambda part: {"total": 0, "rows": part}, extra=1):
    n = -(-len(rows) // size) + extra
    for k in range(n):
        (tmp_path / f"page-{k}.json").write_text(json.dumps(wrap(rows[k * size : (k + 1) * size])))
    return f"{tmp_path.as_uri()}/page-{{page}}.json", n


def test_pages_come_back_equal(spark, tmp_path):
    rows = [{"id": i, "name": f"né {i}", "share": i / 4, "ok": i % 2 == 0, "tags": ["a", str(i)], "in": {"deep": i}} for i in range(23)]
    url, n = pages(tmp_path, rows, 5)  # the last page is empty
    got = paged.paged(spark, "id long, name string, share double, ok boolean, tags array<string>, `in.deep` int", url, pages=n, items="rows")
    assert got.rdd.getNumPartitions() == n == 6
    assert sorted(tuple(r) for r in got.collect()) == [(r["id"], r["name"], r["share"], r["ok"], r["tags"], r["id"]) for r in rows]
    assert got.where("id % 2 = 1").count() == 11 and got.select("name").count() == 23


@pytest.mark.parametrize("most, parts", [(3, 3), (1, 1), (7, 6), (None, 6)])
def test_a_partition_reads_several_pages(spark, tmp_path, most, parts):
    url, n = pages(tmp_path, [{"x": i} for i in range(23)], 5)
    got = paged.paged(spark, "x int", url, pages=n, items="rows", **({"partitions": most} if most else {}))
    assert got.rdd.getNumPartitions() == parts and [r["x"] for r in got.collect()] == list(range(23))


def test_pages_are_counted_by_the_first_one(spark, tmp_path):
    rows = [{"x": i} for i in range(11)]
    for k in range(4):
        (tmp_path / f"at-{3 * k}.json").write_text(json.dumps({"head": {"total": 11}, "rows": rows[3 * k : 3 * k + 3]}))
    got = paged.paged(spark, "x int", f"{tmp_path.as_uri()}/at-{{offset}}.json", total="head.total", size=3, items="rows")
    assert got.rdd.getNumPartitions() == 4 and sorted(r["x"] for r in got.collect()) == list(range(11))


def test_cells_that_do_not_fit_are_null(spark, tmp_path):
    (tmp_path / "p").write_text(json.dumps([{"n": "seven", "b": "TRUE", "s": {"k": 1}, "l": 5}, {"n": "7"}, 3, {}]))
    (tmp_path / "q").write_text("")
    read = lambda name: sorted(map(str, paged.paged(spark, "n int, b boolean, s string, l array<int>", f"{tmp_path.as_uri()}/{name}", pages=1).collect()))
    assert read("p") == sorted(["Row(n=None, b=True, s='{\"k\": 1}', l=None)", "Row(n=7, b=None, s=None, l=None)", *["Row(n=None, b=None, s=None, l=None)"] * 2])
    assert read("q") == []


def test_requests_are_made_again(tmp_path):
    asked = []

    def flaky(url, headers):
        asked.append((url, headers))
        if len(asked) < 3:
            raise paged.Passing("429")
        return b'[{"x": 1}]'

    import sys
    import types

    sys.modules["flaky_pages"] = types.SimpleNamespace(get=flaky)
    options = {"url": "http://h/{page}?o={offset}", "fetch": "flaky_pages:get", "wait": "0", "size": "10", "headers": '{"a": "b"}', "pages": "2"}
    assert paged.fetched("http://h/1", options) == [{"x": 1}] and asked == [("http://h/1", {"a": "b"})] * 3
    asked.clear()
    with pytest.raises(paged.Passing):
        paged.fetched("http://h/1", options | {"attempts": "2"})
    from pyspark.sql.types import IntegerType, StructType

    reader = paged.PagedReader(StructType().add("x", IntegerType()), options)
    assert [p.page for p in reader.partitions()] == [0, 1] and list(reader.read(paged.Page(1))) == [(1,)] and asked[-1][0] == "http://h/1?o=10"
    with pytest.raises(ValueError):
        paged.PagedReader(StructType(), {"url": "x"}).partitions()


def test_pages_of_people_and_profiles(spark, tmp_path):
    cell = lambda v: {"type": "uri", "value": v}
    rows = [{"who": cell("http://k/resource/Ada_Lovelace"), "gender": cell("female")}, {"who": cell("http://k/Alan_Turing/"), "gender": cell("http://k/Male")}]
    url, n = pages(tmp_path, [*rows, rows[0]], 2, lambda part: {"results": {"bindings": part}})
    got = paged.knowledge_pages(spark, url, pages=n)
    assert sorted(map(tuple, got.collect())) == [("Ada Lovelace", "female"), ("Alan Turing", "Male")]
    (tmp_path / "u.json").write_text(json.dumps({"data": [{"username": "a", "name": "A B"}, {"username": "b"}]}))
    assert sorted(map(str, paged.profile_pages(spark, f"{tmp_path.as_uri()}/u.json", pages=1).collect())) == ["Row(username='a', name='A B')", "Row(username='b', name=None)"]


# --- sensors end to end -------------------------------------------------------------------------------------------------------------


def reviews():
    rows = [(0, "he said it", ["male"], "positive"), (1, "she came", ["female"], "negative"), (2, "she and he", ["female", "male"], "positive"), (3, "nobody", [], "negative"), (4, None, ["male"], "positive"), (5, "he", None, "negative")]
    return rows


def test_a_run_annotates_scores_and_compares(spark, tmp_path):
    df = spark.createDataFrame(reviews(), "doc_id long, text string, gold array<string>, target string")
    words = sensors.words_of(F.coalesce("text", F.lit("")))
    handlers = {"lexicon": evaluation.of_column(lambda d: sensors.lexicon_sensor(words, {"male": ["he"]})), "she": lambda d: d.where("text like '%she%'").select("doc_id", F.array(F.lit("female")).alias("values"))}
    told, scores, fair = evaluation.evaluated(df, handlers, "gold", ["male", "female"], "target", "positive", path=str(tmp_path / "out"))
    got = {r["doc_id"]: (r["lexicon"], r["she"], r["Handler"]) for r in told.collect()}
    assert got == {0: (["male"], [], ["male"]), 1: ([], ["female"], ["female"]), 2: (["male"], ["female"], ["female", "male"]), 3: ([], [], []), 4: ([], [], []), 5: (["male"], [], ["male"])}
    by = {(r["predicted"], r["label"]): (r["precision"], r["recall"], r["f1"]) for r in scores.collect()}
    assert by["Handler", "male"] == (1.0, pytest.approx(2 / 3), pytest.approx(0.8)) and by["she", "male"] == (0.0, 0.0, 0.0) and by["she", "female"] == (1.0, 1.0, 1.0)
    true = {(r["metric"], r["mode"]): (r["true_value"], r["estimated_value"]) for r in fair.collect()}
    # male: 3 of 3 positive by gold, 2 of 3 as found; female: 1 of 2 both ways
    assert true["statistical_parity", "difference"] == (0.5, pytest.approx(0.167, abs=1e-9))
    dumped = {r["doc_id"]: r["Handler"] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert dumped["2"] == "female & male"
    assert evaluation.summary(told.where("gold is not null"), "gold", ["male", "female"]).first()["micro_accuracy"] == pytest.approx(4 / 5)
    assert {r["class"] for r in evaluation.summary(told.where("gold is not null"), "gold", ["male", "female"], neutral="none").collect()} == {"male", "female", "none"}
    with pytest.raises(ValueError):
        evaluation.annotated(df, {})
    with pytest.raises(ValueError):
        evaluation.annotated(df, {"gold": handlers["she"]})


def test_the_run_over_reviews(spark):
    df = spark.createDataFrame([(0, "he went. nothing", ["male"], "positive"), (1, "she came", ["female"], "negative"), (2, "none", [], "positive")], "review_id long, Review string, Gender array<string>, Sentiment string")
    vectors = spark.createDataFrame([("he", [1.0, 0.05]), ("she", [0.05, 1.0]), ("nothing", [0.7, 0.7]), ("went", [0.7, 0.71])], "word string, vector array<double>")
    told, scores, fair = evaluation.review_run(df, vectors, {"male": [1.0, 0.0], "female": [0.0, 1.0]})
    expected = {r["review_id"]: r["values"] for r in embedding.annotate(df, vectors, {"male": [1.0, 0.0], "female": [0.0, 1.0]}, embedding.HIERARCHY, "review_id", "Review").collect()}
    assert {r["review_id"]: r["EmbeddingBasedSensor"] for r in told.collect()} == expected and expected[0] == ["male"] and expected[1] == ["female"]
    assert scores.count() == 4 and fair.count() == 4


# --- kernel features ------------------------------------------------------------------------------------------------------------------


def test_fourier_features_come_near_the_kernel(spark):
    r = np.random.default_rng(3)
    points = r.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    n, gamma = 1000, 0.4
    rows = np.array([x["f"] for x in df.select("id", ensemble.fourier_features(["a", "b", "c"], n, gamma, 7).alias("f")).orderBy("id").collect()])
    exact = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert np.abs(rows @ rows.T - exact).max() < 5 / math.sqrt(n) and np.abs(rows @ rows.T - exact).mean() < 1 / math.sqrt(n)
    with pytest.raises(ValueError):
        ensemble.fourier_features(["a"], 0)


def ring(n=300, seed=1):
    r = np.random.default_rng(seed)
    angle, radius = r.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2 == 0, 1.0, 3.0) + 0.2 * r.normal(size=n)
    return [(i, float(s * np.cos(a)), float(s * np.sin(a)), ("inner", "outer")[i % 2]) for i, (a, s) in enumerate(zip(angle, radius))]


def test_kernel_vectors_part_rings_that_linear_ones_cannot(spark):
    df = spark.createDataFrame(ring(), "id int, x double, y double, gold string")
    model = ensemble.KernelSVC(["x", "y"], n=100, gamma=0.5, seed=2, maxIter=30, regParam=0.001).fit(df.where("id < 200"), "gold")
    told = model.predict(df.where("id >= 200"))
    assert told.where("prediction = gold").count() >= 95 and told.columns == [*df.columns, "prediction"]
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(df.withColumn("g", (F.col("gold") == "outer").cast("double")))
    linear = ensemble.base_model("svc", featuresCol="v", labelCol="g").fit(plain.where("id < 200")).transform(plain.where("id >= 200"))
    assert linear.where("prediction = g").count() < 75


def test_kernel_vectors_of_three_labels(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(k * 3 + 0.3 * r.normal()), "abc"[k]) for i, k in enumerate(r.integers(0, 3, 150))]
    df = spark.createDataFrame([*rows, (900, 0.1, None)], "id int, x double, gold string")
    told = ensemble.KernelSVC(["x"], n=60, gamma=0.3, maxIter=20).fit(df, "gold").predict(df)
    assert told.where("prediction = gold").count() >= 145 and told.where("id = 900").first()["prediction"] == "a"
    with pytest.raises(ValueError):
        ensemble.KernelSVC(["x"]).fit(df.where("gold = 'a'"), "gold")


# --- limits ----------------------------------------------------------------------------------------------------------------------------


def test_concordance_with_a_limit_says_how_many_there_are(spark):
    lines = spark.createDataFrame([(0, " ; ".join(f"he likes w{i} much" for i in range(9)))], "doc_id int, paragraph string")
    tokens = bias.regex_tokens(lines, pattern=r"\p{L}+[0-9]*|;").withColumn("par_id", F.lit(0))
    whole = {r["word"]: r for r in bias.concordance(tokens, {"male": ["he"]}, bias.fixed(2)).collect()}
    some = {r["word"]: r for r in bias.concordance(tokens, {"male": ["he"]}, bias.fixed(2), most=4).collect()}
    assert set(whole) == set(some) and whole["likes"]["n"] == some["likes"]["n"] == len(whole["likes"]["matches"]) == 9
    assert some["likes"]["matches"] == sorted(whole["likes"]["matches"])[:4]
    assert bias.snippets(tokens, {"male": ["he"]}, bias.fixed(2)).where("word = 'likes'").count() == 9


def test_too_many_target_values_are_refused(spark):
    df = spark.range(150).select(F.col("id").cast("string").alias("target"), F.lit("a & b").alias("joined"))
    with pytest.raises(ValueError):
        fairness.by_target_value(df, "joined", "target")
    assert fairness.by_target_value(df.where("target < '2'"), "joined", "target").count() > 0


def test_every_code_of_the_credit_file_has_a_column():
    assert len(readers.GERMAN_COLUMNS) == 20 and set(readers.GERMAN_NUMBERS) <= set(readers.GERMAN_COLUMNS) and len(readers.GERMAN_NUMBERS) == 7
    assert len({c[: -1 if len(c) < 4 else 3] if c != "A410" else "A4" for c in readers.GERMAN_CODES}) == 13


def test_annotations_of_stories_with_any_mark(spark):
    from paritas.functions import text as T

    lines = ["doctor - M", "nurse= f", "sky –N", "day ‑ Ｍ", "well-known - F", "no mark here", "x - Q", "a - b - M", "", "rosa =Ｆ"]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "t string")
    rows = df.select(T.story_annotations(F.col("t")).alias("a"), T.skipped_annotations(F.col("t")).alias("s")).collect()
    got = [(a["word"], a["include"], a["group"]) for a in rows[0]["a"]]
    assert got == [("doctor", True, "male"), ("nurse", True, "female"), ("sky", False, None), ("day", True, "male"), ("well-known", True, "female"), ("rosa", True, "female")]
    assert rows[0]["s"] == ["no mark here", "x - Q", "a - b - M"] and rows[1]["a"] is None and rows[2]["a"] == []


def test_themes_are_named_with_fallbacks(spark):
    from paritas.operators import reports

    scores = spark.createDataFrame([("m", "1", "1a", 0.5), ("m", "2", "2b", 0.1), ("m", "1", "9", 0.2), ("other", "1", "1a", 0.3)], "model string, theme string, subtheme string, score double")
    names = spark.createDataFrame([("m", "1", "Work", "1a", "Law", "male"), ("m", "2", "", "2b", None, None)], "model string, theme string, theme_name string, subtheme string, subtheme_name string, expected string")
    got = {(r["model"], r["theme"], r["subtheme"]): (r["theme_key"], r["subtheme_key"], r["expected"], r["score"]) for r in reports.named_themes(scores, names).collect()}
    assert got == {("m", "1", "1a"): ("1 [Work]", "1a [Law]", "male", 0.5), ("m", "2", "2b"): ("2", "2b", "neutral", 0.1), ("m", "1", "9"): ("1 [Work]", "9", "neutral", 0.2), ("other", "1", "1a"): ("1", "1a", "neutral", 0.3)}
