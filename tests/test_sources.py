"""Readers and writers over tiny files, and the streaming rates."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from paritas.sources import readers, sinks
from paritas.streaming.rates import windowed_rates


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_adult(spark, tmp_path):
    row = "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, "
    train, test = put(tmp_path, "a.data", f"{row}<=50K\n\n"), put(tmp_path, "a.test", f"|1x3 Cross validator\n{row}>50K.\n")
    got = {r["split"]: (r["age"], r["sex"], r["income"]) for r in readers.adult(spark, train, test).collect()}
    assert got == {"train": (39, "Male", "<=50K"), "test": (39, "Male", ">50K")}


def test_german(spark, tmp_path):
    cells = ["A11", "6", "A34", "A43", "1169", "A65", "A75", "4", "A93", "A101", "4", "A121", "67", "A143", "A152", "2", "A173", "1", "A192", "A201"]
    path = put(tmp_path, "g", " ".join(cells) + " 1\n" + "  ".join(cells) + " 2\n")
    rows = readers.german(spark, path, {"A11": "negative"}).collect()
    assert [r["risk"] for r in rows] == ["good", "bad"] and rows[0]["status of existing checking account"] == "negative" and rows[0]["purpose"] is None and rows[0]["age in years"] == 67
    told = readers.german(spark, path).first()
    assert told["purpose"] == "radio/television" and told["job"] == "skilled employee / official" and told["foreign worker"] == "yes" and told["credit amount"] == 1169
    assert readers.german(spark, path, None).first()["housing"] == "A152"
    numeric = put(tmp_path, "n", " 1 2 3 1 \n")
    assert tuple(readers.german_numeric(spark, numeric).first()) == (1, 2, 3, "good")
    cost = spark.createDataFrame([("bad", "good"), ("good", "bad"), ("bad", "bad")], "g string, p string")
    assert [r[0] for r in cost.select(readers.german_cost(F.col("g"), F.col("p"))).collect()] == [5, 1, 0]


def test_text_sets(spark, tmp_path):
    path = put(tmp_path, "r.csv", 'Review,Gender,Sentiment\n"a, ""b""","Male, female",positive\nc,,negative\n')
    assert {(r["Review"], tuple(r["Gender"])) for r in readers.reviews(spark, path).where("Gender is not null").collect()} >= {('a, "b"', ("female", "male"))}
    assert set(readers.reviews(spark, path, 0.5).columns) == {"Review", "Gender", "Sentiment", "split"}
    md = spark.createDataFrame([("t", 0, "certain", [0, 2, 3]), ("u", 1, "certain", [1]), ("v", 0, "unsure", [1])], "text string, class_type int, confidence string, labels array<int>")
    assert [tuple(r) for r in readers.md_gender(md).collect()] == [("t", "certain", 0, ["female", "female", "male"])]
    chat = spark.createDataFrame([("t", True, True), ("u", False, None)], "caption string, male boolean, female boolean")
    assert [r["Gender"] for r in readers.image_chat(chat).collect()] == [["male", "female"], []]
    fun = spark.createDataFrame([("t", 0), ("u", 2), ("v", 9)], "text string, gender int")
    assert [r["Gender"] for r in readers.funpedia(fun).collect()] == ["gender-neutral", "male", None]
    tox = spark.createDataFrame([("t", 0.5, 0.6), ("u", None, 0.9)], "comment_text string, male double, female double")
    assert [tuple(r) for r in readers.toxicity(tox).collect()] == [("t", ["female"])]


def test_files(spark, tmp_path):
    assert readers.c2gen(spark, put(tmp_path, "c.json", '{"context":"x","keywords":["a"]}\n')).first()["keywords"] == ["a"]
    one = put(tmp_path, "g.json", '{"concepts":["a"],"target":"t"}\n')
    assert readers.common_gen(spark, {"train": one, "test": one}).count() == 2
    assert readers.victoria(spark, put(tmp_path, "v.csv", "prompt;output\np;**bold** text\n")).first()["output"] == "bold text"
    put(tmp_path, "il/es/a.csv", "Sentence;Analysis\nhola;\"jefa - S,F\nmesa - N,F\"\n")
    row = readers.ilenia(spark, str(tmp_path / "il")).first()
    assert row["language"] == "es" and [a["word"] for a in row["Analysis"]] == ["jefa", "mesa"]
    assert readers.ilenia(spark, put(tmp_path, "il2/ca/x.txt", "una\ndues\n"), annotated=False).count() == 2
    put(tmp_path, "rho/m.tsv", 'id\tgroup\tlang\toutput\n1\tg\tes\t["Story 1: a","b","c","d"]\n2\tg\ten\t["a"]\n'.replace('["Story', '"[""Story').replace(': a","b","c","d"]', ': a"",""b"",""c"",""d""]"').replace('["a"]', '"[""a""]"'))
    assert readers.rhopa(spark, str(tmp_path / "rho"), "m", lang="es").first()["output"] == ["a", "b", "c", "d"]
    assert readers.rhopa(spark, str(tmp_path / "rho"), "m", lang="en").first()["output"] is None
    picked = readers.sampled_stories(readers.rhopa(spark, str(tmp_path / "rho"), "m", row_id="1"), "id").first()["output"]
    assert len(picked) == 2 and set(picked) < {"a", "b", "c", "d"}
    vil = readers.villanos(spark, put(tmp_path, "w.tsv", "text\tlabel\na\tVIOLENTO\nb\tNOVIOLENTO\nc\tX\n"))
    assert [r["Violent"] for r in vil.collect()] == ["yes", "no", None]
    gen = readers.villanos_gendered(spark, put(tmp_path, "x.csv", "text;label;mentions_male;mentions_female;target_male;target_female\na;2;1;1;0;1\nb;0;0;0;0;0\nc;;1;1;1;1\n"))
    assert [tuple(r) for r in gen.collect()] == [("a", "yes", ["male", "female"], ["female"]), ("b", "no", [], [])]
    assert readers.custom(spark, put(tmp_path, "k.csv", "a,b\n1,x\n")).dtypes == [("a", "int"), ("b", "string")]
    assert readers.sentences_tsv(spark, put(tmp_path, "s.tsv", "id\tsentence\n1\tHola\n2\t\n")).collect() == [("hola",)]
    words = {("m", "NOUN"): put(tmp_path, "m.csv", "rey \nactor\nrey\n"), ("f", "NOUN"): str(tmp_path / "missing.csv"), ("f", "ADJ"): put(tmp_path, "f.csv", "alta\nactor\n")}
    seeds = readers.seed_lexicon(spark, words, ignore=put(tmp_path, "i.csv", "alta\n"), professions=put(tmp_path, "p.csv", "actor\n"))
    assert {tuple(r) for r in seeds.collect()} == {("m", "NOUN", "rey"), ("f", "ADJ", "actor")}
    assert tuple(readers.names(spark, put(tmp_path, "names.csv", "name,assigned_gender,count\nana,1,5\n")).first()) == ("ana", "female", 5)
    base = spark.createDataFrame([("http://d/Ana", "http://d/female"), ("http://d/B", "")], "person string, property_value string")
    assert readers.knowledge_base(base).collect() == [("Ana", "Female")]
    put(tmp_path, "sc/m/es/t/s/a.scores.json", '{"x":1}')
    assert tuple(readers.score_files(spark, str(tmp_path / "sc")).first()) == ("m", "es", "t", "s", '{"x":1}')
    assert {tuple(r) for r in readers.metric_lines(spark, put(tmp_path, "j.json", '{"model":"m","a":1.5,"b":2.5}\n')).collect()} == {("m", "a", 1.5), ("m", "b", 2.5)}
    assert readers.theme_names(spark, put(tmp_path, "t.tsv", "lang\tkey\tname\nen\tk\told\nes\tk\tno\nen\tk\tnew\n")).collect() == [("k", "new")]
    df = spark.range(2)
    assert readers.all_data(df, None, df.limit(0)).count() == 2


def test_scores_are_written_in_order_and_every_row_is_placed(spark, tmp_path):
    rows = [(k, float(k % 3), f"w{k} x") for k in range(100, 0, -1)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_name string").repartition(7).write.parquet(str(tmp_path / "part.parquet"))
    by_hand = [k for k, score, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    got = sorted((r["place"], r["p_partkey"]) for r in __spark_entry__.queries()["write_scores"](spark, str(tmp_path)).collect())
    assert got == list(enumerate(by_hand, 1))


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("b", 2.0, ["x", "y"]), ("a", 1.0, [])], "word string, log_score double, matches array<string>")
    sinks.write_scores(scores, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).orderBy("log_score").first()["word"] == "a"
    assert sinks.write_sibling(scores.drop("matches"), str(tmp_path / "t.csv"), "z").endswith("t.z.csv")
    sinks.write_annotations(scores, str(tmp_path / "a"), ["matches"])
    assert "x & y" in {r["matches"] for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()}
    sinks.write_indicators(scores, str(tmp_path / "i"), "matches", ["x", "y"], "has")
    assert {(r["word"], r["has_x"]) for r in spark.read.csv(str(tmp_path / "i"), sep=";", header=True).collect()} == {("a", "0"), ("b", "1")}
    sinks.write_json(scores, str(tmp_path / "j"))
    flat = spark.createDataFrame([("m", "es", "t", "s", 0.5), ("m", "es", "t", "u", 0.25)], "model string, language string, theme string, subtheme string, log_mean double")
    assert json.loads(sinks.nested_summary(flat).first()["json"]) == {"m": {"es": {"t": {"s": {"log_mean": 0.5}, "u": {"log_mean": 0.25}}}}}


def test_streaming_rates_are_the_batch_rates(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", g, t, p) for h in range(3) for m in (0, 20, 40) for g, t, p in (("a", 1, 1), ("b", 0, 1), ("b", 1, m % 3))]
    df = spark.createDataFrame(rows, "ts string, g string, t int, p int").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windowed_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["g"], "t", "p", 1)
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda r: (r["window_start"], r["g"])
    assert sorted(spark.table("rates").collect(), key=key) == sorted(windowed_rates(df, "ts", ["g"], "t", "p", 1).collect(), key=key)
    assert spark.table("rates").count() == 6


@pytest.mark.parametrize("name", ["paritas.operators.fairness", "paritas.plans.catalogue"])
def test_nothing_else_imports_the_training_data_subpackage(name):
    import pathlib

    root = pathlib.Path(readers.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "paritas.llm" not in path.read_text()
