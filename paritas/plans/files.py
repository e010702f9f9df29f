"""Queries over readers and writers: fixture tables are written in each format, read back by its reader, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions import text as T
from paritas.operators import reports
from paritas.plans import views as V
from paritas.plans.catalogue import query, rounded
from paritas.sources import readers, sinks


def _lines(df: DataFrame, name: str, *cells: Column | str, separator: str = ",", head: str | None = None) -> str:
    """Write rows as lines of text; the path."""
    path = sinks.folder(df.sparkSession, name)
    rows = df.select(F.concat_ws(separator, *cells).alias("value"))
    if head is not None:
        rows = df.sparkSession.createDataFrame([(head,)], "value string").union(rows).coalesce(1)
    rows.write.text(path)
    return path


def _csv(df: DataFrame, name: str, separator: str = ",") -> str:
    path = sinks.folder(df.sparkSession, name)
    df.write.csv(path, header=True, sep=separator, escape='"')
    return path


def _json(df: DataFrame, name: str) -> str:
    path = sinks.folder(df.sparkSession, name)
    df.write.json(path)
    return path


def _flat(df: DataFrame) -> DataFrame:
    """Array columns joined by '|'."""
    return df.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


# --- readers ------------------------------------------------------------------------------------------------------------

_CENSUS = ["c_custkey % 80", "c_mktsegment", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_name", "c_mktsegment", "c_name", "CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END", "c_nationkey * 10", "c_nationkey", "c_custkey % 99", "c_mktsegment"]
_INCOME = "CASE WHEN c_acctbal > 5000 THEN '>50K' ELSE '<=50K' END"


@query(f"SELECT (c_custkey % 80)::BIGINT AS age, c_mktsegment AS workclass, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, (c_nationkey * 10)::BIGINT AS gain, {_INCOME} AS income, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def read_adult(s, d):
    rows = V.table(s, d, "customer")
    cells = [F.expr(f"cast({c} AS string)") for c in _CENSUS]
    train = _lines(rows.where("c_custkey % 3 <> 0"), "adult.data", *cells, F.expr(_INCOME), separator=", ")
    test = _lines(rows.where("c_custkey % 3 = 0"), "adult.test", *cells, F.concat(F.expr(_INCOME), F.lit(".")), separator=", ", head="|1x3 Cross validator")
    return readers.adult(s, train, test).select("age", "workclass", "sex", F.col("capital-gain").alias("gain"), "income", "split")


_WORTH = ["A61", "A62", "A63", "A64", "A65", "A66"]


@query("SELECT (['... < 100 DM', '100 <= ... < 500 DM', '500 <= ... < 1000 DM', '.. >= 1000 DM', 'unknown/ no savings account', NULL])[c_nationkey % 6 + 1] AS savings, c_custkey AS months, (c_custkey % 70)::BIGINT AS age, CASE WHEN c_acctbal > 0 THEN 'good' ELSE 'bad' END AS risk FROM customer")
def read_german(s, d):
    code = F.get(F.array(*map(F.lit, _WORTH)), (F.col("c_nationkey") % 6).cast("int"))
    cells = [F.col("c_custkey").cast("string") if n == "duration in month" else (F.col("c_custkey") % 70).cast("string") if n in readers.GERMAN_NUMBERS else code for n in readers.GERMAN_COLUMNS]
    path = _lines(V.table(s, d, "customer"), "german.data", *cells, F.when(F.col("c_acctbal") > 0, "1").otherwise("2"), separator=" ")
    return readers.german(s, path).select(F.col("`savings account/bonds`").alias("savings"), F.col("duration in month").alias("months"), F.col("age in years").alias("age"), "risk")


@query("SELECT l_orderkey AS f0, l_linenumber::BIGINT AS f1, l_quantity::BIGINT AS f2, CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS risk FROM lineitem")
def read_german_numeric(s, d):
    rows = V.table(s, d, "lineitem")
    path = _lines(rows, "german.data-numeric", F.lit(" "), *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_quantity")], F.when(F.col("l_linestatus") == "O", "1").otherwise("2"), separator="  ")
    return readers.german_numeric(s, path)


_COST = "CASE WHEN target = pred THEN 0 WHEN target = 'O' THEN 5 ELSE 1 END"


@query("WITH " + V.LI + f" SELECT grp, sum({_COST})::BIGINT AS cost FROM li GROUP BY grp")
def german_cost(s, d):
    coded = lambda c: F.when(F.col(c) == "O", "bad").otherwise("good")
    return V.li(s, d).groupBy("grp").agg(F.sum(readers.german_cost(coded("target"), coded("pred"))).alias("cost"))


def _names(s, d) -> DataFrame:
    return V.table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")


_GROUPS = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'female' WHEN 2 THEN 'male' ELSE 'female|male' END"


@query(f"SELECT 'say \"' || p_name || '\",' || chr(10) || p_partkey AS Review, {_GROUPS} AS Gender, p_brand AS Sentiment FROM part")
def read_reviews(s, d):
    gender = F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, "Female").when(F.col("p_size") % 4 == 2, " Male,").otherwise("Male , female")
    rows = _names(s, d).select(F.concat(F.lit('say "'), "p_name", F.lit('",\n'), F.col("p_partkey").cast("string")).alias("Review"), gender.alias("Gender"), F.col("p_brand").alias("Sentiment"))
    return _flat(readers.reviews(s, _csv(rows, "reviews.csv")))


@query("SELECT p_name AS Text, list_transform(list_filter([p_size % 7, p_size % 3], lambda x: x < 6), lambda x: CASE WHEN x % 2 = 0 THEN 'female' ELSE 'male' END) AS Gender FROM part WHERE p_size % 2 = 0 AND p_size % 5 <> 0")
def read_md_gender(s, d):
    rows = _names(s, d).select(F.col("p_name").alias("text"), (F.col("p_size") % 2).alias("class_type"), F.when(F.col("p_size") % 5 != 0, "certain").otherwise("unsure").alias("confidence"), F.array(F.col("p_size") % 7, F.col("p_size") % 3).alias("labels"))
    path = _json(rows, "md.json")
    return readers.md_gender(s.read.schema("text string, class_type int, confidence string, labels array<int>").json(path)).select("Text", "Gender")


@query("SELECT p_name AS Text, list_filter([CASE WHEN p_size % 2 = 0 THEN 'male' END, CASE WHEN p_size % 3 = 0 THEN 'female' END], lambda x: x IS NOT NULL) AS Gender FROM part")
def read_image_chat(s, d):
    return readers.image_chat(_names(s, d).select(F.col("p_name").alias("caption"), (F.col("p_size") % 2 == 0).alias("male"), (F.col("p_size") % 3 == 0).alias("female")))


@query("SELECT p_name AS Text, CASE p_size % 4 WHEN 0 THEN 'gender-neutral' WHEN 1 THEN 'female' WHEN 2 THEN 'male' END AS Gender FROM part")
def read_funpedia(s, d):
    return readers.funpedia(_names(s, d).select(F.col("p_name").alias("text"), (F.col("p_size") % 4).alias("gender")))


@query("SELECT p_name AS Text, list_filter([CASE WHEN p_size / 50.0::DOUBLE > 0.5 THEN 'male' END, CASE WHEN 1 - p_size / 50.0::DOUBLE > 0.5 THEN 'female' END], lambda x: x IS NOT NULL) AS Gender FROM part WHERE p_size % 5 <> 0")
def read_toxicity(s, d):
    score = F.col("p_size") / 50.0
    return readers.toxicity(_names(s, d).select(F.col("p_name").alias("comment_text"), F.when(F.col("p_size") % 5 != 0, score).alias("male"), (1 - score).alias("female")))


@query("SELECT p_type AS context, string_split(p_name, ' ') AS keywords FROM part")
def read_c2gen(s, d):
    return readers.c2gen(s, _json(_names(s, d).select(F.col("p_type").alias("context"), F.split("p_name", " ").alias("keywords")), "c2gen.json"))


@query("SELECT string_split(p_name, ' ') AS concepts, p_type AS target, CASE WHEN p_size > 25 THEN 'dev' ELSE 'train' END AS split FROM part")
def read_common_gen(s, d):
    rows = _names(s, d)
    paths = {name: _json(rows.where(where).select(F.split("p_name", " ").alias("concepts"), F.col("p_type").alias("target")), f"{name}.json") for name, where in (("dev", "p_size > 25"), ("train", "p_size <= 25"))}
    return readers.common_gen(s, paths)


@query("SELECT p_partkey::VARCHAR AS prompt, p_name || ' and ' || p_type || '; see ' || p_brand AS output FROM part")
def read_victoria(s, d):
    marked = F.concat(F.lit("# **"), "p_name", F.lit("** and _"), "p_type", F.lit("_; see ["), "p_brand", F.lit("](http://x.test/y)"))
    return readers.victoria(s, _csv(_names(s, d).select(F.col("p_partkey").cast("string").alias("prompt"), marked.alias("output")), "victoria.csv", ";")).select("prompt", "output")


@query("SELECT p_partkey::VARCHAR AS Sentence, w[1] || ':true:female|' || w[2] || ':false:male' AS Analysis FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def read_ilenia(s, d):
    words = F.split("p_name", " ")
    cell = F.concat(words[0], F.lit(" - S,F\nnot an annotation\n"), words[1], F.lit(" - N , M"))
    rows = readers.ilenia(s, _csv(_names(s, d).select(F.col("p_partkey").cast("string").alias("Sentence"), cell.alias("Analysis")), "es", ";"))
    shown = F.transform("Analysis", lambda a: F.concat_ws(":", a["word"], a["is_person"].cast("string"), a["gender"]))
    return rows.select("Sentence", F.concat_ws("|", shown).alias("Analysis"))


@query("SELECT p_partkey::VARCHAR AS id, p_name || '|b \"c\"|' || p_type || '|d' AS output FROM part WHERE p_size % 2 = 0")
def read_rhopa(s, d):
    stories = F.to_json(F.array(F.concat(F.lit("Story 1: "), "p_name"), F.lit(' Story 2:b "c"'), "p_type", F.lit("d")))
    rows = _names(s, d).select(F.col("p_partkey").cast("string").alias("id"), F.lit("g").alias("group"), F.when(F.col("p_size") % 2 == 0, "es").otherwise("en").alias("lang"), stories.alias("output"))
    path = _csv(rows, "model.tsv", "\t")
    found = readers.rhopa(s, path.rsplit("/", 1)[0], "model", lang="es", group="g")
    return _flat(found.select("id", "output"))


@query("SELECT p_name AS Text, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS Violent FROM part")
def read_villanos(s, d):
    label = F.when(F.col("p_size") % 3 == 0, "VIOLENTO").when(F.col("p_size") % 3 == 1, "NOVIOLENTO").otherwise("?")
    return readers.villanos(s, _csv(_names(s, d).select(F.col("p_name").alias("text"), label.alias("label")), "villanos.tsv", "\t"))


_TWO = "array_to_string(list_filter([CASE WHEN {a} THEN 'male' END, CASE WHEN {b} THEN 'female' END], lambda x: x IS NOT NULL), '|')"


@query(f"SELECT p_name AS Text, CASE WHEN p_size % 2 = 1 THEN 'yes' ELSE 'no' END AS Violent, {_TWO.format(a='p_size % 3 = 0', b='p_size % 5 = 0')} AS Mentions, {_TWO.format(a='p_size % 7 = 0', b='p_size % 4 = 0')} AS Targets FROM part WHERE p_size % 6 <> 0")
def read_villanos_gendered(s, d):
    bit = lambda n: (F.col("p_size") % n == 0).cast("int")
    rows = _names(s, d).select(F.col("p_name").alias("text"), F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 2).alias("label"), bit(3).alias("mentions_male"), bit(5).alias("mentions_female"), bit(7).alias("target_male"), bit(4).alias("target_female"))
    return _flat(readers.villanos_gendered(s, _csv(rows, "gendered.csv", ";")))


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def read_custom(s, d):
    return readers.custom(s, _csv(_names(s, d).select("p_partkey", "p_name", "p_size"), "custom.csv")).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"))


@query("SELECT lower(p_name || '. ' || p_type) AS sentence FROM part WHERE p_size % 3 <> 0")
def read_sentences(s, d):
    sentence = F.when(F.col("p_size") % 3 != 0, F.concat("p_name", F.lit(". "), F.upper("p_type")))
    return readers.sentences_tsv(s, _csv(_names(s, d).select("p_partkey", sentence.alias("sentence")), "sentences.tsv", "\t"))


_SEEDS = """WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
f AS (SELECT 'male' AS grp, 'NOUN' AS pos, a AS word FROM w UNION SELECT 'male', 'PROPN', b FROM w UNION SELECT 'female', 'NOUN', b FROM w UNION SELECT 'female', 'ADJ', a FROM w)"""


@query(_SEEDS + " SELECT * FROM f WHERE length(word) <> 5 AND NOT (pos = 'NOUN' AND word LIKE '%e')")
def read_spanish_seeds(s, d):
    words = F.split("p_name", " ")
    first, second = _names(s, d).select(words[0].alias("w")), _names(s, d).select(words[1].alias("w"))
    base = sinks.folder(s, "seeds")
    for name, table in (("m_nouns", first), ("m_names", second), ("f_heteronyms", second), ("f_adjectives", first)):
        table.select(F.concat("w", F.lit(" ")).alias("value")).write.text(f"{base}/{name}.csv")
    both = first.union(second)
    both.where("length(w) = 5").select(F.col("w").alias("value")).write.text(f"{base}/ignore.csv")
    both.where("w LIKE '%e'").select(F.col("w").alias("value")).write.text(f"{base}/professions.csv")
    return readers.spanish_seeds(s, base, {"male": "m", "female": "f"}, f"{base}/ignore.csv", f"{base}/professions.csv")


@query("SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS person, CASE WHEN p_size > 25 THEN 'Male' ELSE 'Female' END AS property_value FROM part WHERE p_size % 4 <> 0")
def read_knowledge_base(s, d):
    value = F.when(F.col("p_size") % 4 == 0, "http://kb.test/").when(F.col("p_size") > 25, "http://kb.test/male").otherwise("http://kb.test/female")
    return readers.knowledge_base(_names(s, d).select(F.concat(F.lit("http://kb.test/"), "p_name").alias("person"), value.alias("property_value")))


@query("SELECT p_name AS name, CASE p_size % 2 WHEN 0 THEN 'male' ELSE 'female' END AS attr, p_partkey AS count FROM part")
def read_names(s, d):
    return readers.names(s, _csv(_names(s, d).select(F.col("p_name").alias("name"), (F.col("p_size") % 2).alias("assigned_gender"), F.col("p_partkey").alias("count")), "names.csv"))


@query("SELECT p_brand AS handle, max(p_name) AS name FROM part GROUP BY p_brand")
def read_profiles(s, d):
    rows = _names(s, d).groupBy(F.col("p_brand").alias("handle")).agg(F.max("p_name").alias("name"))
    return readers.profiles(s, _json(rows, "profiles.json"))


@query("SELECT label, count(*) AS n FROM (SELECT p_size % 3 AS label FROM part) GROUP BY label")
def read_bundled(s, d):
    rows = readers.bundled(s, _csv(_names(s, d).select("p_partkey", "p_name", (F.col("p_size") % 3).alias("label")), "bundled.csv"))
    return rows.groupBy(F.col("label").cast("long").alias("label")).agg(F.count_if(F.col("split").isin("train", "test")).alias("n"))


_LEAVES = "SELECT r_name AS model, n_name AS language, 'value' AS metric, n_nationkey::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_LEAVES)
def flatten_scores(s, d):
    met = V.table(s, d, "nation").join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = met.select(F.col("r_name").alias("model"), F.col("n_name").alias("language"), F.lit("t").alias("theme"), F.lit("u").alias("subtheme"), F.col("n_nationkey").cast("double").alias("value"))
    path = sinks.folder(s, "summary.json")
    sinks.nested_summary(rows).select(F.col("json").alias("value")).write.text(path)
    return reports.flatten_scores(s.read.text(path)).select("model", "language", "metric", "value")


@query("SELECT 'model ' || n_name AS model, 'theme' AS theme, n_nationkey::BIGINT AS score FROM nation")
def read_score_files(s, d):
    rows, base = V.table(s, d, "nation").orderBy("n_nationkey").collect(), sinks.folder(s, "scores")  # 25 rows
    jvm = s.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    store = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for r in rows:
        out = store.create(jvm.org.apache.hadoop.fs.Path(f"{base}/model {r['n_name']}/es/theme/sub/a.scores.json"))
        out.write(bytearray(f'{{"score": {r["n_nationkey"]}}}', "utf-8"))
        out.close()
    found = readers.score_files(s, base)
    return found.select(F.regexp_replace(F.url_decode("model"), r"\+", " ").alias("model"), "theme", F.get_json_object("value", "$.score").cast("long").alias("score"))


@query("SELECT r_name AS key, max(n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def read_theme_names(s, d):
    met = V.table(s, d, "nation").join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = met.select(F.explode(F.array(F.lit("en"), F.lit("es"))).alias("lang"), F.col("r_name").alias("key"), F.col("n_name").alias("name"))
    return readers.theme_names(s, _csv(rows.coalesce(1).sortWithinPartitions("name", "lang"), "themes.tsv", "\t"))


@query("SELECT n_name AS model, m AS metric, CASE m WHEN 'a' THEN n_nationkey / 4.0::DOUBLE ELSE n_regionkey / 8.0::DOUBLE END AS value FROM nation, (VALUES ('a'), ('b')) t(m)")
def read_metric_lines(s, d):
    rows = V.table(s, d, "nation").select(F.col("n_name").alias("model"), (F.col("n_nationkey") / 4.0).alias("a"), (F.col("n_regionkey") / 8.0).alias("b"))
    return readers.metric_lines(s, _json(rows, "metrics.json"))


_POINTS = "SELECT n_nationkey::BIGINT AS ensemble, n_nationkey / 25.0::DOUBLE AS accuracy, (n_nationkey * 7 % 25) / 50.0::DOUBLE AS gap FROM nation"


def _from_log(s, d) -> DataFrame:
    a, b = F.col("n_nationkey") / 25.0, F.col("n_nationkey") * 7 % 25 / 50.0
    block = F.concat(F.lit("# TOP-ENSEMBLE-"), F.col("n_nationkey").cast("string"), F.lit(" @ TESTING #\nScore: "), a.cast("string"), F.lit("\nFScore: ["), a.cast("string"), F.lit(", "), b.cast("string"), F.lit("]\nother\n"))
    path = sinks.folder(s, "search.log")
    V.table(s, d, "nation").select(block.alias("value")).write.text(path)
    parsed = reports.parse_log(s.read.text(path, wholetext=True))
    return parsed.select(F.col("ensemble").cast("long").alias("ensemble"), F.col("fscore")[0].alias("accuracy"), F.col("fscore")[1].alias("gap"), F.col("fscore").alias("fitness"))


@query(_POINTS)
def read_search_log(s, d):
    return rounded(_from_log(s, d).select("ensemble", "accuracy", "gap"))


@query(f"WITH p AS ({_POINTS}) SELECT ensemble, accuracy, gap FROM p WHERE accuracy >= 0.7::DOUBLE AND gap < 0.15::DOUBLE AND NOT EXISTS (SELECT 1 FROM p o WHERE o.accuracy >= p.accuracy AND o.gap <= p.gap AND (o.accuracy > p.accuracy OR o.gap < p.gap))")
def pareto_from_log(s, d):
    from paritas.operators import pareto

    return rounded(reports.feasible(pareto.front(_from_log(s, d).select("ensemble", "accuracy", "gap"), ["accuracy", "gap"], [True, False])))


# --- writers ------------------------------------------------------------------------------------------------------------


@query(f"WITH p AS ({_POINTS}) SELECT ensemble FROM p WHERE gap <= 0.2::DOUBLE")
def write_search_log(s, d):
    path = sinks.folder(s, "kept.log")
    for part in ("ensemble < 10", "ensemble >= 10"):  # the second run adds to the first
        sinks.append_log(_from_log(s, d).where(part).select("ensemble", "fitness"), path, under=0.2)
    return s.read.text(path).select(F.get_json_object("value", "$.ensemble").cast("long").alias("ensemble"))


@query("SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place, p_partkey FROM part")
def write_scores(s, d):
    """Every row and its place in the file, as it is read again: the rows before its block of a file, and those before it in the block."""
    from pyspark.sql import Window

    path = sinks.folder(s, "scores.csv")
    scores = V.table(s, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("log_score"), F.split("p_name", " ").alias("matches"))
    sinks.write_scores(scores, path, ties=["p_partkey"])
    read = s.read.csv(path, header=True, schema="p_partkey long, log_score double, matches string")
    placed = read.select("p_partkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = blocks.select("file", "block", (F.sum("rows").over(Window.orderBy("file", "block")) - F.col("rows")).alias("before"))  # a row for each block of a file
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("n"))
    return placed.withColumn("inside", inside).join(before, ["file", "block"]).select((F.col("before") + F.col("inside")).alias("place"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def write_sibling(s, d):
    rows = V.table(s, d, "part").select("p_partkey", "p_retailprice")
    mean = rows.agg(F.avg("p_retailprice").alias("m"))
    to = sinks.write_sibling(rows.join(mean, F.col("p_retailprice") > F.col("m")).drop("m"), sinks.folder(s, "scores.csv"), "above")
    assert to.endswith("scores.above.csv")
    return s.read.csv(to, header=True, schema="p_partkey long, p_retailprice double").select("p_partkey")


@query("WITH " + V.ORD + " SELECT o_orderkey, array_to_string(groups, ' & ') AS groups, len(groups)::BIGINT AS n FROM ord")
def write_annotations(s, d):
    path = sinks.folder(s, "annotated.csv")
    sinks.write_annotations(V.orders(s, d).select("o_orderkey", "groups"), path, ["groups"])
    read = s.read.csv(path, header=True, schema="o_orderkey long, groups string").select("o_orderkey", F.coalesce("groups", F.lit("")).alias("groups"))
    return read.withColumn("n", F.size(T.split_groups(F.col("groups"))).cast("long"))


@query("WITH " + V.ORD + " SELECT o_orderkey, list_contains(groups, 'A')::BIGINT AS flag_A, list_contains(groups, 'N')::BIGINT AS flag_N, list_contains(groups, 'R')::BIGINT AS flag_R FROM ord")
def write_indicators(s, d):
    path = sinks.folder(s, "indicators.csv")
    sinks.write_indicators(V.orders(s, d).select("o_orderkey", "groups"), path, "groups", ["A", "N", "R"], "flag")
    return s.read.csv(path, sep=";", header=True, schema="o_orderkey long, flag_A long, flag_N long, flag_R long")


@query("WITH " + V.LI + " SELECT '## ' || grp || ' [male then female]' AS key, round(avg((pred = 'O')::INT), 6) AS mean FROM li GROUP BY grp")
def write_keyed_summary(s, d):
    path = sinks.folder(s, "summary.json")
    means = V.li(s, d).groupBy(F.col("grp").alias("mode")).agg(F.avg((F.col("pred") == "O").cast("double")).alias("mean"))
    sinks.keyed_summary(means, ["male", "female"]).select(F.col("json").alias("value")).write.text(path)
    pairs = s.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<mean:double>>")).alias("key", "v"))
    assert sinks.score_key("A", ["male", "female"]) == "## A [male then female]"
    return rounded(pairs.select("key", F.col("v.mean").alias("mean")))
