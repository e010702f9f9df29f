"""Readers of the supported data sets.  Paths may lie in any store that Spark reads; schemas are explicit where they are known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions import text as T
from paritas.operators.sampling import stratified_split

#: The 14 features of the census file, in order; income follows.
ADULT_COLUMNS = "age long, workclass string, fnlwgt long, education string, `education-num` long, `marital-status` string, occupation string, relationship string, race string, sex string, `capital-gain` long, `capital-loss` long, `hours-per-week` long, `native-country` string, income string"
#: The 20 attributes of the credit file, in order; risk follows.
GERMAN_COLUMNS = [
    "status of existing checking account", "duration in month", "credit history", "purpose", "credit amount", "savings account/bonds", "present employment since",
    "installment rate in percentage of disposable income", "personal status and sex", "other debtors / guarantors", "present residence since", "property", "age in years",
    "other installment plans", "housing", "number of existing credits at this bank", "job", "number of people being liable to provide maintenance for", "telephone", "foreign worker",
]
GERMAN_NUMBERS = (
    "duration in month", "credit amount", "installment rate in percentage of disposable income", "present residence since", "age in years", "number of existing credits at this bank",
    "number of people being liable to provide maintenance for",
)
#: What the codes of the credit file stand for.
GERMAN_CODES = {
    "A11": "... < 0 DM", "A12": "0 <= ... < 200 DM", "A13": "... >= 200 DM / salary assignments for at least 1 year", "A14": "no checking account",
    "A30": "no credits taken/ all credits paid back duly", "A31": "all credits at this bank paid back duly", "A32": "existing credits paid back duly till now",
    "A33": "delay in paying off in the past", "A34": "critical account/ other credits existing (not at this bank)",
    "A40": "car (new)", "A41": "car (used)", "A42": "furniture/equipment", "A43": "radio/television", "A44": "domestic appliances", "A45": "repairs", "A46": "education",
    "A47": "(vacation - does not exist?)", "A48": "retraining", "A49": "business", "A410": "others",
    "A61": "... < 100 DM", "A62": "100 <= ... < 500 DM", "A63": "500 <= ... < 1000 DM", "A64": ".. >= 1000 DM", "A65": "unknown/ no savings account",
    "A71": "unemployed", "A72": "... < 1 year", "A73": "1 <= ... < 4 years", "A74": "4 <= ... < 7 years", "A75": ".. >= 7 years",
    "A91": "male : divorced/separated", "A92": "female : divorced/separated/married", "A93": "male : single", "A94": "male : married/widowed", "A95": "female : single",
    "A101": "none", "A102": "co-applicant", "A103": "guarantor",
    "A121": "real estate", "A122": "if not A121 : building society savings agreement/ life insurance", "A123": "if not A121/A122 : car or other, not in attribute 6", "A124": "unknown / no property",
    "A141": "bank", "A142": "stores", "A143": "none", "A151": "rent", "A152": "own", "A153": "for free",
    "A171": "unemployed/ unskilled - non-resident", "A172": "unskilled - resident", "A173": "skilled employee / official", "A174": "management/ self-employed/",
    "A191": "none", "A192": "yes, registered under the customers name", "A201": "yes", "A202": "no",
}


def group_list(male: Column, female: Column) -> Column:
    return F.array_compact(F.array(F.when(male, "male"), F.when(female, "female")))


def adult(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both census files with a column split; the test file's first line and final dots are taken away."""
    def read(path: str) -> DataFrame:
        return spark.read.csv(path, schema=ADULT_COLUMNS, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where(F.col("income").isNotNull())

    clean = read(test).withColumn("income", F.regexp_replace("income", r"\.$", ""))
    return read(train).withColumn("split", F.lit("train")).unionByName(clean.withColumn("split", F.lit("test")))


def german(spark: SparkSession, path: str, decode: dict[str, str] | None = GERMAN_CODES) -> DataFrame:
    """Credit rows; codes by a table code -> value (codes that it lacks are null; without a table they stay); risk 1 good, 2 bad."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(cells.alias("c"))
    columns = [F.get("c", F.lit(i)).cast("long" if n in GERMAN_NUMBERS else "string").alias(n) for i, n in enumerate(GERMAN_COLUMNS)]
    out = rows.select(*columns, F.when(F.get("c", F.lit(20)) == "1", "good").when(F.get("c", F.lit(20)) == "2", "bad").alias("risk"))
    return out if decode is None else out.withColumns({n: T.decode(F.col(f"`{n}`"), decode) for n in GERMAN_COLUMNS if n not in GERMAN_NUMBERS})


def german_numeric(spark: SparkSession, path: str) -> DataFrame:
    """The numeric variant: f0, f1, ... and risk from the last cell; as many features as the first line has."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"))
    n = len(rows.first()["c"]) - 1
    return rows.select(*[F.get("c", F.lit(i)).cast("long").alias(f"f{i}") for i in range(n)], F.when(F.element_at("c", -1) == "1", "good").when(F.element_at("c", -1) == "2", "bad").alias("risk"))


def german_cost(gold: Column, predicted: Column) -> Column:
    """0 if right, 5 if a bad risk is taken for good, else 1."""
    return F.when(gold == predicted, 0).when(gold == "bad", 5).otherwise(1)


def reviews(spark: SparkSession, path: str, test_share: float | None = None) -> DataFrame:
    """Review, Gender (sorted array), Sentiment; with a share, a split stratified by Gender."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    out = rows.select("Review", T.split_list(F.col("Gender")).alias("Gender"), "Sentiment")
    if test_share is None:
        return out
    keyed = out.withColumn("__g", T.join_groups(F.col("Gender"))).withColumn("__id", F.xxhash64("Review", "Sentiment"))
    return stratified_split(keyed, "__id", ["__g"], test_share).drop("__g", "__id")


def md_gender(df: DataFrame) -> DataFrame:
    """Of rows (text, class_type, confidence, labels): those about somebody and certain; labels stay repeated."""
    gender = {0: "female", 1: "male", 2: "female", 3: "male", 4: "female", 5: "male"}
    table = F.create_map(*[F.lit(x) for pair in gender.items() for x in pair])
    kept = df.where((F.col("class_type") == 0) & (F.col("confidence") == "certain"))
    return kept.select(F.col("text").alias("Text"), F.col("confidence").alias("Confidence"), F.col("class_type").alias("Annotation Type"), F.array_compact(F.transform("labels", lambda x: F.try_element_at(table, x.cast("int")))).alias("Gender"))


def image_chat(df: DataFrame, text: str = "caption") -> DataFrame:
    return df.select(F.col(text).alias("Text"), group_list(F.col("male"), F.col("female")).alias("Gender"))


def funpedia(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").alias("Text"), T.decode(F.col("gender").cast("int"), {0: "gender-neutral", 1: "female", 2: "male"}).alias("Gender"))


def toxicity(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Groups whose score is over the threshold; rows without a score go."""
    known = df.dropna(subset=["male", "female"])
    return known.select(F.col("comment_text").alias("Text"), group_list(F.col("male") > threshold, F.col("female") > threshold).alias("Gender"))


def c2gen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="context string, keywords array<string>")


def common_gen(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """concepts, target and split of several files."""
    out = None
    for split, path in paths.items():
        part = spark.read.json(path, schema="concepts array<string>, target string").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def victoria(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon files; output without markdown."""
    return spark.read.csv(path, sep=";", header=True, multiLine=True, escape='"').withColumn("output", T.markdown_to_text(F.col("output")))


def ilenia(spark: SparkSession, path: str, annotated: bool = True) -> DataFrame:
    """Sentence, Analysis (word, is_person, gender) and language (the folder's name) of one file or a folder."""
    if not annotated:
        return spark.read.text(path).select(F.col("value").alias("Sentence"), language_of_path())
    rows = spark.read.option("recursiveFileLookup", True).csv(path, sep=";", header=True, multiLine=True, escape='"', schema="Sentence string, Analysis string")
    return rows.select("Sentence", T.parse_annotations(F.col("Analysis")).alias("Analysis"), language_of_path())


def language_of_path() -> Column:
    return F.lower(F.element_at(F.split(F.input_file_name(), "/"), -2)).alias("language")


def rhopa(spark: SparkSession, path: str, model: str, lang: str | None = None, group: str | None = None, row_id: str | None = None, literals: bool = False) -> DataFrame:
    """Stories of one model: filters reach the scan; output is an array of four texts (null: another number)."""
    out = spark.read.option("inferSchema", False).csv(f"{path}/{model}.tsv", sep="\t", header=True, multiLine=True, escape='"')
    for column, value in (("lang", lang), ("group", group), ("id", row_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    cell = T.literal_list(F.col("output")) if literals else F.col("output")
    return out.withColumn("output", T.parse_stories(cell))


def sampled_stories(df: DataFrame, key: str, items: str = "output", most: int = 2, seed: int = 37) -> DataFrame:
    """At most so many items of each array, by the order of a seeded hash of key and place."""
    numbered = F.transform(F.col(items), lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), i).alias("h"), x.alias("x")))
    return df.withColumn(items, F.transform(F.slice(F.array_sort(numbered), 1, most), lambda p: p["x"]))


def villanos(spark: SparkSession, path: str) -> DataFrame:
    """Text and Violent (yes, no, null) of a tab-separated split."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("text").alias("Text"), T.decode(F.col("label"), {"VIOLENTO": "yes", "NOVIOLENTO": "no"}).alias("Violent"))


def villanos_gendered(spark: SparkSession, path: str, mentions: Sequence[str] = ("mentions_male", "mentions_female"), targets: Sequence[str] = ("target_male", "target_female")) -> DataFrame:
    """Text, Violent, and the groups mentioned and meant, from 0/1 columns; rows with a null go."""
    rows = spark.read.csv(path, sep=";", header=True, inferSchema=True).dropna()
    return rows.select(F.col("text").alias("Text"), F.when(F.col("label") > 0, "yes").when(F.col("label") == 0, "no").alias("Violent"), group_list(*[F.col(c) > 0 for c in mentions]).alias("Mentions"), group_list(*[F.col(c) > 0 for c in targets]).alias("Targets"))


def custom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def sentences_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select(F.lower("sentence").alias("sentence")).dropna()


def seed_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed, distinct."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where(F.col("word") != "").distinct()


def seed_lexicon(spark: SparkSession, files: dict[tuple[str, str], str], ignore: str | None = None, professions: str | None = None) -> DataFrame:
    """grp, pos, word of seed files by (group, part of speech); missing files are skipped, ignored words go everywhere, professions from nouns."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "grp string, pos string, word string")
    for (group, pos), path in files.items():
        try:
            out = out.unionByName(seed_words(spark, path).select(F.lit(group).alias("grp"), F.lit(pos).alias("pos"), "word"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if ignore:
        out = out.join(seed_words(spark, ignore), "word", "left_anti")
    if professions:
        gone = seed_words(spark, professions).withColumn("pos", F.lit("NOUN"))
        out = out.join(gone, ["word", "pos"], "left_anti")
    return out.select("grp", "pos", "word").distinct()


def names(spark: SparkSession, path: str) -> DataFrame:
    """name, attr, count from a table with assigned_gender 0 (male) or 1 (female)."""
    rows = spark.read.csv(path, header=True, schema="name string, assigned_gender int, count long")
    return rows.select("name", T.decode(F.col("assigned_gender"), {0: "male", 1: "female"}).alias("attr"), "count")


def knowledge_base(df: DataFrame) -> DataFrame:
    """person, property_value with names and values as titles, without what comes before the last slash; empty ones go."""
    clean = df.select(T.last_part(F.col("person")).alias("person"), T.last_part(F.col("property_value")).alias("property_value"))
    return clean.where((F.col("person") != "") & (F.col("property_value") != "")).distinct()


def score_files(spark: SparkSession, path: str) -> DataFrame:
    """Text of every *.scores.json below path, with the model, language, theme and subtheme of its folders."""
    parts = F.split(F.input_file_name(), "/")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.scores.json").option("wholetext", True).text(path)
    return rows.select(*[F.element_at(parts, -5 + i).alias(n) for i, n in enumerate(("model", "language", "theme"))], F.element_at(parts, -2).alias("subtheme"), "value")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """model, metric, value of JSON lines with a model and numbers."""
    rows = spark.read.json(path)
    numbers = [c for c, t in rows.dtypes if t in ("double", "bigint")]
    return rows.unpivot("model", numbers, "metric", "value") if numbers else rows.select("model")


def theme_names(spark: SparkSession, path: str) -> DataFrame:
    """key and name of themes, English rows only, the last name of a key."""
    rows = spark.read.csv(path, sep="\t", header=True).where(F.col("lang") == "en").withColumn("__n", F.monotonically_increasing_id())
    return rows.groupBy("key").agg(F.max_by("name", "__n").alias("name"))


def all_data(train: DataFrame, validation: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """The splits one after another; a missing one is empty."""
    out = train
    for part in (validation, test):
        out = out if part is None else out.unionByName(part)
    return out


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """handle and name of profiles kept as JSON lines {"handle": ..., "name": ...}; the last one of a handle."""
    rows = spark.read.json(path, schema="handle string, name string").withColumn("__n", F.monotonically_increasing_id())
    return rows.groupBy("handle").agg(F.max_by("name", "__n").alias("name"))


def bundled(spark: SparkSession, train: str, test: str | None = None, label: str = "label", separator: str = ",", share: float = 0.3, most: int | None = None, seed: int = 0) -> DataFrame:
    """A delimited table with a header: features, label, split; without a test file a seeded share of the rows is test.  most: an explicit number of examples of each split."""
    rows = spark.read.csv(train, header=True, inferSchema=True, sep=separator)
    if test is not None:
        out = rows.withColumn("split", F.lit("train")).unionByName(spark.read.csv(test, header=True, schema=rows.schema, sep=separator).withColumn("split", F.lit("test")))
    else:
        at = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns]), F.lit(1 << 40)) / float(1 << 40)
        out = rows.withColumn("split", F.when(at < share, "test").otherwise("train"))
    if most is not None:
        out = out.where(F.col("split") == "train").limit(most).unionByName(out.where(F.col("split") == "test").limit(most))
    return out.select(*[c for c in rows.columns if c != label], label, "split")


def spanish_seeds(spark: SparkSession, folder: str, groups: dict[str, str], ignore: str | None = None, professions: str | None = None, with_professions: bool = False) -> DataFrame:
    """grp, pos, word from <folder>/<group's name>_<class>.csv; classes that aren't there are empty.

    Nouns and heteronyms (and professions, if asked for) are NOUN, names and
    abbreviations PROPN, pronouns PRON, adjectives ADJ; ignored words go everywhere,
    professions from the nouns unless they are asked for.
    """
    #: The classes of each part of speech.
    classes = {"NOUN": ("nouns", "heteronyms", *(("professions",) if with_professions else ())), "PROPN": ("names", "abbreviations"), "PRON": ("pronouns",), "ADJ": ("adjectives",)}
    files = [((group, pos), f"{folder}/{name}_{kind}.csv") for group, name in groups.items() for pos, kinds in classes.items() for kind in kinds]
    out = None
    for key, path in files:
        part = seed_lexicon(spark, {key: path}, ignore, None if with_professions else professions)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
