"""The fixture tables in the shapes that the operators take, for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import bias
from paritas.sources import sinks

LEXICON = {"male": ["he", "his"], "female": ["it", "this"]}
STOPWORDS = ["the", "of", "and", "to", "in"]
PROFESSIONS = ["ering", "tion", "thing", "ation"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it comes in fewer parts (one small file); large inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task gets of a table dealt by a key.
PART_ROWS = 1_250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys into parts of about PART_ROWS rows, so that a task's memory doesn't grow with the table; the rows are counted from the files' footers."""
    parts = -(-df.groupBy().count().first()[0] // PART_ROWS)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts), *keys)


def written(df: DataFrame) -> DataFrame:
    """df written once to the cluster's folder and read from there, for what reads it several times."""
    path = sinks.folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("target"), F.when(F.col("l_quantity") >= 25, "O").otherwise("F").alias("pred"))


LI = "li AS (SELECT l_returnflag AS grp, l_linestatus AS target, CASE WHEN l_quantity >= 25 THEN 'O' ELSE 'F' END AS pred FROM lineitem)"


def doc(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "lang", "source", "n_chars", F.col("quality").alias("target"), "toxic", (F.col("n_chars") >= 1000).cast("int").alias("pred"))


DOC = "doc AS (SELECT d.doc_id, lang, source, n_chars, quality AS target, toxic, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    items = dealt(table(spark, d, "lineitem"), "l_orderkey")
    flags = items.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.max(F.col("l_quantity") >= 25).alias("large"))
    flags = flags.groupBy("o_orderkey").agg(F.collect_list("l_returnflag").alias("g"), F.collect_list(F.when(F.col("large"), F.col("l_returnflag"))).alias("p"))
    none = F.array().cast("array<string>")
    return (
        table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("target"), F.when(F.col("o_totalprice") >= 250000, "F").otherwise("O").alias("pred"))
        .join(flags, "o_orderkey", "left")
        .select("o_orderkey", "target", "pred", F.array_sort(F.coalesce("g", none)).alias("groups"), F.array_sort(F.coalesce("p", none)).alias("pred_groups"))
    )


ORD = """flags AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS g, list_sort(list_distinct(list(l_returnflag) FILTER (WHERE l_quantity >= 25))) AS p FROM lineitem GROUP BY l_orderkey),
ord AS (SELECT o_orderkey, o_orderstatus AS target, CASE WHEN o_totalprice >= 250000 THEN 'F' ELSE 'O' END AS pred, coalesce(g, []::VARCHAR[]) AS groups, coalesce(p, []::VARCHAR[]) AS pred_groups FROM orders LEFT JOIN flags ON o_orderkey = l_orderkey)"""


def clf(spark: SparkSession, d: str) -> DataFrame:
    preds = [F.col("n_chars") >= 500, F.col("n_chars") >= 2000, F.col("lang") == "en", F.col("toxic") == 0, F.col("doc_id") % 2 == 1]
    return doc(spark, d).select("doc_id", F.col("doc_id").alias("row_id"), F.col("target").alias("gold"), F.array(*[p.cast("int") for p in preds]).alias("preds"))


CLF = DOC + """,
clf AS (SELECT doc_id, target AS gold, (n_chars >= 500)::INT AS p0, (n_chars >= 2000)::INT AS p1, (lang = 'en')::INT AS p2, (toxic = 0)::INT AS p3, (doc_id % 2 = 1)::INT AS p4 FROM doc)"""
CLF_LONG = CLF + """,
long AS (SELECT doc_id, gold, unnest([0, 1, 2, 3, 4]) AS k, unnest([p0, p1, p2, p3, p4]) AS pred FROM clf)"""
CLF_SCORES = [0.75, 0.46, 0.61, 0.77, 0.52]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return bias.regex_tokens(lines(spark, d)).select("doc_id", "par_id", "tokens")


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_id", "paragraph"))


TOK = r"""lines AS (SELECT doc_id, unnest(range(len(l))) AS par_id, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
arrays AS (SELECT doc_id, par_id, regexp_extract_all(lower(line), '\p{L}+|[0-9]+|[.,;:!?]') AS t FROM lines),
tok AS (SELECT doc_id, par_id, unnest(range(len(t))) AS i, unnest(t) AS word FROM arrays),
lex AS (SELECT * FROM (VALUES ('male', 'he'), ('male', 'his'), ('female', 'it'), ('female', 'this')) v(grp, word)),
seed AS (SELECT doc_id, par_id, i, grp FROM tok JOIN lex USING (word))"""


def pairs_sql(width: int, weight: str) -> str:
    """CTEs of context pairs and counts; weight is SQL over d, the place minus the centre's."""
    return TOK + f""",
near AS (SELECT s.grp, t.word, t.i - s.i AS d FROM seed s JOIN tok t ON s.doc_id = t.doc_id AND s.par_id = t.par_id AND t.i BETWEEN s.i - {width} AND s.i + {width} WHERE NOT regexp_full_match(t.word, '[0-9]+|[.,;:!?]')),
weighed AS (SELECT grp, word, {weight} AS w FROM near),
counts AS (SELECT word, sum(CASE WHEN grp = 'male' THEN w ELSE 0 END) AS count_male, sum(CASE WHEN grp = 'female' THEN w ELSE 0 END) AS count_female,
  count(*) FILTER (WHERE grp = 'male' AND w > 0.05::DOUBLE) AS discrete_male, count(*) FILTER (WHERE grp = 'female' AND w > 0.05::DOUBLE) AS discrete_female FROM weighed GROUP BY word)"""


CONTINUAL = "CASE WHEN d < 0 THEN pow(0.95::DOUBLE, -d - 1) ELSE pow(0.95::DOUBLE, d) END"
INFINITE = "CASE WHEN d = 0 THEN 1::DOUBLE ELSE pow(0.95::DOUBLE, abs(d) - 1) END"
SCORES = pairs_sql(200, CONTINUAL) + """,
totals AS (SELECT sum(count_male) AS tm, sum(count_female) AS tf FROM counts),
scores AS (SELECT word, count_male, count_female, discrete_male, discrete_female,
  CASE WHEN least(count_male, count_female) = 0 THEN 1 ELSE 1 - least(count_male, count_female) / greatest(count_male, count_female) END AS count_disparity,
  log2((count_male / tm + pow(2::DOUBLE, -52)) / (count_female / tf + pow(2::DOUBLE, -52))) AS log_score FROM counts, totals)"""


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[float]]]:
    """The token vectors, and the attribute vectors: those of ids 0 and 1 (two rows)."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("long").alias("doc_id"))
    named = {f"attr{r['vec_id']}": [float(x) for x in r["vector"]] for r in rows.where("vec_id < 2").orderBy("vec_id").collect()}
    return rows, named


VEC = """comp AS (SELECT vec_id, label::BIGINT AS doc_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM comp GROUP BY vec_id),
vec AS (SELECT c.vec_id, c.doc_id, 'attr' || a.vec_id AS attr, abs(sum(c.x * a.x) / any_value(nc.n * na.n)) AS score
  FROM comp c JOIN comp a ON c.i = a.i AND a.vec_id < 2 JOIN norm nc ON nc.vec_id = c.vec_id JOIN norm na ON na.vec_id = a.vec_id GROUP BY ALL)"""
