"""Queries over vectors, names in text and tags, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions import markdown, stems
from paritas.operators import bias, debias, gazetteer, pareto, tagging
from paritas.plans import views as V
from paritas.plans.catalogue import query, rounded

# --- vectors without a direction -------------------------------------------------------------------------------------------


@query("""WITH comp AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM comp),
d AS (SELECT a.i, a.x - b.x AS x FROM comp a JOIN comp b ON a.i = b.i WHERE a.vec_id = 0 AND b.vec_id = 1),
g AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM d),
dots AS (SELECT vec_id, sum(u.x * g.x) AS t FROM u JOIN g USING (i) GROUP BY vec_id),
plain AS (SELECT u.vec_id, u.i, u.x - t * g.x AS x FROM u JOIN dots USING (vec_id) JOIN g ON g.i = u.i),
neutral AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM plain),
mid AS (SELECT p.vec_id AS a, q.vec_id AS b, p.i, (p.x + q.x) / 2 AS m, p.x - q.x AS apart FROM u p JOIN u q ON q.vec_id = p.vec_id + 1 AND q.i = p.i WHERE p.vec_id % 20 = 2),
sums AS (SELECT a, sum(m * g.x) AS mg, sum(apart * g.x) AS ag FROM mid JOIN g USING (i) GROUP BY a),
flat AS (SELECT mid.a, b, mid.i, m - mg * g.x AS f, g.x AS gx FROM mid JOIN sums ON sums.a = mid.a JOIN g ON g.i = mid.i),
height AS (SELECT flat.a, sqrt(greatest(0, 1 - sum(f * f))) * CASE WHEN any_value(ag) < 0 THEN -1 ELSE 1 END AS z FROM flat JOIN sums ON sums.a = flat.a GROUP BY flat.a),
equal AS (SELECT flat.a AS vec_id, i, f + z * gx AS x FROM flat JOIN height ON height.a = flat.a UNION ALL SELECT b, i, f - z * gx FROM flat JOIN height ON height.a = flat.a)
SELECT u.vec_id, u.i, round(coalesce(e.x, CASE WHEN u.vec_id % 10 = 0 THEN u.x ELSE n.x END), 6) AS x
FROM u JOIN neutral n ON n.vec_id = u.vec_id AND n.i = u.i LEFT JOIN equal e ON e.vec_id = u.vec_id AND e.i = u.i""")
def debiased_vectors(s, d):
    rows, named = V.vectors(s, d)
    words = rows.select(F.col("vec_id").alias("word"), "vector")
    direction = [a - b for a, b in zip(named["attr0"], named["attr1"])]
    pairs = words.where("word % 20 = 2").select(F.col("word").alias("a"), (F.col("word") + 1).alias("b"))
    out = debias.debiased(words, direction, words.where("word % 10 = 0"), pairs)
    return rounded(out.select(F.col("word").alias("vec_id"), F.posexplode("vector").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), "x"))


@query("""WITH words AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
tokens AS (SELECT p_partkey, k, coalesce(list_sum(list_transform(w[1 : k], lambda x: length(x))), 0)::BIGINT AS a, length(w[k + 1]) AS n FROM (SELECT p_partkey, w, unnest(range(len(w))) AS k FROM words)),
pieces AS (SELECT p_partkey, 3 * j AS a, least(3 * j + 3, n) AS b FROM (SELECT p_partkey, n, unnest(range((n + 2) // 3)) AS j FROM (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part)))
SELECT t.p_partkey, k, sum(p.b - p.a)::DOUBLE AS letters, sum(p.a)::DOUBLE AS places FROM tokens t JOIN pieces p ON p.p_partkey = t.p_partkey AND p.a < t.a + t.n AND p.b > t.a GROUP BY t.p_partkey, k""")
def subword_vectors(s, d):
    """Names cut into pieces of three letters that cross the words; each piece's vector is its length and place."""
    words = V.table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.regexp_extract_all(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.lit("(.{1,3})")).alias("parts"))
    tokens, pieces = debias.aligned_pieces(F.col("words"), F.col("parts"))
    rows = words.select("p_partkey", tokens.alias("tokens"), pieces.alias("pieces"))
    rows = rows.withColumn("vectors", F.transform("pieces", lambda p: F.array((p["end"] - p["start"]).cast("double"), p["start"].cast("double"))))
    out = debias.subword_vectors(rows, size=2).select("p_partkey", F.posexplode("token_vectors").alias("k", "v"))
    return out.select("p_partkey", F.col("k").cast("long").alias("k"), F.col("v")[0].alias("letters"), F.col("v")[1].alias("places"))


# --- names found in text ------------------------------------------------------------------------------------------------------


@query("""WITH names AS (SELECT p_name AS name, p_type AS value FROM part WHERE p_partkey % 5 = 0 UNION SELECT string_split(p_name, ' ')[2], 'noun' FROM part WHERE p_partkey % 7 = 0),
known AS (SELECT name, list_sort(list(DISTINCT value)) AS of FROM names GROUP BY name),
words AS (SELECT p_partkey, p_name, unnest([0, 1]) AS k, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT w.p_partkey, k, coalesce(f.name, n.name) AS name, array_to_string(coalesce(f.of, n.of), '|') AS of
FROM words w LEFT JOIN known f ON f.name = p_name LEFT JOIN known n ON n.name = word
WHERE f.name IS NOT NULL AND k = 0 OR f.name IS NULL AND n.name IS NOT NULL""")
def gazetteer_names(s, d):
    """Whole names of some parts and second words of others, in the names of all; the longer one wins."""
    parts = V.table(s, d, "part")
    whole = parts.where("p_partkey % 5 = 0").select(F.col("p_name").alias("name"), F.col("p_type").alias("value"))
    names = whole.union(parts.where("p_partkey % 7 = 0").select(F.split("p_name", " ")[1], F.lit("noun")))
    found = gazetteer.mentions(parts, names, "p_partkey", "p_name", value="value").select("p_partkey", F.explode("mentions").alias("m"))
    return found.select("p_partkey", F.when(F.col("m.start") > 0, 1).otherwise(0).cast("long").alias("k"), F.col("m.name").alias("name"), F.array_join("m.values", "|").alias("of"))


_NAMES = """firsts AS (SELECT lower(regexp_extract(text, '^([a-zA-Z]+) ([a-zA-Z]+)[^\\p{L}\\p{N}_]', 1)) AS x, lower(regexp_extract(text, '^([a-zA-Z]+) ([a-zA-Z]+)[^\\p{L}\\p{N}_]', 2)) AS y, 'g' || (item_id % 3) AS value FROM benchmark),
two AS (SELECT x, y, value FROM firsts WHERE x <> '' AND y NOT IN (SELECT x FROM firsts)),
one AS (SELECT x, value || 'w' AS value FROM firsts WHERE x <> ''),"""


@query("WITH " + _NAMES + """
split AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]') AS w FROM documents),
tok AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
pairs AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS sep, lead(word, 2) OVER o AS next FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
long AS (SELECT doc_id, i, value FROM pairs JOIN two ON word = x AND sep = ' ' AND next = y),
short AS (SELECT t.doc_id, value FROM tok t JOIN one ON word = x WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.doc_id = t.doc_id AND (l.i = t.i OR l.i + 2 = t.i))),
found AS (SELECT doc_id, value FROM long UNION SELECT doc_id, value FROM short)
SELECT d.doc_id, coalesce(string_agg(value, '|' ORDER BY value), '') AS of FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id""")
def gazetteer_sensor(s, d):
    """The first two words of every benchmark item, and the first one alone, in all documents."""
    opening = r"^([a-zA-Z]+) ([a-zA-Z]+)[^\p{L}\p{N}_]"
    firsts = V.table(s, d, "benchmark").select(F.lower(F.regexp_extract("text", opening, 1)).alias("x"), F.lower(F.regexp_extract("text", opening, 2)).alias("y"), F.concat(F.lit("g"), F.col("item_id") % 3).alias("value")).where("x != ''")
    two = firsts.join(firsts.select(F.col("x").alias("y")).distinct(), "y", "left_anti").select(F.concat_ws(" ", "x", "y").alias("name"), "value")
    names = two.union(firsts.select("x", F.concat("value", F.lit("w"))))
    texts = V.spread(V.table(s, d, "documents").select("doc_id", "text"))
    found = gazetteer.gazetteer_sensor(texts, names, "value")
    return found.select("doc_id", F.array_join("values", "|").alias("of"))


# --- tags ----------------------------------------------------------------------------------------------------------------------


def _sentences(s, d) -> DataFrame:
    docs = V.spread(V.table(s, d, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_id", "line"))
    return lines.select("doc_id", "par_id", F.regexp_extract_all("line", F.lit(r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"), F.lit(1)).alias("words"))


@query()
def tagged_tokens(s, d):
    """Documents with even ids, tagged by a rule over the words, teach the tagger that tags the others: words under the form they count as, by tag."""
    rule = lambda w: F.when(w.rlike(r"^\p{N}+$"), "NUM").when(~w.rlike(r"^\p{L}"), "PUNCT").when(F.lower(w).isin(*V.STOPWORDS), "DET").when(w.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")
    rows = _sentences(s, d)
    tagger = tagging.fit_tagger(rows.where("doc_id % 2 = 0").withColumn("tags", F.transform("words", rule)))
    tagged = tagging.tag(rows.where("doc_id % 2 = 1"), tagger)
    tokens = bias.lexical_tokens(tagged.select("doc_id", "par_id", tagging.tagged_tokens(F.col("words"), F.col("tags")).alias("tokens")), ["he", "she"])
    return tokens.select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id", F.col("t.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t.word").alias("words"))


# --- fronts -----------------------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE p AS (SELECT p_partkey % 11 AS x, p_size::BIGINT % 7 AS y, p_partkey % 5 AS z, count(*) AS n FROM part GROUP BY ALL),
better AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z FROM p a JOIN p b ON a.x >= b.x AND a.y <= b.y AND a.z >= b.z AND (a.x > b.x OR a.y < b.y OR a.z > b.z)),
chain AS (SELECT x, y, z, 0 AS f FROM p UNION SELECT b.x, b.y, b.z, c.f + 1 FROM chain c JOIN better b ON b.ax = c.x AND b.ay = c.y AND b.az = c.z)
SELECT max(f)::BIGINT AS front, x, y, z, any_value(n) AS n FROM chain JOIN p USING (x, y, z) GROUP BY x, y, z""")
def pareto_fronts_3d(s, d):
    points = V.table(s, d, "part").select((F.col("p_partkey") % 11).alias("x"), (F.col("p_size").cast("long") % 7).alias("y"), (F.col("p_partkey") % 5).alias("z"))
    ranked = pareto.fronts(points, ["x", "y", "z"], [True, False, True])
    return ranked.groupBy("front", "x", "y", "z").agg(F.count(F.lit(1)).alias("n")).select(F.col("front").cast("long").alias("front"), "x", "y", "z", "n")


# --- texts ------------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || p_partkey || chr(10) || 'size' || chr(9) || 'name' || chr(10) || p_size || chr(9) || p_name || chr(10) || '# ' || p_name AS text FROM part")
def markdown_text(s, d):
    """A heading, a nested list, a table and a fence around each part's values."""
    pieces = ["# ", "p_name", "\n\n- *", "p_type", "*\n  1. `", "p_partkey", "`\n\n| size | name |\n|:--|---|\n| **", "p_size", "** | [", "p_name", "](http://x.y) |\n\n```\n# ", "p_name", "\n```\n"]
    text = F.concat(*[F.col(x).cast("string") if x.startswith("p_") else F.lit(x) for x in pieces])
    return V.table(s, d, "part").select("p_partkey", markdown.markdown_text(text).alias("text"))


@query()
def stemmed_words(s, d):
    """The distinct words of the documents and their English stems, by first letter."""
    words = V.spread(V.table(s, d, "documents").select("text")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    made = stems.stem_table(words, "english")
    return made.groupBy(F.substring("word", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("words"), F.count_distinct("stem").alias("stems"))
