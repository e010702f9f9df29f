"""The registered queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("line_coverage", "worst_coverage")})


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.top_k import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from paritas.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from paritas.llm.pfor import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from paritas.llm.byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 without the model's verdicts, which SQL can't express."""
    out = op6_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of op6's model: how many distinct ones of each length a url has."""
    from paritas.llm.url_filter import GRAMS, grams, host_and_path

    host, path = host_and_path(F.col("url"))
    cut = table(spark, sf_dir, "pages").select("page_id", F.concat(host, path).alias("u"))
    return cut.select("page_id", *[F.size(F.array_distinct(grams(F.col("u"), n))).cast("long").alias(f"grams_{n}") for n in GRAMS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return own | {"url_rules": url_rules, "url_features": url_features}


SPACE_SQL = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

URL_SQL = r"""SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)"""

WORD_SQL = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op11_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, g, count(*)::HUGEINT AS a
  FROM (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) sizes(size) WHERE len(w) >= size))
  GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, g, string_split(g, ' ') AS w, a FROM grams WHERE a >= 30),
cuts AS (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1)),
scored AS (SELECT c.lang, c.g, c.a, k, p.a AS l, q.a AS r, (2000000 * c.a) // (p.a + q.a) AS score FROM cuts c JOIN often p ON p.lang = c.lang AND p.g = x JOIN often q ON q.lang = c.lang AND q.g = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS g, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM often, (VALUES (2), (3)) lengths(m) WHERE size > m) GROUP BY ALL),
ranked AS (
  SELECT s.lang, s.g AS phrase, s.a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.g) AS rank
  FROM lowest s LEFT JOIN inner_ i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100 * longer < 80 * s.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS dropped
  FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op2_quality_rules": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD_SQL}') AS w FROM docs),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
chars AS (SELECT r, i, length(word) AS c FROM words),
windows AS (
  SELECT r, n, i, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS nth, count(*) OVER (PARTITION BY r, n, g) AS times
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (VALUES (5), (6), (8), (10)) lengths(n) WHERE len(w) >= n))),
marks AS (SELECT r, n, unnest(range(i, i + n)) AS i, nth > 1 AS later FROM windows WHERE times > 1),
marked AS (SELECT r, n, i, bool_or(later) AS later FROM marks GROUP BY ALL),
sums AS (
  SELECT r, n, count(*) AS n_marked, sum(c) FILTER (WHERE later) AS c_later FROM marked JOIN chars USING (r, i) GROUP BY r, n),
totals AS (SELECT r, count(*) AS n_words, sum(c) AS word_chars FROM chars GROUP BY r),
worst AS (
  SELECT s.r, max(n_marked) FILTER (WHERE n = 8) AS n_repeat, max(c_later / word_chars::DOUBLE / CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 8 THEN 0.12 ELSE 0.10 END::DOUBLE) AS worst
  FROM sums s JOIN totals USING (r) GROUP BY s.r),
lines AS (
  SELECT r, strlen(regexp_replace(line, '[ 	-
]', '', 'g')) AS c, row_number() OVER (PARTITION BY r, line) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
repeated AS (SELECT r, count(*) FILTER (WHERE nth > 1) AS n_dup, sum(c) FILTER (WHERE nth > 1) / sum(c)::DOUBLE AS cover FROM lines WHERE c > 0 GROUP BY r),
base AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    CASE WHEN n_words > 0 THEN len(regexp_extract_all(text, '[#*$%&|<>]')) ELSE 0 END::BIGINT AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(cover, 0) AS cover, coalesce(worst, 0) AS worst
  FROM docs LEFT JOIN totals USING (r) LEFT JOIN worst USING (r) LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND worst <= 1 AND cover <= 0.2::DOUBLE AS kept, round(cover, 6) AS line_coverage, round(worst, 6) AS worst_coverage
FROM base
""",
    "url_rules": f"""
WITH cut AS ({URL_SQL}), rules(rule_host, rule_path, what) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(what, length(rule_host || rule_path)) AS ruled
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM cut LEFT JOIN fit USING (page_id)
""",
    "url_features": f"""
WITH cut AS ({URL_SQL}), marked AS (SELECT page_id, '^' || host || path || '$' AS u FROM cut),
grams AS (SELECT page_id, n, substr(u, i::BIGINT, n) AS g FROM (SELECT page_id, n, u, unnest(range(1, length(u) - n + 2)) AS i FROM marked, (VALUES (3), (4), (5)) lengths(n)))
SELECT page_id, count(DISTINCT g) FILTER (WHERE n = 3) AS grams_3, count(DISTINCT g) FILTER (WHERE n = 4) AS grams_4, count(DISTINCT g) FILTER (WHERE n = 5) AS grams_5
FROM marked LEFT JOIN grams USING (page_id) GROUP BY page_id
""",
    "op12_ranked_search": r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT * FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
asked AS (
  SELECT q, item_id, term, count(*) AS k FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)) GROUP BY ALL),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, corpus GROUP BY term, n_docs),
scores AS (
  SELECT q, item_id, r, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM split),
nodes AS (SELECT md5(array_to_string(s, chr(10))) AS node, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT node, least, len(s) AS size, unnest(s) AS shingle FROM nodes),
links AS (
  SELECT x.least AS a, y.least AS b FROM items x JOIN items y ON x.shingle = y.shingle AND x.node <> y.node AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)
  GROUP BY x.node, y.node, x.least, y.least, x.size, y.size HAVING 9 * count(*) >= 4 * (x.size + y.size)),
reached AS (SELECT least AS a, least AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS component FROM reached GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN nodes ON len(sets.s) > 0 AND node = md5(array_to_string(sets.s, chr(10))) LEFT JOIN lowest ON a = least
""",
    "op3_top_k": """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM clean),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM comp q JOIN comp c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
