"""The queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (
    ball_tree,
    best_fit,
    byte_bpe,
    compact_windows,
    importance,
    line_templates,
    lsh_forest,
    mixing,
    phrases,
    quality,
    suffix_arrays,
    syncmers,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _queries[name] = function
        if oracle is not None:
            _oracles[name] = oracle
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


_RESAMPLED = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) AS r(i))
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), counted AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL
), bytes AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)
), buckets AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS b
  FROM bytes, crc_table
), totals AS (
  SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN buckets USING (f) GROUP BY b
), sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals
), gains AS (
  SELECT b, floor(1000 * ln((t::DOUBLE + 1) * (s_all::DOUBLE + 10000) / ((s::DOUBLE + 1) * (t_all::DOUBLE + 10000)))) AS gain FROM totals, sums
), weights AS (
  SELECT id, floor(sum(n * gain) / sum(n)) AS weight
  FROM counted JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
    count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n_words >= 20 AND r <= 25 * eligible // 100 THEN r END AS rank FROM ranked
"""


@query("op12_importance_resampling", _RESAMPLED)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, 4) AS r(k)
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), found AS (SELECT *, string_split(phrase, ' ') AS s FROM counts WHERE k >= 2 AND f >= 10
), cuts AS (SELECT *, unnest(range(1, k)) AS j FROM found
), scores AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:j], ' ')
  JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(s[j + 1:], ' ')
), least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, f, array_to_string(s[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, 3)) AS i FROM found WHERE k = 3)
), covered AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least AS l LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR k = 3 OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", _COLLOCATIONS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.takes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_lsh_forest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quadratic_discriminant")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of the URL query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_closed_syncmers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op9_line_templates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_dropped").alias("dropped_lines"))


@query("op10_ball_tree_top_k")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query("op1_sparse_suffix_arrays")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.repeated_spans(table(spark, sf_dir, "documents"))


@query("op8_compact_windows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))
