"""The operators as queries over the tables of a folder."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import small_batches
from quern.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language_id import predict

    return predict(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_repeated, and the text that is left."""
    from quern.llm.line_dedup import dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, gone = dedup(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1))))
    return out.select("doc_id", "n_lines", F.coalesce(F.size(F.col(gone)), F.lit(0)).alias("n_repeated"), "text")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.tiling import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_lm_scoring, op2_warc, op3_line_dedup, op4_ann, op5_decontamination, op6_token_counts, op7_ngram_join, op8_secret_scan,
        op9_language_id, op10_packing,
    ]
    return {f.__name__: _shipped(f) for f in found}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


#: op2: digests, records and references as they should be.
WARC_SQL = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN first END AS refers_to, coalesce(url, '') AS url
FROM (SELECT page_id, url, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""

#: op7: the join on whole sets of words' 5-grams.
JOIN_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[\x00-\x08\x0e-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]', '', 'g'), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) i
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= 0.8 * (na.n + nb.n - k) - 1e-9),
r(id, c) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM p
  UNION SELECT p.b, min(r.c) FROM r JOIN p ON p.a = r.id LEFT JOIN recurring.r o ON o.id = p.b WHERE o.id IS NULL OR r.c < o.c GROUP BY p.b)
SELECT d.doc_id, coalesce(r.c, d.doc_id) AS class_id, coalesce(l.k, 0) AS n_links
FROM documents d LEFT JOIN r ON r.id = d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM p GROUP BY 1) l ON l.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The other queries are beyond SQL: tests hold them against brute force, exact round trips or held-out accuracy."""
    return {"op2_warc": WARC_SQL, "op7_ngram_join": JOIN_SQL}
