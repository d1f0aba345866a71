"""The queries op1 to op10 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    from quern.llm import sentencepiece_codec as codec

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return codec.encode(spark, docs, tokenizer_path(), round_trip="round_trip").select("doc_id", "ids", "n_tokens", "round_trip")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.url_filter import filter_urls

    return filter_urls(spark, _read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT q.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
          row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS n
        FROM q JOIN rules r ON (q.host = r.rule_host OR ends_with(q.host, '.' || r.rule_host)) AND starts_with(q.path, r.rule_path))
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM q LEFT JOIN fit f ON f.page_id = q.page_id AND f.n = 1
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.embedding_dedup import near_duplicates

    return near_duplicates(spark, _read(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import taken_words

    return taken_words(spark, _read(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=[3, 1, 2], share=1.5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language_id import identify, learn

    docs = _read(spark, sf_dir, "documents")
    return identify(spark, docs, learn(spark, docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import score_quality

    docs = _read(spark, sf_dir, "documents")
    return score_quality(spark, docs, docs, _read(spark, sf_dir, "labels"), cut=0.3)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii import digest, find_pii

    return digest(find_pii(spark, _read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_counts import count_tokens

    return count_tokens(spark, _read(spark, sf_dir, "documents"), tokenizer_path(), limit=4096)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import jaccard_components

    return jaccard_components(spark, _read(spark, sf_dir, "documents"), k=3, p=9, q=10)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.topk_search import top_k

    return top_k(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_join": op9_ngram_join,
    "op10_topk_search": op10_topk_search,
}

ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op10_topk_search": OP10_SQL}
