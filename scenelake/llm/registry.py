"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gone_at_exit, new_path, table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


#: Fixed values of the contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op3_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import from_documents, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, from_documents(pages, table(spark, sf_dir, "labels")))


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_shards, write_shards

    path = new_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path, word_bpe_path())
    gone_at_exit(spark, path)
    return read_shards(spark, path)


def op5_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op6_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digests

    return digests(table(spark, sf_dir, "documents"), word_bpe_path())


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), word_bpe_path())


def op10_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7 that SQL can express: counts and base rule."""
    from .quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("kept")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 3 that SQL can express: host, path and rule."""
    return op3_url_boosted_trees(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("said"))


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 9 that SQL can express: bytes of each text."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES = (
    op1_pigeonhole_decontamination,
    op2_tag_path_ratios,
    op3_url_boosted_trees,
    op4_wavelet_shards,
    op5_hashed_maxent,
    op6_bpe_rank_array,
    op7_adaptive_quality,
    op8_simhash_tiles,
    op9_token_counts,
    op10_levenshtein_toxicity,
    quality_counts,
    url_rules,
    text_sizes,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


ORACLE_SQL = {
    "quality_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 g AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
 e AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(words) - 1)) AS i FROM g),
 f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id)
SELECT g.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(words) AS base_failed FROM g LEFT JOIN c ON c.doc_id = g.doc_id""",
    "url_rules": r"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, h, pre, said)),
 m AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(said, len(rule)) AS said FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, said FROM p LEFT JOIN m ON m.page_id = p.page_id""",
    "text_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
