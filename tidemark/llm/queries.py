"""The queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import classify_language

    return classify_language(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify_quality

    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify_toxicity

    return classify_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix SQL can say: sizes and targets."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the fingerprints SQL can say: lengths and the edited texts."""
    return op5_merkle(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the secret scan SQL can say: the base counts."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language, op3_quality_rules, op4_mixing, op5_merkle, op6_simhash, op7_quality, op8_secrets, op9_toxicity, op10_suffix_dedup)
}

#: What SQL can say of operators that it can't express whole.
PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (mixing_targets, edited_texts, secret_counts)}

ORACLES: dict[str, str] = {
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                   string_split(text, chr(10)) AS lines, text, doc_id, source FROM d
        ), triples AS (
            SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
        ), again AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM triples) WHERE n > 1
        ), covered AS (
            SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r
        ), ln AS (
            SELECT r, unnest(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM w
        ), dup AS (
            SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r
        ), normal AS (
            SELECT l.r, coalesce('v' || source, 'n') AS h, md5(text) AS k, doc_id,
                   lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM ln l JOIN w USING (r)
        ), lines AS (
            SELECT h, line, count(DISTINCT k) AS n,
                   min({'a': doc_id IS NULL, 'b': coalesce(doc_id, 0), 'k': k}) AS first FROM normal GROUP BY h, line
        ), gone AS (
            SELECT r, sum(len(string_split(n.line, ' '))) AS n FROM normal n JOIN lines l USING (h, line)
            WHERE l.n > 50 AND l.first.k <> n.k GROUP BY r
        ), base AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                   CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
            FROM w LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept,
               n_removed_words
        FROM base
    """,
}

PART_ORACLES: dict[str, str] = {
    "mixing_targets": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
        ), w AS (
            SELECT source, source_size, i, CASE i % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s
        ), r AS (
            -- By the level at which a source is full: what those before it hold, and the weights from it on.
            SELECT *, 1.5 * sum(source_size) OVER () AS total,
                   coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                   sum(w) OVER (ORDER BY 2.0 * source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM w
        ), t AS (
            SELECT source, source_size, least(2.0 * source_size, w * max((total - held)::DOUBLE / rest) OVER ()) AS target FROM r
        )
        SELECT doc_id, size, source_size, round(target::DOUBLE, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
    "edited_texts": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t FROM documents
        ), n AS (
            SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER by_id, first_value(t) OVER by_id) AS nx
            FROM d WINDOW by_id AS (ORDER BY doc_id DESC NULLS LAST, t)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, n - n // 3) || substring(nx, 1, n // 3)) AS edited_sha256 FROM n
    """,
    "secret_counts": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t FROM documents
        )
        SELECT doc_id,
               CAST(len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2),
                                    lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
        FROM d
    """,
}
