"""The queries opN_<name> over the driver's tables, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, maxent, merkle, mixing, pii, quality_rules, ranker, simhash, token_counts, toxicity, twins, vector_codes, warc
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on the driver; its content goes to the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> bpe.ByteBPE:
    import public_tokenizers

    return bpe.ByteBPE(bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return maxent.language_model_scores(docs, size=maxent.size_for(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_digests(table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_toxicity, op2_warc, op3_lm_scoring, op4_token_counts, op5_quality_rules, op6_simhash, op7_mixing, op8_byte_bpe, op9_quality_classifier, op10_fingerprints,
        op11_vector_codes, op12_conversation_repair, op13_pii,
    )
    return {f.__name__: f for f in ops}


def _op2_sql() -> str:
    """The archive's columns; base 32 takes five hexadecimal digits at a time."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({v} >> {s}) & 31), 1)"
    parts = [digit.format(v=f"CAST('0x' || substr(h, {i + 1}, 5) AS INTEGER)", s=s) for i in range(0, 40, 5) for s in (15, 10, 5, 0)]
    sha1 = " || ".join(parts)
    end = "chr(13) || chr(10)"
    url = r"coalesce(nullif(trim(regexp_replace(url, '\\s+', ' ', 'g')), ''), 'about:blank')"
    lines = ["'WARC/1.1'", "'WARC-Type: ' || kind", "'WARC-Record-ID: <urn:page:' || page_id || '>'", "'WARC-Date: 1970-01-01T00:00:00Z'", f"'WARC-Target-URI: ' || {url}", "'WARC-Payload-Digest: sha1:' || digest"]
    revisit = ["'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'", "'WARC-Refers-To: <urn:page:' || first || '>'"]
    ends = ["'Content-Type: application/octet-stream'", "'Content-Length: ' || CASE kind WHEN 'revisit' THEN 0 ELSE strlen(t) END"]
    head = f" || {end} || ".join(lines) + f" || {end} || CASE kind WHEN 'revisit' THEN " + f" || {end} || ".join(revisit) + f" || {end} ELSE '' END || " + f" || {end} || ".join(ends)
    return (
        "WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), "
        f"q AS (SELECT *, {sha1} AS digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS kind FROM p) "
        "SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest, kind AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, "
        f"sha256({head} || {end} || {end} || CASE kind WHEN 'revisit' THEN '' ELSE t END || {end} || {end}) AS record_sha256 FROM q"
    )


def oracle_sql() -> dict[str, str]:
    """SQL says all of op2, op11 and op12. The others need hashes, models or vocabularies that SQL lacks; tests hold them against brute force."""
    return {"op2_warc": _op2_sql(), "op11_vector_codes": twins.op11_sql(), "op12_conversation_repair": twins.op12_sql()}
