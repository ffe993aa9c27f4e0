"""The registered queries of the dealt operators: thin readings of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitespec.llm.binary_codes import near_vectors
from sitespec.llm.byte_cnn import identify_languages
from sitespec.llm.common import table
from sitespec.llm.divergence import audit_sources
from sitespec.llm.hard_negatives import mine_hard_negatives
from sitespec.llm.imatch import fingerprints
from sitespec.llm.licenses import scan_licenses
from sitespec.llm.minmax_dedup import near_duplicates
from sitespec.llm.mixing import domains_of, mixing_rates
from sitespec.llm.pieces import piece_round_trip
from sitespec.llm.secrets import BASE, joined, scan_secrets
from sitespec.llm.token_records import token_records
from sitespec.llm.url_rules import filter_urls
from sitespec.llm.warc import warc_round_trip


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents over five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings by cosine."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written as binary records and read back."""
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts and a digest of the base kinds, and all spans."""

    def of_kinds(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(of_kinds(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE),
        F.sha2(joined(of_kinds(*(rule.kind for rule in BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text."""

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    words, base, more = F.col("places.word"), F.col("places.label"), F.col("notices.label")
    best = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.score"), F.lit(0.0)))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        best.alias("score"),
    )


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole text and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


#: Shares of the tokens that the mixture shall hold, by domain (quality and toxicity).
WEIGHTS = {"q1t0": 0.8, "q0t0": 0.145, "q1t1": 0.05, "q0t1": 0.005}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the domains learned from ``labels`` to their shares."""
    return mixing_rates(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), WEIGHTS)[0]


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back by verified record boundaries."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, each checked against the original library."""
    return piece_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), every=1)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their words, and the words that each uses most above its language."""
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with the labels of every seventh shifted."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by base rules, else by mined token rules."""
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minmax_dedup": op1_minmax_dedup,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_records": op4_token_records,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_imatch": op7_imatch,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
