"""A training-data pipeline over ``documents``: languages, near-duplicates, secrets, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitespec.llm.byte_cnn import UNDETERMINED, language_of, learn_languages
from sitespec.llm.common import materialize, table, text_batches
from sitespec.llm.minmax_dedup import without_near_duplicates
from sitespec.llm.mixing import domains_of, mixed_documents
from sitespec.llm.pieces import encode_pieces
from sitespec.llm.secrets import redact_secrets

#: Documents whose language has a lower mean posterior go; with four languages, mere chance gives 0.25.
LEAST_SCORE = 0.4
#: Shares of the tokens by domain (quality and toxicity as learned from ``labels``): the stated need is that toxic
#: text makes 8 % at most, and text that is poor as well 0.5 %, whatever that repeats of the rest.
WEIGHTS = {"q1t0": 0.8, "q0t0": 0.12, "q1t1": 0.075, "q0t1": 0.005}

#: Words that a worker process of the last stage remembers; the stages before it leave it little memory.
WORDS = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``lang`` is the predicted one.

    NULL texts and texts without a letter go, and those that the network is unsure of. All columns stay.
    """
    text_batches(spark)
    found = docs.withColumn("_found", language_of(F.col("text"), learn_languages(docs)))
    sure = (F.col("_found.lang") != UNDETERMINED) & (F.col("_found.score") >= LEAST_SCORE)
    return found.filter(sure).withColumn("lang", F.col("_found.lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest id."""
    text_batches(spark)
    return without_near_duplicates(docs, percent=80, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced and ``n_chars`` counted anew."""
    text_batches(spark)
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as brings the domains to their shares of the tokens; each at least once.

    The lower bound of 1 leaves no clean document out: shares are reached by repeating documents of the domains
    that are short.
    """
    return mixed_documents(docs, domains_of(table(spark, sf_dir, "labels")), WEIGHTS, lower=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of every row."""
    text_batches(spark)
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), memory=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing", mixture),
    ("SentencePiece", token_ids),
]

#: Classifiers, signatures and tokenizers are not SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
