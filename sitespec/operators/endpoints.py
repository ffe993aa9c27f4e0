"""One endpoint per route, with an explained confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.functions.javascript import JSON_FORMAT
from sitespec.functions.json_text import mock_payload, response_sample, sample_is_scalar, sample_verified
from sitespec.functions.strings import no_strings
from sitespec.functions.urls import full_url, page_url

# Reasons, in this order.
REASON_FOUND = "Discovered via static JS analysis (apiCall/fetch call site)"
REASON_PAYLOAD = "Payload keys matched from FormData/JSON body"
REASON_READS = "Success/error branches detected in JS"
REASON_LIVE = "Live-verified against server"

SPEC = (
    "method", "function_purpose", "expected_payload_format", "guessed_payload_keys",
    "js_response_reading_keys", "response_schema", "raw_js_context",
)


def api_candidates(call_sites: DataFrame) -> DataFrame:
    """One row per ``(domain, url)``: the last call site's facts at the first one's place.

    Partial aggregation leaves one row per route and task, so a route that is
    called everywhere does not gather in one place.
    """
    place = F.struct("crawl_rank", "line_no")
    merged = call_sites.groupBy("domain", "url").agg(
        F.max_by(F.struct(*SPEC), place).alias("spec"), F.min(place).alias("first")
    )
    return merged.select(
        "domain", "url", "spec.*", F.col("first.crawl_rank").alias("crawl_rank"), F.col("first.line_no").alias("line_no")
    )


def confidence(payload_keys: Column, response_keys: Column, live: Column) -> Column:
    """``struct<score, reasons>``: 40, +15 payload keys, +15 response keys, +20 live."""
    facts = (
        (F.lit(True), 40, REASON_FOUND),
        (F.size(payload_keys) > 0, 15, REASON_PAYLOAD),
        (F.size(response_keys) > 0, 15, REASON_READS),
        (live, 20, REASON_LIVE),
    )
    score = sum((F.when(holds, points).otherwise(0) for holds, points, _ in facts), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for holds, _, reason in facts]))
    return F.struct(F.least(F.lit(100), score).alias("score"), reasons.alias("reasons"))


def endpoints(candidates: DataFrame) -> DataFrame:
    """Endpoints with defaults filled in, not verified yet."""
    filled = candidates.select(
        "domain", "url",
        F.coalesce("method", F.lit("GET")).alias("method"),
        F.coalesce("function_purpose", F.lit("unknown_function")).alias("function_purpose"),
        F.coalesce("expected_payload_format", F.lit(JSON_FORMAT)).alias("expected_payload_format"),
        F.coalesce("guessed_payload_keys", no_strings()).alias("guessed_payload_keys"),
        F.coalesce("js_response_reading_keys", no_strings()).alias("js_response_reading_keys"),
        "response_schema",
        F.coalesce("raw_js_context", F.lit("")).alias("raw_js_context"),
        "crawl_rank", "line_no",
    )
    return filled.select(
        "*",
        F.lit(False).alias("live_verified"),
        F.lit(False).alias("live_ok"),
        F.lit(None).cast("string").alias("live_response_sample"),
        F.lit(None).cast("string").alias("live_content_type"),
        confidence(F.col("guessed_payload_keys"), F.col("js_response_reading_keys"), F.lit(False)).alias("confidence"),
    )


def probe_plan(found: DataFrame) -> DataFrame:
    """What a prober would send for each endpoint. Nothing is sent here."""
    return found.select(
        "domain", "url", "method",
        full_url(page_url(F.col("domain"), F.lit("")), F.col("url")).alias("full_url"),
        mock_payload(F.col("method"), F.col("guessed_payload_keys")).alias("payload"),
    )


def latest_responses(responses: DataFrame) -> DataFrame:
    """The last captured response of each ``(domain, full_url, method)``.

    ``url`` may be a route or a full URL. The order is by response_id, responses without one first, and by a hash
    of the row, so that it is never NULL. One row per key and task is shuffled.
    """
    keyed = responses.withColumn("full_url", full_url(page_url(F.col("domain"), F.lit("")), F.col("url")))
    order = F.struct(
        F.coalesce("response_id", F.lit(-(2**63))).alias("id"),
        F.xxhash64("status_code", "content_type", "body").alias("row"),
    )
    last = keyed.groupBy("domain", "full_url", "method").agg(
        F.max_by(F.struct("status_code", "content_type", "body"), order).alias("r")
    )
    return last.select("domain", "full_url", "method", "r.*")


def verify(found: DataFrame, responses: DataFrame) -> DataFrame:
    """Check endpoints against captured responses.

    ``live_verified`` holds for any captured response whose sample can be
    checked, even a failed one; ``live_ok`` asks for status 200 as well. An
    endpoint without a captured response is not verified.
    """
    samples = latest_responses(responses).select(
        "domain", "full_url", "method",
        F.col("content_type").alias("live_content_type"),
        F.coalesce(F.col("status_code") == 200, F.lit(False)).alias("is_ok"),
        response_sample(F.col("content_type"), F.col("body")).alias("live_response_sample"),
    )
    checked = samples.withColumn("is_verified", sample_verified(F.col("live_response_sample")))
    plain = found.drop("live_verified", "live_ok", "live_response_sample", "live_content_type", "confidence")
    joined = plain.withColumn(
        "full_url", full_url(page_url(F.col("domain"), F.lit("")), F.col("url"))
    ).join(checked, ["domain", "full_url", "method"], "left")
    live = F.coalesce("is_verified", F.lit(False))
    return joined.select(
        *plain.columns,
        live.alias("live_verified"),
        (live & F.coalesce("is_ok", F.lit(False))).alias("live_ok"),
        "live_response_sample",
        "live_content_type",
        confidence(F.col("guessed_payload_keys"), F.col("js_response_reading_keys"), live).alias("confidence"),
    )


def verify_warnings(verified: DataFrame) -> DataFrame:
    """Endpoints whose response is a bare number, boolean or ``null``."""
    return verified.filter(sample_is_scalar(F.col("live_response_sample"))).select(
        "domain", F.col("url").alias("path"), F.lit("api").alias("stage"),
        F.concat(F.lit("response cannot be checked: "), "live_response_sample").alias("message"),
    )
