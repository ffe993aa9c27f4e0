"""API specification, explorer document and reports, line by line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.functions.json_text import json_object, json_text, schema_json
from sitespec.operators.ranking import number_within
from sitespec.operators.routes import ORDER

LINE_COLUMNS = ("domain", "section", "line_no", "line")


def spec_json() -> Column:
    """The ten exported facts of an endpoint."""
    sample = F.coalesce("live_response_sample", F.lit("null"))
    return json_object(
        ("function_purpose", json_text(F.col("function_purpose"))),
        ("method", json_text(F.col("method"))),
        ("expected_payload_format", json_text(F.col("expected_payload_format"))),
        ("guessed_payload_keys", F.to_json("guessed_payload_keys")),
        ("js_response_reading_keys", F.to_json("js_response_reading_keys")),
        ("extracted_response_schema_from_js", schema_json(F.col("response_schema"))),
        ("raw_js_context", json_text(F.col("raw_js_context"))),
        ("live_verified", F.col("live_verified").cast("string")),
        ("live_response_sample", sample),
        ("confidence", F.to_json("confidence")),
    )


def _route_json(with_null_title: bool) -> Column:
    """One route; the explorer leaves out a missing title, the report keeps it."""
    fields = F.struct("path", "file", "type", "format", "title")
    return F.to_json(fields, {"ignoreNullFields": "false" if with_null_title else "true"})


def _fixed(domains: DataFrame, section: int, line: Column) -> DataFrame:
    """One line per domain."""
    return domains.select(
        "domain", F.lit(section).alias("section"), F.lit(1).cast("bigint").alias("line_no"), line.alias("line")
    )


def _entries(numbered: DataFrame, section: int, text: Column) -> DataFrame:
    """One line per row, with a comma after all but the last of a domain."""
    comma = F.when(F.col("n") < F.col("size"), F.lit(",")).otherwise(F.lit(""))
    return numbered.select(
        "domain", F.lit(section).alias("section"), F.col("n").alias("line_no"), F.concat(text, comma).alias("line")
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select(*LINE_COLUMNS)


def _numbered_endpoints(found: DataFrame) -> DataFrame:
    return number_within(found, ["domain"], ["crawl_rank", "line_no", "url"], "n", "size")


def _numbered_routes(table: DataFrame) -> DataFrame:
    return number_within(table, ["domain"], list(ORDER), "n", "size")


def api_spec_lines(found: DataFrame) -> DataFrame:
    """``{url: facts}`` per domain in order of first call; domains without endpoints have no document."""
    numbered = _numbered_endpoints(found)
    domains = found.select("domain").distinct()
    entry = F.concat(json_text(F.col("url")), F.lit(":"), spec_json())
    return _all([_fixed(domains, 0, F.lit("{")), _entries(numbered, 1, entry), _fixed(domains, 2, F.lit("}"))])


def explorer_lines(domains: DataFrame, table: DataFrame) -> DataFrame:
    """``{domain, website_routes: [...]}`` per domain."""
    head = F.concat(F.lit('{"domain":'), json_text(F.col("domain")), F.lit(',"website_routes":['))
    return _all(
        [
            _fixed(domains, 0, head),
            _entries(_numbered_routes(table), 1, _route_json(False)),
            _fixed(domains, 2, F.lit("]}")),
        ]
    )


def _actions_json(actions: list[str]) -> Column:
    return F.lit("[" + ",".join(f'"{a}"' for a in sorted(actions)) + "]")


def report_json_lines(
    summary: DataFrame, found: DataFrame, table: DataFrame, tree: DataFrame, warnings: DataFrame, actions: list[str]
) -> DataFrame:
    """The whole result per domain. The route tree is given as a list of its lines."""
    specs, listed = _numbered_endpoints(found), _numbered_routes(table)
    tree_lines = number_within(tree.withColumnRenamed("line_no", "k"), ["domain"], ["section", "k"], "n", "size")
    noted = number_within(warnings, ["domain"], ["stage", "path", "message"], "n", "size")
    domain = json_text(F.col("domain"))
    entry = F.concat(json_text(F.col("url")), F.lit(":"), spec_json())
    note = json_text(F.concat_ws(": ", "stage", "path", "message"))
    head = F.concat(
        F.lit('{"domain":'), domain, F.lit(',"actions_run":'), _actions_json(actions), F.lit(',"pages_crawled":'),
        F.col("pages_crawled").cast("string"), F.lit(',"api_spec":{'),
    )
    return _all(
        [
            _fixed(summary, 0, head),
            _entries(specs, 1, entry),
            _fixed(summary, 2, F.lit('},"routes":[')),
            _entries(listed, 3, _route_json(True)),
            _fixed(summary, 4, F.concat(F.lit('],"explorer":{"domain":'), domain, F.lit(',"website_routes":['))),
            _entries(listed, 5, _route_json(False)),
            _fixed(summary, 6, F.lit(']},"explorer_visual":[')),
            _entries(tree_lines, 7, json_text(F.col("line"))),
            _fixed(
                summary, 8,
                F.concat(F.lit('],"assets_saved":'), F.col("assets_saved").cast("string"), F.lit(',"warnings":[')),
            ),
            _entries(noted, 9, note),
            _fixed(summary, 10, F.lit("]}")),
        ]
    )


def report_markdown_lines(
    summary: DataFrame, found: DataFrame, warnings: DataFrame, actions: list[str]
) -> DataFrame:
    """Heading, five counts, one section per endpoint, warnings if any."""

    def texts(*lines: Column) -> Column:
        return F.posexplode(F.array(*[F.coalesce(line, F.lit("")) for line in lines])).alias("k", "line")

    head = summary.select(
        "domain", F.lit(0).alias("section"),
        texts(
            F.concat(F.lit("# Inspection Report -- "), "domain"), F.lit(""),
            F.concat(F.lit("- Pages crawled: "), F.col("pages_crawled").cast("string")),
            F.concat(F.lit("- Routes discovered: "), F.col("routes").cast("string")),
            F.concat(F.lit("- API endpoints reconstructed: "), F.col("endpoints").cast("string")),
            F.concat(F.lit("- Static assets: "), F.col("assets_saved").cast("string")),
            F.lit("- Actions run: " + ", ".join(sorted(actions))), F.lit(""), F.lit("## API Spec"), F.lit(""),
        ),
    ).withColumn("line_no", F.col("k").cast("bigint") + 1)
    body = _numbered_endpoints(found).select(
        "domain", F.lit(1).alias("section"), "n",
        texts(
            F.concat(F.lit("### `"), "method", F.lit(" "), "url", F.lit("`")),
            F.concat(F.lit("- Purpose: "), "function_purpose"),
            F.concat(F.lit("- Payload format: "), "expected_payload_format"),
            F.concat(F.lit("- Confidence: "), F.col("confidence.score").cast("string")),
            F.lit(""),
        ),
    ).withColumn("line_no", (F.col("n") - 1) * 5 + F.col("k") + 1)
    noted = number_within(warnings, ["domain"], ["stage", "path", "message"], "line_no")
    notes = noted.select(
        "domain", F.lit(3).alias("section"), "line_no",
        F.concat(F.lit("- "), F.concat_ws(": ", "stage", "path", "message")).alias("line"),
    )
    parts = [head, body, _fixed(warnings.select("domain").distinct(), 2, F.lit("## Warnings")), notes]
    return _all([part.select(*LINE_COLUMNS) for part in parts])


# Report formats and their file extensions.
REPORTS = {"json": ".json", "markdown": ".md"}


def report_lines(fmt: str, summary, found, table, tree, warnings, actions: list[str]) -> DataFrame:
    """The report in one of the formats of ``REPORTS``; others are refused before any job runs."""
    if fmt not in REPORTS:
        raise ValueError(f"unknown report format {fmt!r}; known: {sorted(REPORTS)}")
    if fmt == "json":
        return report_json_lines(summary, found, table, tree, warnings, actions)
    return report_markdown_lines(summary, found, warnings, actions)


def write_lines(lines: DataFrame, path: str, folders: bool = False) -> None:
    """Write documents in order: as one table, or as text with one folder per domain.

    The lines are range-partitioned by domain and position, so a large document
    is written by many tasks; its text is its part files in order of name.
    Folders suit a moderate number of domains.
    """
    ordered = lines.sort("domain", "section", "line_no")
    if folders:
        ordered.select("domain", F.col("line").alias("value")).write.partitionBy("domain").text(path)
    else:
        ordered.write.parquet(path)
