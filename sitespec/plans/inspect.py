"""The one public call: inspect every site of a table of page snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitespec.functions.html import is_static_asset
from sitespec.functions.urls import clean_domain
from sitespec.operators.crawl import crawl
from sitespec.operators.endpoints import api_candidates, endpoints, verify, verify_warnings
from sitespec.operators.pages import explode_calls, explode_links, page_facts, unique_pages
from sitespec.operators.routes import routes, summary, tree_lines
from sitespec.plans.settings import PROFILES, page_budget, stages
from sitespec.schemas import materialize
from sitespec.sinks.clone import clone_files, clone_manifest, clone_warnings
from sitespec.sinks.clone_writer import write_clone
from sitespec.sinks.documents import REPORTS, api_spec_lines, explorer_lines, report_lines


@dataclass(frozen=True)
class Result:
    """Frames of one inspection; those not asked for are ``None``.

    Frames are lazy: the parse and the crawl are written once, everything else
    runs when it is used.
    """

    actions_run: list[str]
    pages: DataFrame
    skipped: DataFrame
    edges: DataFrame
    warnings: DataFrame
    summary: DataFrame
    endpoints: DataFrame | None = None
    routes: DataFrame | None = None
    #: Tables without rows, which a report shows for what was not asked for.
    nothing: tuple[DataFrame, DataFrame] | None = None
    #: Counts of each stage over all sites, taken while the jobs of the run wrote their tables.
    stages: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def domains(self) -> DataFrame:
        return self.summary.select("domain")

    def api_spec(self) -> DataFrame:
        return api_spec_lines(self._need("endpoints", "api"))

    def explorer(self) -> DataFrame:
        return explorer_lines(self.domains, self._need("routes", "routes"))

    def explorer_visual(self) -> DataFrame:
        return tree_lines(self.domains, self._need("routes", "routes"))

    def manifest(self) -> DataFrame:
        return clone_manifest(self.pages)

    def report(self, fmt: str = "json") -> DataFrame:
        """The report of whatever was asked for; parts that were not stay empty."""
        if fmt not in REPORTS:
            raise ValueError(f"unknown report format {fmt!r}; known: {sorted(REPORTS)}")
        found = self.endpoints if self.endpoints is not None else self.nothing[0]
        table = self.routes if self.routes is not None else self.nothing[1]
        tree = tree_lines(self.domains, table) if fmt == "json" else None
        return report_lines(fmt, self.summary, found, table, tree, self.warnings, self.actions_run)

    def clone(self, pages: DataFrame) -> DataFrame:
        """The files of the clone, (domain, path, local_path, text); ``pages`` are the snapshots of the run."""
        return clone_files(pages, self.manifest())

    def write_clone(self, pages: DataFrame, folder: str) -> None:
        """Write the clone below ``folder``, a file a page; see ``sitespec.sinks.write_clone``."""
        write_clone(self.clone(pages), folder)

    def _need(self, name: str, action: str) -> DataFrame:
        frame = getattr(self, name)
        if frame is None:
            raise ValueError(f"action {action!r} was not asked for")
        return frame


def inspect(
    pages: DataFrame,
    responses: DataFrame | None = None,
    actions: str | list[str] = "all_data",
    profile: str = "balanced",
    max_page: int | str = "all",
    domain: str | None = None,
    verify_live_apis: bool = True,
) -> Result:
    """Reconstruct structure and API of every site in ``pages`` (see ``as_pages``).

    Endpoints are verified when ``responses`` is given and the profile allows it.
    ``domain`` narrows the run to one site.
    """
    run = stages(actions)
    budget = page_budget(profile, max_page)
    if domain is not None:
        if not isinstance(domain, str) or not domain:
            raise ValueError("domain must be a non-empty string")
        pages = pages.filter(F.col("domain") == clean_domain(F.lit(domain)))

    facts = materialize(unique_pages(page_facts(pages)), "facts")
    reached = crawl(facts.select("domain", "path", "status_code", "links"), budget)
    if "html" not in run:
        facts = facts.withColumn("title", F.lit(None).cast("string"))
    of_pages, of_endpoints = Observation(), Observation()
    crawled = facts.join(reached.pages, ["domain", "path"]).observe(
        of_pages,
        F.count(F.lit(1)).alias("pages_crawled"),
        F.count("title").alias("html_titles"),
        F.count_if(is_static_asset(F.col("content_type"), F.col("path"))).alias("assets_saved"),
        F.coalesce(F.sum(F.when(F.col("calls").isNotNull(), F.size("calls"))), F.lit(0)).alias("call_sites"),
    )
    crawled = materialize(crawled, "crawled")

    warnings = [
        crawled.select(
            "domain", "path", F.lit("crawler").alias("stage"), F.explode(F.array_distinct("bad_links")).alias("host")
        ).select("domain", "path", "stage", F.concat(F.lit("invalid link host: "), "host").alias("message")),
        clone_warnings(crawled),
    ]
    found = table = None
    if "api" in run:
        found = endpoints(api_candidates(explode_calls(crawled)))
        if responses is not None and verify_live_apis and PROFILES[profile][1]:
            found = verify(found, responses)
        # Several frames use the endpoints; they are written once.
        found = found.observe(
            of_endpoints,
            F.count(F.lit(1)).alias("endpoints"),
            F.count_if("live_verified").alias("endpoints_verified"),
        )
        found = materialize(found, "endpoints")
        warnings.append(verify_warnings(found))
        if "routes" in run:
            table = routes(crawled, found)
    none = endpoints(api_candidates(explode_calls(crawled.filter(F.lit(False)))))
    nothing = (none, routes(crawled.filter(F.lit(False)), none))
    noted = reduce(DataFrame.unionByName, warnings)
    counts = summary(
        crawled, found if found is not None else _no_endpoints(crawled), noted, facts.select("domain").distinct()
    )
    if "assets" not in run:
        counts = counts.withColumn("assets_saved", F.lit(0).cast("bigint"))
    if "routes" not in run:
        counts = counts.withColumn("routes", F.lit(0).cast("bigint"))
    shown = crawled.drop("links", "bad_links", "calls")
    return Result(
        actions_run=run,
        pages=shown,
        skipped=reached.skipped,
        edges=explode_links(crawled),
        warnings=noted,
        summary=counts,
        endpoints=found,
        routes=table,
        nothing=nothing,
        stages=_stage_counts(run, of_pages.get, of_endpoints.get if found is not None else {}, reached.levels),
    )


def _stage_counts(run: list[str], pages: dict, found: dict, levels: int) -> dict[str, dict[str, int]]:
    """What each stage of the run has counted; routes are pages and endpoints together."""
    counts = {
        "crawler": {"pages_crawled": pages["pages_crawled"], "levels": levels},
        "html": {"html_titles": pages["html_titles"]},
        "assets": {"assets_saved": pages["assets_saved"]},
        "javascript": {"call_sites": pages["call_sites"]},
        "api": found,
        "routes": {"routes": pages["pages_crawled"] + found.get("endpoints", 0)},
    }
    return {stage: dict(counts[stage]) for stage in counts if stage in run}


def _no_endpoints(pages: DataFrame) -> DataFrame:
    return pages.select("domain", F.lit(False).alias("live_verified")).filter(F.lit(False))
