"""Structure and API reconstruction for many web sites at once, on Spark."""

from sitespec.plans.inspect import Result, inspect
from sitespec.sources import as_pages, load_pages, load_responses

__all__ = ["Result", "as_pages", "inspect", "load_pages", "load_responses"]
