"""Sources: captured page snapshots and captured API responses."""

from sitespec.sources.captures import as_pages, load_pages, load_responses, ok_only, skipped, spread

__all__ = ["as_pages", "load_pages", "load_responses", "ok_only", "skipped", "spread"]
