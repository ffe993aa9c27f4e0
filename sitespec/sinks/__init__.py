"""Sinks: documents as ordered lines, clone files, reports.

No document is put together in one row or one task: each is a table of lines
``(domain, section, line_no, line)``, and its text is those lines in order.
"""

from sitespec.sinks.clone import clone_files, clone_manifest, clone_warnings, local_path
from sitespec.sinks.clone_writer import write_clone
from sitespec.sinks.documents import (
    REPORTS, api_spec_lines, explorer_lines, report_json_lines, report_lines, report_markdown_lines, write_lines,
)

__all__ = [
    "REPORTS", "api_spec_lines", "clone_files", "clone_manifest", "clone_warnings", "explorer_lines",
    "local_path", "report_json_lines", "report_lines", "report_markdown_lines", "write_clone", "write_lines",
]
