from sitespec.streaming.snapshots import stream_call_sites, stream_links, stream_pages, stream_titles

__all__ = ["stream_call_sites", "stream_links", "stream_pages", "stream_titles"]
