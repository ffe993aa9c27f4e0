"""URL functions: splitting, RFC 3986 joining, domains, extensions.

``parse_url`` is not used: it goes through ``java.net.URI``, which refuses
many links found in real pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.strings import let, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
# Pieces between slashes that dot segments take away, and that no other segment has to be known for.
GONE = r"/(?:(?!\.\.?/)[^/]*+/\.\./|\./)"

# The schemes whose last path segment may carry ";params".
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
)


def clean_domain(c: Column) -> Column:
    """``' https://a.b/ '`` -> ``'a.b'``; the schemes are case-sensitive."""
    bare = F.regexp_replace(strip(c), r"^(?:https://)?(?:http://)?", "")
    return F.regexp_replace(bare, r"/+$", "")


def page_url(domain: Column, path: Column) -> Column:
    return F.concat(F.lit("https://"), domain, path)


def same_domain(netloc: Column, domain: Column) -> Column:
    """The site itself or its ``www.`` twin; case-sensitive, port included."""
    return (netloc == domain) | (netloc == F.concat(F.lit("www."), domain))


def reject_link(link: Column) -> Column:
    """True for a stripped link that is never followed."""
    return (
        F.startswith(F.lower(link), F.lit("javascript:"))
        | F.startswith(link, F.lit("#"))
        | F.contains(link, F.lit("${"))
        | F.contains(link, F.lit("{{"))
    )


def clean_url(url: Column) -> Column:
    """Drop leading controls and blanks, and tabs and line ends anywhere."""
    cleaned = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    return F.when(url.rlike(r"[\x00-\x20]"), cleaned).otherwise(url)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def after_scheme(url: Column) -> Column:
    return F.regexp_replace(url, SCHEME, "")


def rest_netloc(rest: Column) -> Column:
    """Netloc of a URL whose scheme has been cut off."""
    host = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    return F.when(F.startswith(rest, F.lit("//")), host).when(rest.isNotNull(), F.lit(""))


def rest_path(rest: Column) -> Column:
    """Path, with params, of a URL whose scheme has been cut off."""
    after_host = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(F.startswith(rest, F.lit("//")), after_host).otherwise(
        F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    )


def cut_params(path: Column) -> Column:
    """Cut ``;params`` from the last segment."""
    return F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def url_netloc(url: Column) -> Column:
    return rest_netloc(after_scheme(clean_url(url)))


def url_path(url: Column) -> Column:
    """Path without query, fragment and params; '' stays ''."""
    return let(
        clean_url(url),
        lambda u: let(
            rest_path(after_scheme(u)),
            lambda path: F.when(url_scheme(u).isin(*PARAM_SCHEMES), cut_params(path)).otherwise(path),
        ),
    )


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; too many ``..`` stop at the root."""
    def fold(parts: Column) -> Column:
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        ends_open = F.element_at(parts, -1).isin(".", "..")
        return F.array_join(F.when(ends_open, F.array_append(kept, F.lit(""))).otherwise(kept), "/")

    # Most paths have their dot segments behind a plain one; the fold is for what is left of them.
    def rest(p: Column) -> Column:
        return F.when(p.rlike(DOT_SEGMENT), let(F.split(p, "/"), fold)).otherwise(p)

    return F.when(path.rlike(DOT_SEGMENT), let(F.regexp_replace(path, GONE, "/"), rest)).otherwise(path)


def single_slashes(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("//")), F.regexp_replace(path, "/{2,}", "/")).otherwise(path)


def resolve_path(base_path: Column, raw: Column) -> Column:
    """Join the path of a reference that has no netloc of its own.

    A reference without path and params points to the base itself.
    """
    base_dir = F.regexp_extract(base_path, r"^(.*/)?", 0)
    merged = let(
        cut_params(raw),
        lambda ref: F.when(F.startswith(ref, F.lit("/")), ref).otherwise(single_slashes(F.concat(base_dir, ref))),
    )
    joined = F.when(raw.isin("", ";"), base_path).otherwise(let(merged, remove_dot_segments))
    return let(
        joined, lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    )


def bad_netloc(netloc: Column) -> Column:
    """A lone square bracket makes a URL unusable."""
    return F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))


def split_reference(link: Column) -> Column:
    """``struct<scheme, netloc, path>`` of a link, path with query and fragment cut off."""

    def parts(scheme: Column, rest: Column) -> Column:
        return F.struct(scheme.alias("scheme"), rest_netloc(rest).alias("netloc"), rest_path(rest).alias("path"))

    def split_rest(u: Column) -> Column:
        return F.when(F.contains(u, F.lit(":")), let(after_scheme(u), lambda rest: parts(url_scheme(u), rest))).otherwise(
            parts(F.when(u.isNotNull(), F.lit("")), u)
        )

    return let(clean_url(link), split_rest)


def resolve_reference(ref: Column, base_scheme: Column, base_netloc: Column, base_path: Column) -> Column:
    """``struct<netloc, path>`` of a split reference, seen from the base URL.

    A reference with a scheme of its own or with a netloc is taken as it is, its
    path is not normalised; any other is resolved against the base path.
    """
    absolute = ((ref.scheme != "") & (ref.scheme != base_scheme)) | (ref.netloc != "")
    kept = F.when(ref.scheme.isin(*PARAM_SCHEMES), cut_params(ref.path)).otherwise(ref.path)
    # A path from the root without dot segments and params is its own result.
    rooted = F.startswith(ref.path, F.lit("/")) & ~F.contains(ref.path, F.lit("/.")) & ~F.contains(ref.path, F.lit(";"))
    path = F.when(absolute, kept).when(rooted, ref.path).otherwise(resolve_path(base_path, ref.path))
    return F.struct(
        F.when(absolute, ref.netloc).otherwise(base_netloc).alias("netloc"),
        F.coalesce(F.nullif(path, F.lit("")), F.lit("/")).alias("path"),
    )


def url_join(base: Column, link: Column) -> Column:
    """``struct<netloc, path>`` that ``link`` points to when found at ``base``."""
    return let(
        split_reference(link),
        lambda ref: resolve_reference(ref, url_scheme(base), url_netloc(base), url_path(base)),
    )


def url_ext(path: Column) -> Column:
    """Lower-case extension with its dot, '' if none; leading dots do not start one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def url_basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def html_route_path(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def full_url(base: Column, route: Column) -> Column:
    """Absolute routes are kept; others are joined with one slash at the seam."""
    left = F.endswith(base, F.lit("/"))
    right = F.startswith(route, F.lit("/"))
    return (
        F.when(F.startswith(route, F.lit("http")), route)
        .when(left & right, F.concat(base, F.substring(route, 2, 2147483647)))
        .when(~left & ~right, F.concat(base, F.lit("/"), route))
        .otherwise(F.concat(base, route))
    )
