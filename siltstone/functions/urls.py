"""URL functions as pure column expressions, split by the grammar of RFC 3986.

``parse_url`` is avoided: it gives NULL or an error for addresses it deems
malformed, while crawled addresses must always keep their parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SPLIT = "(?s)" + _SPLIT
#: An address that :func:`normalize` leaves as it is: small letters, no port, user or fragment, no segment that repeats the one before.
_VISITED = r"^https?://[a-z0-9.\-]+(?!\S*/([^/?#\s]+)/\1(?:[/?#]|$))(?:/[^?#\s]*)?(?:\?[^#\s]*)?\z"
_NORMAL = r"^https?://[a-z0-9.\-]+(?:[/?][^#\s]*)?\z"


def part(url: Column, number: int) -> Column:
    """Part of an address: 1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark."""
    return F.regexp_extract(url, _SPLIT, number)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), r":(\d*)$", 1)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def _default_port(of_scheme: Column, number: Column) -> Column:
    return (number == "") | ((of_scheme == "http") & (number == "80")) | ((of_scheme == "https") & (number == "443"))


def normalised_address(url: Column) -> Column:
    """Struct (url, host): scheme and host in lower case, default port and fragment dropped, path and query kept.

    White space around the address is dropped. NULL gives NULL parts; what has no scheme or host stays as it is, with an empty host.
    """
    text = F.regexp_replace(url, r"^\s+|\s+$", "")
    own_scheme, own_host, own_port = scheme(text), host(text), port(text)
    user = F.regexp_extract(part(text, 2), r"^(.*@)", 1)
    shown_port = F.when(_default_port(own_scheme, own_port), F.lit("")).otherwise(F.concat(F.lit(":"), own_port))
    whole = F.concat(own_scheme, F.lit("://"), user, own_host, shown_port, part(text, 3), part(text, 4))
    # Most addresses are in normal form already; one match tells.
    done = url.rlike(_NORMAL)
    plain_host = F.substring_index(F.substring_index(F.substring_index(url, "/", 3), "/", -1), "?", 1)
    return F.struct(
        F.when(done, url).when((own_scheme == "") | (own_host == ""), text).otherwise(whole).alias("url"),
        F.when(done, plain_host).otherwise(own_host).alias("host"),
    )


def deduplicate_segments(of_path: Column) -> Column:
    """Path without segments that repeat the one before; empty segments stay."""
    parts = F.split(of_path, "/")
    return F.array_join(F.filter(parts, lambda x, i: (x == "") | (i == 0) | (x != F.get(parts, i - 1))), "/")


def normalize(url: Column) -> Column:
    """Normal form for visiting: scheme and host in lower case, default port dropped, repeated segments and fragment removed.

    User, query, trailing slash and percent escapes stay. Blank or NULL gives NULL.
    """
    text = F.regexp_replace(url, r"^\s+|\s+$", "")
    own_scheme, own_port = scheme(text), port(text)
    user = F.regexp_extract(part(text, 2), r"^(.*@)", 1)
    shown_port = F.when(_default_port(own_scheme, own_port) | own_port.rlike("^0+$"), F.lit("")).otherwise(F.concat(F.lit(":"), own_port))
    head = F.when(own_scheme == "", F.lit("")).otherwise(F.concat(own_scheme, F.lit(":")))
    middle = F.when(part(text, 2) == "", F.lit("")).otherwise(F.concat(F.lit("//"), user, host(text), shown_port))
    # Most addresses are in normal form already; one match tells.
    return F.when(url.rlike(_VISITED), url).when(text != "", F.concat(head, middle, deduplicate_segments(part(text, 3)), part(text, 4)))


def is_safe_scheme(url: Column) -> Column:
    """Is it http or https? Anything else, even no scheme, is not followed."""
    return scheme(F.trim(url)).isin("http", "https")


def strip_query(url: Column) -> Column:
    """The address without its query; the fragment stays."""
    return F.regexp_replace(url, r"\?[^#]*", "")


def origin(url: Column) -> Column:
    """scheme://authority, the key of robots rules."""
    return F.concat(scheme(url), F.lit("://"), F.lower(part(url, 2)))


def remove_dot_segments(of_path: Column) -> Column:
    """Path with "." and ".." resolved."""
    parts = F.split(of_path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def join(base: Column, reference: Column) -> Column:
    """The reference resolved against the base, by RFC 3986."""
    ref = F.trim(reference)
    base_head = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.concat(part(ref, 4), part(ref, 5))
    return (
        F.when(ref == "", base)
        .when(part(ref, 1) != "", ref)
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(base_head, remove_dot_segments(part(ref, 3)), tail))
        .when(ref.startswith("?"), F.concat(base_head, part(base, 3), ref))
        .when(ref.startswith("#"), F.concat(base_head, part(base, 3), part(base, 4), ref))
        .otherwise(F.concat(base_head, remove_dot_segments(F.concat(folder, part(ref, 3))), tail))
    )
