"""URL predicates and normal forms as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.text import bind, strip

# Query parameters that only track the visitor.
TRACKING_PARAMS = [
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "yclid", "_ga", "_gl", "ref_src", "ref_url", "spm",
]
# Host names that never leave a local network.
LOCAL_NAMES = ["localhost", "local", "internal", "lan", "home", "home.arpa", "arpa"]
MAX_IMAGE_URL = 2048

# scheme, user info, host, port, path, query; no blanks, quotes or angle brackets anywhere.
URL_PATTERN = (
    r'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^\s"<>\\^`{|}/?#@]*)@)?'
    r"(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.?)"
    r'(?::(\d*))?(/[^\s"<>\\^`{|}?#]*)?(?:\?([^\s"<>\\^`{|}#]*))?(?:#[^\s"<>\\^`{|}]*)?$'
)
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
PRIVATE_IPV4 = (
    r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|"
    r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
)


def _group(url: Column, n: int) -> Column:
    return F.regexp_extract(strip(url), URL_PATTERN, n)


def url_scheme(url: Column) -> Column:
    return F.lower(_group(url, 1))


def url_domain(url: Column) -> Column:
    """Lower-case host without a trailing dot; null when the text has none."""
    return bind(F.regexp_replace(F.lower(_group(url, 3)), r"\.+$", ""), lambda host: F.when(host != "", host))


def valid_url(c: Column) -> Column:
    """http(s) with a host that has an inner dot; the rest is not judged."""
    host = F.regexp_extract(strip(c), r"(?i)^https?://([^/?]*)", 1)
    return F.coalesce(
        F.rlike(strip(c), F.lit("(?i)^https?://")) & F.contains(host, F.lit("."))
        & ~F.rlike(host, F.lit(r"^\.|\.$")) & (strip(host) != ""),
        F.lit(False),
    )


def normalise_url(c: Column) -> Column:
    """One spelling per resource: https, lower host, no default port, tracking or fragment."""
    scheme, host, port = url_scheme(c), url_domain(c), _group(c, 4)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(_group(c, 5), "/+$", "")
    name = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    kept = F.filter(
        F.split(_group(c, 6), "&"),
        lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(TRACKING_PARAMS),
    )
    query = F.array_join(kept, "&")
    return F.when(
        scheme.isin("http", "https") & host.isNotNull(),
        F.concat(
            F.lit("https://"), host,
            F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path,
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def is_safe_image_url(c: Column) -> Column:
    """An https address on the public internet that may be fetched without credentials."""
    text, host = strip(c), url_domain(c)
    local = F.rlike(host, F.lit(r"(^|\.)(" + "|".join(n.replace(".", r"\.") for n in LOCAL_NAMES) + r")$"))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    mapped = F.regexp_extract(bare, r":([0-9.]+)$", 1)
    private_v6 = F.rlike(bare, F.lit(r"^(::1|::|fe80.*|fc.*|fd.*)$")) | F.rlike(mapped, F.lit(PRIVATE_IPV4))
    private = F.when(F.rlike(host, F.lit(IPV4)), F.rlike(host, F.lit(PRIVATE_IPV4))).when(
        F.contains(host, F.lit(":")), private_v6
    ).otherwise(False)
    return F.coalesce(
        (F.length(text) <= MAX_IMAGE_URL)
        & (url_scheme(c) == "https")
        & ~F.rlike(text, F.lit(r"^[A-Za-z]+://[^/?#]*@"))
        & _group(c, 4).isin("", "443")
        & host.isNotNull() & F.contains(host, F.lit("."))
        & ~local & ~private,
        F.lit(False),
    )


def item_fingerprint(provider_key: Column, url: Column, cell: Column, title: Column) -> Column:
    """Identity of a saved item: provider key, else URL, else sheet cell, else title."""
    filled = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(
        F.lower(filled(provider_key)),
        F.concat(F.lit("url:"), normalise_url(url)),
        F.concat(F.lit("wb:"), F.upper(filled(cell))),
        F.concat(F.lit("title:"), F.coalesce(F.lower(strip(title)), F.lit(""))),
    )
