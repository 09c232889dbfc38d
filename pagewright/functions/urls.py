"""URL functions as column expressions; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(url: Column) -> Column:
    """Without query and fragment, without slashes at the ends, host in lower case."""
    bare = F.trim(F.regexp_replace(url, r"[?#].*$", ""))
    bare = F.regexp_replace(bare, r"^/+|/+$", "")
    host = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


def host_key(url: Column) -> Column:
    """scheme://host in lower case, without port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """sha256 of the URL and the last dotted segment of its path, .htm if there is none."""
    ext = F.regexp_extract(path(url), r"(\.[^./]*)$", 1)
    return F.concat(F.sha2(url, 256), F.when(ext == "", ".htm").otherwise(ext))


def resolve(ref: Column, base: Column) -> Column:
    """An absolute URL, or null for references that lead nowhere else (blank, #, ?, data:, mailto:, tel:, javascript:, whole numbers)."""
    r = F.trim(ref)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(r.isNull() | (r == "") | r.rlike(r"^[#?]") | r.rlike(r"(?i)^(data|mailto|tel|javascript):") | r.rlike(r"^-?[0-9]+$"), F.lit(None).cast("string"))
        .when(r.startswith("//"), F.concat(F.lit("https:"), r))
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), r)
        .when(r.startswith("/"), F.concat(site, r))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(r, r"^(\./)+", "")))
    )


def without_keys(url: Column, *keys: str) -> Column:
    """Without those query parameters, and without the question mark if none is left."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~F.split(x, "=")[0].isin(*keys)), "&")
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)


def is_ip_literal(host: Column) -> Column:
    """Dotted or plain decimal and hexadecimal IPv4 forms, and bracketed IPv6."""
    part = r"(0x[0-9a-fA-F]+|[0-9]+)"
    return host.rlike(rf"^{part}(\.{part}){{0,3}}$") | host.rlike(r"^\[[0-9a-fA-F:.]+\]$")


def admission(ref: Column, base: Column, allowed: list[str]) -> Column:
    """ok, or why a reference is not fetched: empty, unresolvable, scheme:, ip-literal:, off-host:."""
    url = resolve(ref, base)
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return (
        F.when(ref.isNull() | (F.trim(ref) == ""), "empty")
        .when(url.isNull(), "unresolvable")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("scheme:"), scheme))
        .when(is_ip_literal(host), F.concat(F.lit("ip-literal:"), host))
        .when(~host_key(url).isin(*allowed), F.concat(F.lit("off-host:"), F.lower(host)))
        .otherwise("ok")
    )


def glob(pattern: str) -> str:
    """An anchored regular expression for a glob whose only sign is *."""
    import re

    return "(?i)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$"
