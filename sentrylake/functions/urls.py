"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Query parameters that only track.
TRACKING = ["gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "campaign", "campaignid", "adgroupid", "creative"]


def url_hash(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def part(c: str | Column, name: str) -> Column:
    """A part by parse_url's names; null where the URL cannot be parsed."""
    return F.try_parse_url(col(c), F.lit(name))


def canonical_url(c: str | Column, hosts: list[str] | None = None, schemes: tuple[str, ...] = ("https",)) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, the others sorted; null where the scheme, or
    the host against an allow-list, is not accepted."""
    scheme, host = F.lower(part(c, "PROTOCOL")), F.lower(part(c, "HOST"))
    path = F.coalesce(F.nullif(part(c, "PATH"), F.lit("")), F.lit("/"))
    query = F.split(F.coalesce(part(c, "QUERY"), F.lit("")), "&")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(query, lambda p: (F.length(p) > 0) & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))
    url = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    ok = scheme.isin(*schemes) & host.isNotNull() & part(c, "USERINFO").isNull()
    if hosts is not None:
        ok = ok & host.isin(*hosts)
    return F.when(ok, url)


def external_id(c: str | Column, prefix: str) -> Column:
    """A vendor's id of a publication: its last path element, or a digest of the URL."""
    slug = F.regexp_extract(F.coalesce(part(c, "PATH"), F.lit("")), r"([a-z0-9][a-z0-9-]*)/?$", 1)
    return F.concat(F.lit(prefix + ":"), F.when(slug != "", slug).otherwise(F.substring(F.sha2(col(c), 256), 1, 16)))


def notice_id(c: str | Column) -> Column:
    """The number of a notice at the end of its page's path, such as CERTX-2024-ALE-001; null if there is none."""
    return F.nullif(F.regexp_extract(part(c, "PATH"), r"/([A-Z]+-\d{4}-[A-Z]{3}-\d{3,4})/?$", 1), F.lit(""))
