"""Network and file observables: refanging, normal forms, identities. Address and domain syntax come from the
standard library and idna in Arrow batches; the rest is SQL."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .text import col

#: Digits of each hash kind.
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}


def _ip(text, version: int | None = None):
    try:
        a = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return a if version in (None, a.version) and "%" not in text else None


def _domain(text) -> str | None:
    import idna

    text = (text or "").strip()
    if not text or re.search(r"[\s:/\\@*?#\[\]\x00-\x1f]", text):
        return None
    try:
        name = idna.encode(text, uts46=True, std3_rules=True, transitional=False).decode().lower().removesuffix(".")
    except idna.IDNAError:
        return None
    labels = name.split(".")
    ok = len(labels) > 1 and len(name) <= 253 and not labels[-1].isdigit() and all(re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", x) for x in labels)
    return name if ok else None


@F.pandas_udf(StringType())
def ipv4(s: pd.Series) -> pd.Series:
    return s.map(lambda t: a.compressed if (a := _ip(t, 4)) else None)


@F.pandas_udf(StringType())
def ipv6(s: pd.Series) -> pd.Series:
    return s.map(lambda t: a.compressed if (a := _ip(t, 6)) else None)


@F.pandas_udf(BooleanType())
def global_address(s: pd.Series) -> pd.Series:
    """Whether an address is one of the public internet."""
    return s.map(lambda t: bool((a := _ip(t)) and a.is_global and not (a.is_multicast or a.is_reserved or a.is_private)))


@F.pandas_udf(StringType())
def domain(s: pd.Series) -> pd.Series:
    return s.map(_domain)


def file_hash(c: str | Column, algorithm: str | None = None) -> Column:
    x = F.lower(col(c))
    sizes = [HASH_LENGTHS[algorithm]] if algorithm else list(HASH_LENGTHS.values())
    return F.when(x.rlike("^[0-9a-f]+$") & F.length(x).isin(*sizes), x)


def hash_algorithm(c: str | Column) -> Column:
    n = F.length(col(c))
    out = F.lit(None).cast("string")
    for name, size in HASH_LENGTHS.items():
        out = F.when(n == size, name).otherwise(out)
    return out


def url(c: str | Column, most: int = 2048) -> Column:
    """Lower-case scheme and host, default ports and the fragment dropped, escapes in upper case; null if it is not a
    plain http(s) URL with a host that is an address or a domain."""
    x = F.trim(col(c))
    pattern = r"^([hH][tT][tT][pP][sS]?)://(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]\s\\]+)(?::(\d{1,5}))?([^?#\s\\]*)(\?[^#\s\\]*)?(#\S*)?$"
    g = lambda i: F.regexp_extract(x, pattern, i)
    scheme, raw_host, port = F.lower(g(1)), g(2), g(3)
    bare = F.regexp_replace(raw_host, r"[\[\]]", "")
    host = F.coalesce(ipv4(bare), F.concat(F.lit("["), ipv6(bare), F.lit("]")), domain(bare))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    rest = F.concat(F.when(g(4) == "", "/").otherwise(g(4)), g(5))
    # upper-case escapes: the text between them is kept as it is
    rest = F.array_join(F.transform(F.split(rest, r"(?=%[0-9a-fA-F]{2})"), lambda p: F.when(p.startswith("%"), F.concat(F.upper(F.substring(p, 1, 3)), F.substring(p, 4, 2048))).otherwise(p)), "")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), rest)
    ok = x.rlike(pattern) & host.isNotNull() & (F.length(out) <= most) & ~rest.rlike("%(?![0-9A-F]{2})") & ((port == "") | port.try_cast("int").between(1, 65535))
    return F.when(ok, out)


def refanged(c: str | Column) -> Column:
    """Text with defanged dots, colons and schemes restored; null where two styles of dots are mixed."""
    x = col(c)
    plain = F.regexp_replace(x, r"\[\.\]|\(\.\)", ".")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)^hxxp(s?)(?=:|\[:\])", "http$1"), r"(?i)^(https?)\[:\]//", "$1://")
    return F.when(~(F.contains(x, F.lit("[.]")) & F.contains(x, F.lit("(.)"))), plain)


def defanged(c: str | Column) -> Column:
    return col(c).rlike(r"(?i)\[\.\]|\(\.\)|\[:\]|^hxxp")


def identity(kind: str | Column, algorithm: str | Column, value: str | Column) -> Column:
    """SHA-256 of the JSON array [kind, algorithm, value]; values in normal form are ASCII without quotes."""
    a = F.when(col(algorithm).isNull(), "null").otherwise(F.concat(F.lit('"'), col(algorithm), F.lit('"')))
    return F.sha2(F.concat(F.lit('["'), col(kind), F.lit('",'), a, F.lit(',"'), F.replace(col(value), F.lit('"'), F.lit('\\"')), F.lit('"]')), 256)


def from_pattern(c: str | Column) -> Column:
    """The (kind, value) of a pattern that is one equality, such as [ipv4-addr:value = '192.0.2.1']."""
    p = r"^\s*\[\s*([a-z0-9-]+):(?:value|hashes\.'?([A-Za-z0-9-]+)'?)\s*=\s*'([^']*)'\s*\]\s*$"
    x = col(c)
    kinds = {"ipv4-addr": "ipv4", "ipv6-addr": "ipv6", "domain-name": "domain", "url": "url", "file": "file_hash"}
    kind = F.lit(None).cast("string")
    for name, k in kinds.items():
        kind = F.when(F.regexp_extract(x, p, 1) == name, k).otherwise(kind)
    return F.when(x.rlike(p), F.struct(kind.alias("kind"), F.nullif(F.lower(F.replace(F.regexp_extract(x, p, 2), F.lit("-"), F.lit(""))), F.lit("")).alias("algorithm"), F.regexp_extract(x, p, 3).alias("value")))


def scaled_confidence(c: str | Column) -> Column:
    """0 to 100 as a decimal of three places; null outside."""
    x = col(c)
    return F.when((x >= 0) & (x <= 100), (x / 100).cast("decimal(4,3)"))


def attack_id(references: str | Column, source: str = "mitre-attack") -> Column:
    """The id of the only reference to the catalog; null if there is none or several, or it is malformed."""
    own = F.filter(col(references), lambda r: r["source_name"] == source)
    found = F.try_element_at(own, F.lit(1))["external_id"]
    return F.when((F.size(own) == 1) & found.rlike(r"^(?:T\d{4}(?:\.\d{3})?|[A-Z]{1,2}\d{4})$"), found)
